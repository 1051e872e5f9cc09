"""End products over small tables."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline import rules
from ledgerline.operators import products


def test_evaluate_triggers(spark):
    day = date(2026, 5, 12)
    watch = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ord int, ticker string")
    bars = spark.createDataFrame([("a", day - timedelta(1), 100.0), ("a", day, 93.0)], "ticker string, dt date, close double")
    flows = spark.createDataFrame([("c", day, 0.0, 0, "krx")], "ticker string, dt date, pct_change double, net_krw long, source string")
    filings = spark.createDataFrame([("b", 1, "1", "영업(잠정)실적", "20260512"), ("c", 2, "2", "합병", "20260501")], "ticker string, ord int, rcept_no string, report_nm string, rcept_dt string")
    hits = products.evaluate_triggers(watch, bars, flows, filings, day).orderBy("rank").collect()
    assert [(r.ticker, r.trigger_type, r.score) for r in hits] == [("b", "dart_disclosure", 45.0), ("a", "price_move", pytest.approx(28.0))]


def test_market_snapshot(spark):
    start = date(2025, 1, 1)
    bars = spark.createDataFrame([("t", start + timedelta(i), 100.0 + i) for i in range(70)], "ticker string, dt date, close double")
    items = spark.createDataFrame([("t", 0, "보통주", "1,000", "10", "990"), ("u", 0, "보통주", "5", None, None)], "ticker string, ord int, se string, istc_totqy string, tesstk_co string, distb_stock_co string")
    rows = {r.ticker: r for r in products.market_snapshot(bars, items).collect()}
    t = rows["t"]
    assert (t.close, t.pct_60d, t.pct_1y, len(t.closes), t.market_cap) == (169.0, 53.64, 69.0, 60, 169000.0)
    assert rows["u"].close is None and rows["u"].common_shares == 5


def test_holding_snapshot(spark):
    reports = spark.createDataFrame([("t", 0, "BlackRock, Inc.", "20260201", 5.42), ("t", 1, "SK스퀘어㈜", "20260201", 20.07)], "ticker string, ord int, holder string, rcept_dt string, holding_pct double")
    history = spark.createDataFrame([("t", date(2026, 1, i + 1), v) for i, v in enumerate([49.18, 49.28, 49.25, 49.37, 49.62, 49.40])], "ticker string, dt date, holding_pct double")
    (r,) = products.holding_snapshot(reports, history).collect()
    assert (r.foreign_holders, r.foreign_pct, r.latest_pct, r.change_5d) == (1, 5.42, 49.40, 0.22)


DIMS = "array<struct<axis:string,member:string>>"


def test_facts(spark):
    rows = [(0, "ifrs-full:Revenue", "2025-12-31", 97e12, []), (1, "ifrs-full:Revenue", "2025-12-31", 1.0, []), (2, "ifrs-full:Assets", "2025-12-31", 5.0, []), (3, "other:X", "2025-12-31", 5.0, []), (4, "ifrs-full:Revenue", "2024-12-31", 90e12, [])]
    facts = spark.createDataFrame(rows, f"ord int, concept string, period_end string, value double, dimensions {DIMS}")
    labels = spark.createDataFrame([("ifrs-full_Revenue", "매출", 0)], "concept_id string, label string, ord int")
    found = {r.concept: (r.label, r.n) for r in products.fact_summary(facts, labels).collect()}
    assert found == {"ifrs-full:Revenue": ("매출", 3), "ifrs-full:Assets": ("ifrs-full:Assets", 1)}
    known = {r.key: r.value_krw for r in products.authoritative_facts(facts, 2025, 1.2e15).collect()}
    assert known == {"revenue": 97e12, "market_cap": 1.2e15}


def test_accepted_sections(spark):
    attempts = [("s", 1, "매출이 늘 것으로 예상된다"), ("s", 2, "연결 매출 97조원"), ("s", 3, "연결 매출 97조원"), ("t", 1, "매출 9.7조원"), ("t", 2, "업계 관계자 말"), ("u", 1, "연결 매출 80조원"), ("u", 2, "| a | 매출 |\n|---|---|\n| x | 1 |\n| y | 2 |\n| 합계 | 9 |")]
    facts = spark.createDataFrame([(97e12,)], "fact double")
    authority = rules.authority_frame(spark, {"revenue": 97e12})
    found = products.accepted_sections(spark.createDataFrame(attempts, "section string, attempt int, text string"), facts, authority)
    assert {(r.section, r.attempt, r.best_effort) for r in found.collect()} == {("s", 2, False), ("t", 2, True), ("u", 2, True)}


def test_render_plan(spark):
    reports = spark.createDataFrame([("a", 2), ("b", 1)], "name string, modified int")
    rendered = spark.createDataFrame([("b", 1), ("a", 1)], "name string, modified int")
    watch = spark.createDataFrame([("a",), ("c",)], "name string")
    assert sorted(map(tuple, products.render_plan(reports, rendered, watch).collect())) == [("a", "report"), ("c", "placeholder")]


@pytest.mark.parametrize(
    ("text", "line"),
    [
        ("# t\n> **데이터 기준시점** x\n> y\n```\ncode that is long enough to count\n```\n- [a](b)\n- short\n이 회사는 [메모리](x) 반도체를 만들어 파는 회사이다.", "이 회사는 메모리 반도체를 만들어 파는 회사이다."),
        ("짧다", ""),
        ("가" * 300, "가" * 200 + "…"),
    ],
)
def test_one_liner(spark, text, line):
    assert spark.createDataFrame([(text,)], "t string").select(products.one_liner(F.col("t"))).first()[0] == line
