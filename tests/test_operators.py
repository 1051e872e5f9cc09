"""Operators on small tables whose results are known."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerline import rules
from ledgerline.functions import dates, numbers
from ledgerline.functions import text as tx
from ledgerline.operators import dashboard, facts, filings, flows, holdings, planner, ranking, report, series, triggers, validate


def one(frame, column):
    return frame.select(column).first()[0]


def test_price_moves(spark):
    rows = [("a", date(2026, 5, 1), 100.0), ("a", date(2026, 5, 2), 110.0), ("b", date(2026, 5, 1), 100.0), ("b", date(2026, 5, 2), 93.0), ("c", date(2026, 5, 1), 100.0), ("c", date(2026, 5, 2), 101.0), ("d", date(2026, 5, 2), 9.0)]
    hits = {r.ticker: r.severity for r in triggers.price_moves(spark.createDataFrame(rows, "ticker string, dt date, close double")).collect()}
    assert hits == {"a": pytest.approx(2.0), "b": pytest.approx(1.4)}


def _flows(spark, *rows):
    return spark.createDataFrame([(t, date(2026, 5, d), float(p), n * 10**8, "krx") for t, d, p, n in rows], "ticker string, dt date, pct_change double, net_krw long, source string")


def test_flow_hits(spark):
    frame = _flows(spark, ("a", 3, 0, -100), ("a", 2, 0, -150), ("a", 1, 0, 200), ("b", 3, 0, -800), ("b", 2, 0, -700), ("b", 1, 0, -500), ("c", 1, 0, 9000))
    (hit,) = triggers.flow_hits(frame).collect()
    assert (hit.ticker, hit.direction, hit.cumulative, hit.severity, hit.sources) == ("b", "매도", -2000e8, 4.0, "krx")


def test_decoupling(spark):
    frame = _flows(spark, ("a", 1, 5, 500), ("b", 1, 1, -500), ("c", 1, 5, -800), ("d", 1, -3, 500))
    hits = {r.ticker: (r.label, r.severity) for r in triggers.decoupling_hits(frame).collect()}
    assert hits["c"] == ("국내 환호 / 외인 매도", pytest.approx((2.5 + 800 / 300) / 2))
    assert hits["d"][0] == "국내 패닉 / 외인 매수" and set(hits) == {"c", "d"}


def test_scores_and_top(spark):
    watch = spark.createDataFrame([(0, "000660"), (1, "005930"), (2, "373220")], "ord int, ticker string")
    hit = lambda *rows: spark.createDataFrame(list(rows), "ticker string, trigger_type string, severity double")
    hits = triggers.ranked_hits(watch, hit(("000660", "price_move", 1.0), ("005930", "price_move", 2.0), ("373220", "price_move", 1.0)), hit(("000660", "dart_disclosure", 1.0)))
    assert [(r.ticker, r.total_score) for r in triggers.top_tickers(hits).collect()] == [("000660", 50.0), ("005930", 40.0), ("373220", 20.0)]
    assert triggers.should_publish(hits) and not triggers.should_publish(hits.where("false"))


def test_disclosure_impact(spark):
    names = {"영업(잠정)실적(공정공시)": 1.5, "주요사항보고서(자기주식취득결정)": 1.3, "회사합병결정": 1.3, "[정정]사업보고서": 1.2, "자사주 소각": 1.1, "유상증자결정": 1.0, "기타": 0.0, "": 0.0, None: 0.0}
    frame = spark.createDataFrame([(n,) for n in names], "n string").select("n", triggers.impact(F.col("n")).alias("s"))
    assert {r.n: r.s for r in frame.collect()} == names


def test_period_end(spark):
    cases = [("1분기보고서", "20260515", date(2026, 3, 31)), ("반기보고서", "20260815", date(2026, 6, 30)), ("3분기보고서", "20261115", date(2026, 9, 30)), ("영업(잠정)실적", "20260128", date(2025, 12, 31)), ("영업(잠정)실적", "20260423", date(2026, 3, 31)), ("기타공시", "20260101", None), ("반기보고서", "x", None)]
    frame = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, n string, d string")
    found = frame.select("i", dates.period_end(F.col("n"), dates.compact_date(F.col("d"))).alias("e")).orderBy("i").collect()
    assert [r.e for r in found] == [c[2] for c in cases]


def test_iso_weeks(spark):
    frame = spark.createDataFrame([(date(2027, 1, 1), "2026-W10", "2026-W12")], "d date, a string, b string")
    row = frame.select(dates.iso_week(F.col("d")).alias("w"), dates.weeks_between(F.col("a"), F.col("b")).alias("n"), dates.weeks_between(F.lit("bad"), F.col("b")).alias("z")).first()
    assert tuple(row) == ("2026-W53", 2, 0)


def test_interim_and_periodic(spark):
    rows = [(1, "c", "영업(잠정)실적", "20260423"), (2, "c", "분기보고서 (2026.03)", "20260515"), (3, "c", "소음", "20260420"), (4, "c", "반기보고서 (2026.06)", "20260815"), (5, "c", "분기보고서 (2026.09)", "20261115"), (6, "c", "[정정]사업보고서 (2025.12)", "20260401"), (7, "c", "사업보고서 (2025.12)", "20260317")]
    frame = spark.createDataFrame(rows, "ord int, corp_code string, report_nm string, rcept_dt string")
    found = filings.interim_filings(frame, "20260317").orderBy("nth").collect()
    assert [r.ord for r in found] == [5, 4, 2, 1] and found[-1].days_after_annual == 37
    assert [r.ord for r in filings.periodic_reports(frame, 2025, "11011").orderBy("nth").collect()] == [6, 7]
    assert [r.ord for r in filings.periodic_reports(frame, 2026, "11013").collect()] == [2]
    assert [r.ord for r in filings.periodic_reports(frame, 2026, "11014").collect()] == [5]


def test_share_counts_and_cap(spark):
    items = spark.createDataFrame([("t", 0, "보통주", "728,002,365", "26,310,845", "701,691,520"), ("t", 1, "우선주", "0", None, "0"), ("u", 0, "보통주", "x", None, None)], "ticker string, ord int, se string, istc_totqy string, tesstk_co string, distb_stock_co string")
    prices = spark.createDataFrame([("t", 200000.0), ("v", 1.0)], "ticker string, close double")
    rows = {r.ticker: r for r in holdings.ticker_snapshot(prices, holdings.share_counts(items)).collect()}
    assert (rows["t"].common_shares, rows["t"].treasury_shares, rows["t"].preferred_shares, rows["t"].market_cap) == (728002365, 26310845, 0, 1.45600473e14)
    assert rows["u"].common_shares is None and rows["u"].market_cap is None and rows["v"].market_cap is None


def test_holders(spark):
    rows = [("t", 0, "SK스퀘어㈜", "20260101", 20.07), ("t", 1, "BlackRock, Inc.", "20260201", 5.42), ("t", 2, "BlackRock, Inc.", "20250801", 4.99), ("t", 3, " ", "20260101", 1.0)]
    latest = holdings.latest_per_holder(spark.createDataFrame(rows, "ticker string, ord int, holder string, rcept_dt string, holding_pct double"))
    row = holdings.foreign_summary(latest).first()
    assert (row.holders, row.foreign_holders, row.foreign_pct) == (2, 1, 5.42)


def test_holding_delta(spark):
    values = [49.18, 49.28, 49.25, 49.37, 49.62, 49.40]
    frame = spark.createDataFrame([("t", date(2026, 1, i + 1), v) for i, v in enumerate(values)], "ticker string, dt date, pct double")
    row = series.delta_rows(frame, "pct").first()
    assert row.pct == 49.40 and row.delta == pytest.approx(0.22)
    assert series.delta_rows(frame.limit(5), "pct").first().delta is None


def test_sparkline(spark):
    frame = spark.createDataFrame([([100.0, 110.0, 105.0, 120.0, 115.0],), ([100.0, 200.0],), ([],)], "s array<double>")
    points = [r[0] for r in frame.select(series.normalised_points(F.col("s"))).collect()]
    assert [p.y for p in points[0]] == [1.0, 0.5, 0.75, 0.0, 0.25] and points[2] == []
    assert [r[0] for r in frame.select(series.polyline(F.col("s"), 100.0, 50.0)).collect()][1] == "0.0,50.0 100.0,0.0"


def test_numbers(spark):
    cases = [("333.61", "조", 3.3361e14, 3.3361e14), ("△1.5", "조", -1.5e12, 1.5e12), ("1,234", "억", 1.234e11, 1.234e11), ("-△1", "조", None, 1e12), ("x", "조", None, None)]
    frame = spark.createDataFrame([(i, n, u) for i, (n, u, _, _) in enumerate(cases)], "i int, n string, u string").orderBy("i")
    signed = [r[0] for r in frame.select(numbers.signed_amount(F.col("n"), F.col("u"))).collect()]
    plain = [r[0] for r in frame.select(numbers.absolute_amount(F.col("n"), F.col("u"))).collect()]
    assert signed == [pytest.approx(c[2]) if c[2] is not None else None for c in cases]
    assert plain == [pytest.approx(c[3]) if c[3] is not None else None for c in cases]


def _claims(spark, text, *values):
    lines = tx.lines(spark.createDataFrame([(0, text)], "doc_id int, text string"))
    claims = validate.numeric_claims(lines).withColumn("claim_id", F.concat_ws("-", "line_no", "nth"))
    known = spark.createDataFrame([(0, float(v)) for v in values], "doc_id int, fact double")
    return [r.status for r in facts.check_claims(claims, known, ["doc_id"]).orderBy("line_no", "nth").collect()]


@pytest.mark.parametrize(
    ("text", "value", "status"),
    [
        ("연결 매출 333.61조원", 333.61e12, ["ok"]),
        ("영업이익 47.21조원", 47.21e12, ["ok"]),
        ("영업이익 4.7조원", 47.21e12, ["numeric_scale_mismatch"]),
        ("시가총액 1,204.1조원 (KRX 종가)", 1.21e14, []),
        ("매출 100조원", 7.7e12, ["numeric_unverified"]),
        ("영업이익 △11.5조원", -11.526e12, ["ok"]),
        ("-27.52조원", 27.52e12, ["numeric_abs_or_rounded_match"]),
        ("1.5조 *(추론 — 근거)*", 1.0, ["skipped"]),
        ("규모 11.3억", 1.0, []),
    ],
)
def test_claims(spark, text, value, status):
    assert _claims(spark, text, value) == status


@pytest.mark.parametrize(
    ("head", "rows", "category"),
    [
        ("매출", ["a|100", "b|50", "합계|150"], None),
        ("매출", ["a|187.97", "b|130.13", "c|29.84", "d|15.78", "e|△30.11", "합계|333.61"], None),
        ("매출", ["a|100", "b|50", "합계|200"], "table_sum_mismatch"),
        ("비중", ["a|30%", "b|30%", "c|30%"], "percentage_sum_off"),
        ("비중", ["a|33.4%", "b|33.3%", "c|33.3%"], None),
        ("구성비", ["a|50%", "b|50%"], None),
        ("영업이익률", ["a|10%", "b|20%", "합계|90%"], None),
    ],
)
def test_tables(spark, head, rows, category):
    table = "\n".join([f"| 구분 | {head} |", "|---|---|", *(f"| {r.replace('|', ' | ')} |" for r in rows)])
    cells = validate.markdown_tables(tx.lines(spark.createDataFrame([(0, table)], "doc_id int, text string")))
    assert [r.category for r in validate.table_arithmetic(cells).collect()] == ([category] if category else [])


@pytest.mark.parametrize(
    ("text", "values", "n"),
    [
        ("시총(약 80조원대) 대비 FCF 33.4조", {"market_cap": 1204.1e12}, 1),
        ("시가총액 1,204.12조원", {"market_cap": 1204.1e12}, 0),
        ("시총 80조원 *(추론)*", {"market_cap": 1204e12}, 1),
        ("1Q26 영업이익 6.97조원", {"interim_q_operating_income": 37.61e12}, 1),
        ("연결 매출 97조 1,467억원", {"revenue": 97.146675e12}, 0),
    ],
)
def test_consistency(spark, text, values, n):
    lines = tx.lines(spark.createDataFrame([(0, text)], "doc_id int, text string"))
    found = validate.consistency(lines, rules.authority_frame(spark, values)).collect()
    assert len(found) == n
    if n and "market_cap" in values:
        assert found[0].found == pytest.approx(8e13) and found[0].deviation_pct < -90


def _docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_style(spark):
    lines = tx.lines(_docs(spark, "업계 관계자에 따르면 좋다\n매출은 늘 것으로 예상된다", "성장이 전망된다 *(추론)*", "보도에 따르면 *(추론)*"))
    assert [(r.doc_id, r.line_no) for r in validate.style_hits(lines).orderBy("doc_id").collect()] == [(0, 1), (2, 1)]
    assert [(r.doc_id, r.line_no) for r in validate.unmarked_speculation(lines).collect()] == [(0, 2)]
    assert [r.category for r in validate.document_checks(_docs(spark, "본문"), assembled=True).collect()] == ["missing_timestamp_box"]
    assert validate.document_checks(_docs(spark, "이번 회 등장 용어: 없음. 마치 집 같다"), assembled=False).count() == 0


def test_guards(spark):
    docs = _docs(spark, "filings: []", "좋은 글", "capex 확인되지 않음\n그리고\n" + "가" * 80 + "\ncapex 3.4조 → 27.5조", "2026 capex 가이던스 확인되지 않음\n" + "가" * 80 + "\n2025 capex 3.4조")
    assert [r.doc_id for r in validate.failure_markers(docs).collect()] == [0]
    assert [(r.doc_id, r.word) for r in validate.unknown_and_asserted(docs).collect()] == [(2, "capex")]


def test_secrets(spark):
    key = "AKIA" + "A" * 16
    lines = tx.lines(_docs(spark, f"k = {key}", f"k = {key} # example", "gh" + "p_" + "a" * 36, "PUT_YOUR " + key, "clean"))
    assert [(r.doc_id, r.label) for r in validate.secrets(lines).orderBy("doc_id").collect()] == [(0, "AWS access key"), (2, "GitHub Personal Access Token")]
    files = spark.createDataFrame([("a/b.png",), ("a/b.py",), ("SECURITY.md",)], "path string")
    assert [r.path for r in validate.scanned_files(files, ["SECURITY.md"]).collect()] == ["a/b.py"]


def test_budgets(spark):
    frame = spark.createDataFrame([("g", 0, 100), ("g", 1, 100)], "grp string, ord int, n_chars int")
    assert [r.budget for r in ranking.budgets(frame, 100, 120).orderBy("ord").collect()] == [60, 60]
    frame = spark.createDataFrame([("g", 0, 10), ("g", 1, 100), ("g", 2, 100)], "grp string, ord int, n_chars int")
    assert [r.budget for r in ranking.budgets(frame, 90, 150).orderBy("ord").collect()] == [10, 90, 50]


def test_planner(spark):
    periods = rules.period_frame(spark)
    watch = spark.createDataFrame([(0, "005930", "a", "s"), (1, "000660", "b", "s"), (2, "1", "c", "t")], "ord int, ticker string, name string, sector string")
    none = spark.createDataFrame([], "ticker string, period_label string")
    pick = lambda done, day, skipped=none: [tuple(r) for r in planner.next_work(periods, watch, done, skipped, day).select("period_label", "ticker").collect()]
    assert pick(none, date(2026, 5, 9)) == [("2025-annual", "005930")]
    done = watch.select("ticker", F.lit("2025-annual").alias("period_label"))
    assert pick(done, date(2026, 5, 15)) == [("2026-q1", "005930")] and pick(done, date(2026, 5, 14)) == []
    assert pick(done, date(2026, 5, 15), spark.createDataFrame([("005930", "2026-q1")], "ticker string, period_label string")) == [("2026-q1", "000660")]
    history = spark.createDataFrame([("s", "2026-W10")], "sector string, iso_week string")
    counts = spark.createDataFrame([("s", 5)], "sector string, n int")
    best = planner.pick_sector(watch, history, counts, "2026-W12").first()
    assert (best.sector, best.weeks_since, best.score) == ("s", 2, 12)


def test_dashboard(spark):
    watch = spark.createDataFrame([(0, "a", "s"), (1, "b", "t")], "ord int, ticker string, sector string")
    reports = spark.createDataFrame([("a", "2025-annual"), ("a", "2026-q1")], "ticker string, period_label string")
    assert tuple(dashboard.totals(watch, reports).first()) == (2, 1, 2, 2)
    done = {r.period_label: (r.done, r.status) for r in dashboard.period_completion(rules.period_frame(spark), watch, reports, date(2026, 9, 1)).collect()}
    assert done["2025-annual"] == (1, "진행중") and done["2026-h1"] == (0, "진행X") and done["2026-q3"] == (0, "대기")
    assert [r[0] for r in spark.createDataFrame([(12345.0,), (-70.0,)], "e double").select(dashboard.flow_display(F.col("e"))).collect()] == ["+1.2조", "-70억"]


def test_flows_join_and_cache(spark):
    bars = spark.createDataFrame([("t", date(2026, 1, 1), 10), ("t", date(2026, 1, 2), 11)], "ticker string, dt date, close int")
    who = spark.createDataFrame([("t", date(2026, 1, 1), "외국인", 5), ("t", date(2026, 1, 1), "기관합계", -3), ("t", date(2026, 1, 2), "기관합계", 1)], "ticker string, dt date, investor string, net_krw long")
    assert [(r.close, r.foreign_net_krw, r.inst_net_krw) for r in flows.join_flows(bars, who).collect()] == [(10, 5, -3)]
    cache = spark.createDataFrame([("t", datetime(2026, 1, 1, 0)), ("u", datetime(2026, 1, 1, 9))], "ticker string, fetched_at timestamp")
    assert [r.ticker for r in flows.fresh(cache, datetime(2026, 1, 1, 10), 6).collect()] == ["u"]


def test_labels(spark):
    labels = spark.createDataFrame([("ifrs-full_GrossRevenue", "총", 0), ("ifrs-full_Revenue", "매출", 1), ("ifrs-full:Equity", "자본", 2)], "concept_id string, label string, ord int")
    concepts = spark.createDataFrame([("ifrs-full:Revenue",), ("ifrs-full:Equity",), ("dart:None",)], "concept string")
    assert {r.concept: r.label for r in facts.label_concepts(concepts, labels).collect()} == {"ifrs-full:Revenue": "총", "ifrs-full:Equity": "자본", "dart:None": None}


def test_core_facts(spark):
    dims = "array<struct<axis:string,member:string>>"
    axis = f"ifrs-full:{rules.CONSOLIDATED_AXIS}"
    rows = [(0, "2025-12-31", []), (1, "2022-12-31", []), (2, None, []), (3, "2025-12-31", [(axis, "ifrs-full:ConsolidatedMember")]), (4, "2025-12-31", [(axis, "ifrs-full:SeparateMember")]), (5, "2025-12-31", [(axis, "x:ConsolidatedMember"), ("other", "y")])]
    frame = spark.createDataFrame(rows, f"ord int, period_end string, dimensions {dims}")
    kept = frame.where(facts.is_consolidated_primary(F.col("period_end"), F.col("dimensions")))
    assert [r.ord for r in kept.orderBy("ord").collect()] == [0, 3]
    series_ = spark.createDataFrame([(c, "2025-12-31", i, 1.0) for i, c in enumerate("aabbbcc")], "concept string, period_end string, ord int, value double")
    assert [(r.concept, r.n) for r in facts.core_timeseries(series_, list("abc"), 5).orderBy("concept").collect()] == [("a", 2), ("b", 3)]


def test_report(spark):
    reports = spark.createDataFrame([(0,)], "doc_id int")
    texts = spark.createDataFrame([(0, report.SECTIONS[0], "# t\n\n" + "긴 문장이다. " * 10)], "doc_id int, section_id string, text string")
    row = report.assembled(reports, texts).first()
    assert row.present == 1 and row.report.count(report.MISSING) == 9 and row.report.startswith("- [01_사업구조진단]")
    assert report.incomplete(reports, texts).count() == 9
    attempts = spark.createDataFrame([("s", 1, False), ("s", 2, True), ("s", 3, True), ("t", 1, False), ("t", 2, False)], "section string, attempt int, passed boolean")
    assert {(r.section, r.attempt, r.best_effort) for r in validate.chosen_attempt(attempts).collect()} == {("s", 2, False), ("t", 2, True)}
