"""Readers on synthetic files."""

from __future__ import annotations

import time
from datetime import date

from pyspark.sql import functions as F

from ledgerline import rules
from ledgerline.operators import filings, holdings, triggers, validate
from ledgerline.sources import answers, markup, sinks, tables

XBRL = """<?xml version="1.0"?><xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:xbrldi="http://xbrl.org/2006/xbrldi" xmlns:ifrs="http://xbrl.ifrs.org/taxonomy/2021-03-24/ifrs-full">
<xbrli:context id="c1"><xbrli:entity><xbrli:segment><xbrldi:explicitMember dimension="a:Axis">a:Member</xbrldi:explicitMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:instant>2025-12-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:context id="c2"><xbrli:period><xbrli:startDate>2025-01-01</xbrli:startDate><xbrli:endDate>2025-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:unit id="KRW"><xbrli:measure>iso4217:KRW</xbrli:measure></xbrli:unit>
<ifrs:Assets contextRef="c1" unitRef="KRW" decimals="-6">1500000</ifrs:Assets><ifrs:Revenue contextRef="c2" decimals="INF">2.5E3</ifrs:Revenue>
<ifrs:Name contextRef="c2">text</ifrs:Name><ifrs:Lost contextRef="c9">7</ifrs:Lost></xbrli:xbrl>"""
LABELS = """<link:linkbase xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink"><link:labelLink>
<link:loc xlink:href="x.xsd#ifrs-full_Assets" xlink:label="l1"/><link:labelArc xlink:from="l1" xlink:to="r1"/>
<link:label xlink:label="r1" xml:lang="ko" xlink:role="http://www.xbrl.org/2003/role/terseLabel">짧게</link:label>
<link:label xlink:label="r1" xml:lang="ko" xlink:role="http://www.xbrl.org/2003/role/label">자산</link:label>
<link:label xlink:label="r1" xml:lang="en" xlink:role="http://www.xbrl.org/2003/role/label">Assets</link:label></link:labelLink></link:linkbase>"""
WATCHLIST = "# t\n| # | 종목 | 코드 | corp | 섹터 | 메모 |\n|---|---|---|---|---|---|\n| 1 | 삼성전자 | 005930 | TBD | 반도체 | m |\n| 2 | 하이닉스 | 000660 | 00164779 | 반도체 | n |\n| x | y |\n\n| 3 | no | 1 | 2 | 3 | 4 |\n"


def test_watchlist(spark):
    frame = spark.createDataFrame([("w", WATCHLIST)], "path string, text string")
    assert [(r.ord, r.ticker, r.corp_code) for r in tables.watchlist(frame).orderBy("ord").collect()] == [(0, "005930", None), (1, "000660", "00164779")]


def test_corp_codes(spark, tmp_path):
    item = "<list><corp_code>{}</corp_code><corp_name>n</corp_name><stock_code>{}</stock_code><modify_date>1</modify_date></list>"
    (tmp_path / "c.xml").write_text("<result>" + item.format("00126380", "005930") + item.format("00164779", "000660") + item.format("1", " ") + "</result>")
    assert {r.stock_code: r.corp_code for r in tables.corp_codes(spark, str(tmp_path / "c.xml")).collect()} == {"005930": "00126380", "000660": "00164779"}


def test_xbrl(spark):
    files = spark.createDataFrame([("i.xbrl", XBRL.encode()), ("lab-ko.xml", LABELS.encode())], "path string, content binary")
    elements = markup.xbrl_elements(files).cache()
    rows = {r.concept: r for r in markup.xbrl_facts(elements).collect()}
    assert set(rows) == {"ifrs-full:Assets", "ifrs-full:Revenue", "ifrs-full:Lost"}
    assert (rows["ifrs-full:Assets"].value, rows["ifrs-full:Assets"].decimals, rows["ifrs-full:Assets"].period_end, rows["ifrs-full:Assets"].dimensions[0].member) == (1.5e6, -6, "2025-12-31", "a:Member")
    assert (rows["ifrs-full:Revenue"].period_start, rows["ifrs-full:Revenue"].decimals) == ("2025-01-01", None)
    assert (rows["ifrs-full:Lost"].period_type, rows["ifrs-full:Lost"].dimensions) == ("?", [])
    assert [(r.concept_id, r.label) for r in markup.xbrl_labels(elements).collect()] == [("ifrs-full_Assets", "자산")]


def test_markup(spark):
    files = spark.createDataFrame([("a.html", b"<p>One&nbsp;two</p><table><tr><td>1</td><td>2</td></tr></table>"), ("b.txt", "글".encode()), ("c.zip", b"PK")], "path string, content binary")
    texts, skipped = markup.filing_texts(files)
    assert {r.path: r.text for r in texts.collect()} == {"a.html": "One two\n| 1\n| 2", "b.txt": "글"}
    assert [r.path for r in skipped.collect()] == ["c.zip"]
    assert markup.prefix_of("http://dart.fss.or.kr/taxonomy/2020/ifrs/dart") == "dart" and markup.prefix_of("x") == "x"


def test_broken_markup_takes_linear_time():
    start = time.perf_counter()
    for piece in ('""', "''", "\"'", "<a ", '<a "', "<script", "<!--", "<a b='>", "&", '<a "x>'):
        assert markup.markup_text("<a " + piece * 100_000 + "x")
        assert markup.markup_text(piece * 100_000 + "<p>x</p>").endswith("x</p>" if piece == "<!--" else "x")  # without any text, the markup
    assert time.perf_counter() - start < 20
    assert markup.markup_text('<a title="1 > 2">a</a> b') == "a b" and markup.markup_text('<a title="b>c</a>d') == "c d"


def test_scraped_flows(spark):
    row = "".join(f"<td>{x}</td>" for x in ("2026.05.12", "1,000", "x", "+1.5%", "7,000", "", "-30", "500", "49.4%"))
    page = f'<table class="type2"><tr>{row}</tr><tr><td>short</td></tr></table><table><tr>{row}</tr></table>'
    (r,) = markup.scraped_flows(spark.createDataFrame([("t", 1, page)], "ticker string, page int, html string")).collect()
    assert (r.dt, r.close, r.pct_change, r.volume, r.net_krw, r.holding_pct) == (date(2026, 5, 12), 1000, 1.5, 7000, -30000, 49.4)


def test_reports_and_notes(spark):
    names = ["companies/a/p/00_종합진단.md", "companies/a/p/01_x.md", "companies/b/p/01_x.md", "companies/c/p/01_x.v2_warnings.md"]
    files = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "path string, modified int")
    assert {(r.company, r.name, r.partial) for r in tables.reports(files).collect()} == {("a", "00_종합진단.md", False), ("b", "01_x.md", True)}
    assert [(r.company, r.section) for r in tables.warnings(files).collect()] == [("c", "01_x")]
    notes = spark.createDataFrame([("n/2026-05-12.md", "# 제목\n> **트리거**: 2건\n### a\n### b"), ("n/_index.md", "# i")], "path string, text string")
    (r,) = tables.note_headers(notes).collect()
    assert (r.headline, r.trigger_line, r.cards) == ("제목", "> **트리거**: 2건", 2)
    stems = spark.createDataFrame([("2026-W10-반도체.md",), ("x.md",)], "name string")
    assert [tuple(r) for r in tables.sector_history(stems).collect()] == [("반도체", "2026-W10")]


def test_health_and_snapshots(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h/a.json").write_text('{"timer": "daily", "last_run": "2026-05-12T16:00:00Z", "status": "ok", "details": {"n": "1"}}')
    (tmp_path / "h/b.json").write_text("{broken")
    assert [(r.timer, r.status) for r in tables.health(spark, str(tmp_path / "h")).collect()] == [("daily", "ok")]
    frame = spark.createDataFrame([("a", "p", 1), ("b", "p", 2)], "company string, period string, v int")
    sinks.write_snapshot(frame, str(tmp_path / "s"), "company", "period")
    sinks.write_snapshot(frame.where("company = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "s"), "company", "period")
    assert {r.company: r.v for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {"a": 9, "b": 2}


def test_answers(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"status": "000", "page_no": 1, "list": [{"repror": "SK스퀘어㈜", "stkrt": "20.07", "rcept_dt": "2026-02-01"}, {"repror": "BlackRock, Inc.", "stkrt": "5.42", "rcept_dt": "2026-02-01"}]}')
    (tmp_path / "2.json").write_text('{"page_no": "2", "list": [{"repror": "BlackRock, Inc.", "stkrt": "4.99", "rcept_dt": "2025-08-01", "more": 1}]}')
    (tmp_path / "3.json").write_text('{"status": "020", "message": "limit"}')
    (tmp_path / "4.json").write_text("<html>")
    (tmp_path / "5.json").write_text('{"status": "000"}')
    found, refused = answers.items(answers.answers(tables.whole_texts(spark, str(tmp_path)), answers.HOLDER), "path")
    assert {(r.path[-6:], r.reason) for r in refused.collect()} == {("3.json", "020 limit"), ("4.json", "no JSON")}
    assert {(r.page_no, r.nth, r.repror) for r in found.collect()} == {(1, 0, "SK스퀘어㈜"), (1, 1, "BlackRock, Inc."), (2, 0, "BlackRock, Inc.")}
    holders = found.select(F.lit("t").alias("ticker"), (F.col("page_no") * 1000 + F.col("nth")).alias("ord"), *answers.holder_columns())
    (r,) = holdings.foreign_summary(holdings.latest_per_holder(holders)).collect()
    assert (r.holders, r.foreign_holders, r.foreign_pct) == (2, 1, 5.42)
    (none,) = answers.answers(spark.createDataFrame([(None,)], "text string"), answers.FILING).collect()
    assert (none.reason, none.list) == ("no JSON", None)


def test_filing_pages(spark):
    rows = [("c", f"r{i}", f"202605{10 + i // 2}") for i in range(8)] + [("d", "x", "20260512"), ("c", "bad", "soon"), ("c", "old", None)]
    table = spark.createDataFrame(rows, "corp_code string, rcept_no string, rcept_dt string")
    page = lambda n: [r.rcept_no for r in filings.filing_list(table, "c", "20260511", "20260513", page_no=n, page_count=4).collect()]
    assert (page(1), page(2), page(3)) == (["r7", "r6", "r5", "r4"], ["r3", "r2"], [])


def test_rules_as_tables(spark):
    table = rules.rule_frame(spark, rules.VAGUE_SOURCE, "vague_source").unionByName(rules.rule_frame(spark, [("zz+", "no zz")], "mine"))
    assert [p for p, _ in rules.rules_of(table, "vague_source")] == list(rules.VAGUE_SOURCE)
    docs = spark.createDataFrame([(1, "a zzz b"), (2, "a")], "doc_id int, text string")
    assert [tuple(r) for r in validate.failure_markers(docs, rules.rules_of(table, "mine")).collect()] == [(1, 0, "no zz")]
    try:
        rules.rules_of(table, "vague_source", most=1)
    except ValueError as error:
        assert "vague_source" in str(error)
    else:
        raise AssertionError
    hits = spark.createDataFrame([("a", 1), ("b", 2)], "ticker string, rank int")
    assert [r.rank for r in triggers.hits_for_ticker(hits, "b").collect()] == [2]


def test_statements(spark):
    import pytest

    item = '{"status": "000", "list": [{"account_id": "a", "thstrm_amount": "1"}, {"account_id": "b"}]}'
    rows = [("c", "CFS", item), ("c", "OFS", item.replace('"a"', '"z"')), ("d", "CFS", '{"status": "013", "message": "none"}'), ("d", "OFS", item), ("e", "CFS", None)]
    docs = spark.createDataFrame(rows, "corp string, fs_div string, text string")
    found, refused = answers.statements(docs)
    assert sorted((r.corp, r.nth, r.account_id) for r in found.collect()) == [("c", 0, "a"), ("c", 1, "b")]
    assert sorted((r.corp, r.reason) for r in refused.collect()) == [("d", "013 none"), ("e", "no JSON")]
    assert {(r.corp, r.account_id) for r in answers.statements(docs, "OFS")[0].collect()} == {("c", "z"), ("c", "b"), ("d", "a"), ("d", "b")}
    with pytest.raises(ValueError):
        answers.statements(docs, "X")


def test_sections_of_a_text(spark):
    aliases = [("one", ("Alpha", "Beta")), ("two", ("Gamma",)), ("three", ("none",))]
    docs = spark.createDataFrame([(1, "x Beta b\nII. next\nGamma g Alpha a"), (2, None), (3, "nothing"), (1, "Beta")], "doc_id int, text string")
    rows = sorted((r.doc_id, r.section_key, r.alias, r.body) for r in validate.sections_of(docs, aliases).collect())
    assert rows == [(1, "one", "Alpha", "Alpha a"), (1, "one", "Beta", "Beta"), (1, "two", "Gamma", "Gamma g Alpha a")]
    plan = validate.sections_of(docs, aliases)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_joined_sections(spark):
    from ledgerline.operators import report

    rows = [(1, "a", "f2", "second"), (1, "a", "f1", "first"), (1, "a", "f3", None), (1, "b", "f1", "x" * 50), (1, "b", "f2", "never seen"), (2, "a", "f1", ""), (None, "a", "f1", "y" * 10)]
    frame = spark.createDataFrame(rows, "doc_id int, section_key string, path string, text string")
    found = {(r.doc_id, r.section_key): r.text for r in report.joined_sections(frame, most=45).collect()}
    assert found == {(1, "a"): "first\n\n--- 다음 본문 조각 ---\n\nsecond", (1, "b"): "x" * 45 + "\n... [잘림]", (None, "a"): "y" * 10}
    cut = {(r.doc_id, r.section_key): r.text for r in report.joined_sections(frame, most=7).collect()}
    assert cut[1, "a"] == "first\n\n\n... [잘림]"
