"""What a review of larger tables found: rows that differed from SQL, and forms whose cost grew too fast."""

from __future__ import annotations

import os
import random
from datetime import datetime

import duckdb
import pyarrow as pa
import pytest

from ledgerline.plans import queries as _registered  # noqa: F401
from ledgerline.functions.text import lines
from ledgerline.operators import facts as ops
from ledgerline.operators import validate
from ledgerline.plans import written
from ledgerline.plans.registry import ORACLES, QUERIES
from ledgerline.sources import filing_pages, markup, sinks, tables

from .compare import assert_same
from .test_sources import XBRL


def _tables(spark, tmp_path, **frames):
    """A folder of the given tables and a connection to them."""
    connection = duckdb.connect()
    for name, frame in frames.items():
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'").fetchall()
    return str(tmp_path), connection


def test_ages_of_fractions_of_a_second(spark, tmp_path):
    at = [datetime(2024, 1, 19, 0, 0, 0, 400_000), datetime(2024, 1, 19, 0, 0, 0), datetime(2024, 1, 19, 0, 0, 1), datetime(2024, 1, 19, 0, 0, 1, 600_000), datetime(2024, 1, 18, 23, 59, 59, 900_000)]
    events = spark.createDataFrame([(7, i, t) for i, t in enumerate(at)], "user_id long, event_id long, ts timestamp_ntz")
    folder, connection = _tables(spark, tmp_path, events=events)
    assert assert_same(QUERIES["cache_fresh"](spark, folder), connection, ORACLES["cache_fresh"]) == 2


def test_small_xbrl_files_share_batches(spark):
    files = pa.RecordBatch.from_pylist([{"path": str(i), "content": XBRL.encode()} for i in range(30)])
    found = list(markup._xbrl(iter([files, files])))
    assert len(found) == 1 and found[0].num_rows == 60 * len(list(markup._xbrl_rows("i", XBRL.encode())))
    facts = markup.xbrl_facts(markup.xbrl_elements(spark.createDataFrame([("a", XBRL.encode())], "path string, content binary")))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan  # files are parsed once


def test_the_first_context_of_an_id_counts(spark):
    context = lambda end: f'<xbrli:context id="c1"><xbrli:period><xbrli:instant>{end}</xbrli:instant></xbrli:period></xbrli:context>'
    twice = XBRL.replace('<xbrli:unit id="KRW">', context("2030-12-31") + context("2020-12-31") + '<xbrli:unit id="KRW">')
    files = spark.createDataFrame([("a", XBRL.encode()), ("b", twice.encode())], "path string, content binary")
    rows = {(r.path, r.concept): r for r in markup.xbrl_facts(markup.xbrl_elements(files)).collect()}
    assert [rows[p, "ifrs-full:Assets"].period_end for p in "ab"] == ["2025-12-31", "2020-12-31"]
    assert len(rows["b", "ifrs-full:Assets"].dimensions) == 0 and (rows["a", "ifrs-full:Lost"].period_type, rows["a", "ifrs-full:Lost"].dimensions) == ("?", [])


def test_cells_of_scraped_tables():
    page = """<table class=other><tr><td>no</td></tr></table><TABLE id="x" class='a type2'><tr><th>h</th><td> 1&amp;2 <b>3</b> </td><td/><td>x<!-- c --> y</td></tr>
    <tr><td><table><tr><td>in</td></tr></table></td><td title="a > b">z</td></tr></table><tr><td>after</td></tr><table data-class="type2"><tr><td>n</td></tr></table>"""
    assert markup._cells(page) == [["1&23", "", "xy"], [""], ["in", "z"]] and markup._cells("") == []


def test_small_items_are_dealt_out(spark, sf_dir):
    for name in ("scraped_pages", "xbrl_scan"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobinPartitioning" in plan[plan.index("MapInArrow") :]


def test_files_are_written_by_their_tasks(spark, tmp_path):
    rows = [("1", "A", "20250101", "20251231", None, None, "r", f"{n:02}", None, "20250101", None) for n in range(5)] + [("가/=", None, "", "20251231", None, None, "r", "9", None, "20250101", None)]
    names = "corp_code string, pblntf_ty string, bgn_de string, end_de string, corp_name string, stock_code string, report_nm string, rcept_no string, flr_nm string, rcept_dt string, rm string"
    folder = str(tmp_path / "pages")
    filing_pages.store_pages(spark.createDataFrame(rows, names), folder, page_count=3)
    assert sorted(f for _, _, files in os.walk(folder) for f in files) == ["answer.json"] * 3  # no list of files is put in place by the driver
    found = filing_pages.filing_pages(spark, folder).collect()
    assert sorted((r.corp_code, r.pblntf_ty or "", r.page_no, r.rcept_no) for r in found) == [("1", "A", 1, "02"), ("1", "A", 1, "03"), ("1", "A", 1, "04"), ("1", "A", 2, "00"), ("1", "A", 2, "01"), ("가/=", "", 1, "9")]
    with pytest.raises(ValueError):
        filing_pages.store_pages(spark.createDataFrame(rows, names), folder)


def test_a_file_for_each_text(spark, tmp_path):
    folder, found = written._in_files(spark.createDataFrame([(3, "a\nb\r\n"), (12, "글"), (4, "")], "key long, text string"), "texts")
    assert {r.key: r.text for r in found.collect() if r.text} == {3: "a\nb\r\n", 12: "글"}
    assert sorted(os.listdir(folder.removeprefix("file:"))) == ["12.md", "3.md", "4.md"]
    sinks.write_files(spark.createDataFrame([("x/y.txt", "t")], "name string, text string"), str(tmp_path / "new"))
    assert [r.text for r in tables.whole_texts(spark, str(tmp_path / "new" / "x")).collect()] == ["t"]


TABLED = ["| a | b |\n|---|---|\n| x | 1 |\n| y | 2 |\n| 합계 | 9 |", "t\n| q |\n| a | 비중 |\n|:--|--|\n| x | 50 |\n| y | 40 | 7 |\n| z | 1 |\n|---|\n\n| n |\n|---|---|\nend", "|---|---|\n|---|\n| v |", "", None, "| lone |\n"]


def test_tables_of_whole_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TABLED)), "doc_id int, text string")
    by_text = validate.tables_of(docs)
    as_rows = lambda frame: sorted(map(tuple, frame.select("doc_id", "table_line", "line_no", "row_ord", "col_ord", "cell").collect()))
    assert as_rows(by_text) == as_rows(validate.markdown_tables(lines(docs))) and by_text.count() > 20
    assert "Exchange" not in by_text._jdf.queryExecution().executedPlan().toString()  # no sort of lines that a task must hold
    found = validate.table_arithmetic(by_text)
    assert sorted((r.doc_id, r.table_line, r.col_ord, r.category, r.actual, r.expected) for r in found.collect()) == [(0, 1, 1, "table_sum_mismatch", 3.0, 9.0), (1, 3, 1, "percentage_sum_off", 91.0, None)]
    plan = validate.table_arithmetic(validate.tables_of(docs.repartition("doc_id")))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # the cells are made once


def test_claims_meet_facts_once(spark):
    random.seed(3)
    facts = [(s, random.choice((-1, 1)) * 10 ** random.uniform(-1, 6)) for s in range(4) for _ in range(40)] + [(0, 0.0), (0, None), (1, -0.4)]
    factors = (1, 1.009, 1.0101, 0.985, -1.02, -1.031, 10.1, 0.099, 0.102, 3)
    claims = [(i, s, f * factors[i % len(factors)] if f is not None else None, i % 7 == 0) for i, (s, f) in enumerate(facts * 3)] + [(9000, 0, 0.9, False), (9001, 1, 0.5, None), (9002, 9, 5.0, False)]
    found = ops.check_claims(spark.createDataFrame(claims, "claim_id long, scope int, claim double, is_in_inference boolean"), spark.createDataFrame(facts, "scope int, fact double"), ["scope"])

    def status(scope, claim, inferred):
        own = [f for s, f in facts if s == scope and f is not None]
        near = lambda f, t, tolerance: abs(f - t) <= max(abs(t) * tolerance, 1.0)
        if inferred:
            return "skipped"
        if claim is not None and any(near(f, claim, 0.01) for f in own):
            return "ok"
        if claim is not None and any(near(abs(f), abs(claim), 0.03) for f in own):
            return "numeric_abs_or_rounded_match"
        scaled = claim is not None and any(near(abs(f), abs(claim) * k, 0.02) for f in own for k in (10.0, 0.1))
        return "numeric_scale_mismatch" if scaled else "numeric_unverified"

    want = {i: status(s, c, x) for i, s, c, x in claims}
    assert {r.claim_id: r.status for r in found.collect()} == want and len(set(want.values())) == 5
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # of claims with facts, and of the outcome with the claims


def test_lines_meet_facts_without_being_made_again(spark, sf_dir):
    plan = QUERIES["authoritative_consistency"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # the windows need no further one
