"""Paged lists, archives, caches and stateful streams on synthetic files."""

from __future__ import annotations

import io
import json
import shutil
import time
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import archives, cache, filing_pages, markup, tables, versions
from ledgerline.streaming import feeds, state

from .test_sources import XBRL


def _answer(folder, items, status="000", total=1, text=None):
    folder.mkdir(parents=True)
    (folder / "part-0.json").write_text(text if text is not None else json.dumps({"status": status, "message": "m", "total_page": total, "list": items}))


def _item(n, day="20250301"):
    return {"rcept_no": str(n), "rcept_dt": day, "report_nm": "r", "stock_code": 5}


@pytest.fixture
def listing(tmp_path):
    request = lambda corp, kind, year, page: tmp_path / f"corp_code={corp}" / f"pblntf_ty={kind}" / f"bgn_de={year}0101" / f"end_de={year}1231" / f"page_no={page}"
    _answer(request("1", "A", 2024, 1), [_item(1, "20240105"), _item(2, "20240601")], total=2)
    _answer(request("1", "A", 2024, 2), [_item(3, "20241231")], total=2)
    _answer(request("1", "A", 2025, 1), [_item(4, "20250101")])
    _answer(request("1", "B", 2025, 1), [], status="013")
    _answer(request("2", "A", 2025, 1), [_item(5), _item(6)], total=4)
    _answer(request("2", "A", 2025, 3), [_item(7)], total=4)
    _answer(request("3", "A", 2025, 1), [], text="<html>")
    return tmp_path


def test_filing_pages(spark, listing):
    rows = filing_pages.filing_pages(spark, str(listing)).collect()
    assert sorted((r.corp_code, r.page_no, r.nth, r.rcept_no) for r in rows if not r.reason) == [("1", 1, 0, "1"), ("1", 1, 0, "4"), ("1", 1, 1, "2"), ("1", 2, 0, "3"), ("2", 1, 0, "5"), ("2", 1, 1, "6"), ("2", 3, 0, "7")]
    assert sorted((r.corp_code, r.pblntf_ty, r.reason) for r in rows if r.reason) == [("1", "B", "013 m"), ("2", "A", "pages 2 to 2 are missing"), ("2", "A", "pages 4 to 4 are missing"), ("3", "A", "no JSON")]
    assert {r.stock_code for r in rows if not r.reason} == {"5"}


def test_filters_choose_the_pages_that_are_read(spark, listing):
    found = filing_pages.filing_pages(spark, str(listing)).where("corp_code = '1' and pblntf_ty = 'A' and rcept_dt >= '20240602'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    left = next(line for line in plan.splitlines() if "Filter " in line)
    assert "rcept_dt" in left and "= 1" not in left and "= A" not in left  # what whole folders answer isn't checked again
    shutil.rmtree(listing / "corp_code=2")  # folders of other corps, kinds and years aren't opened
    (listing / "corp_code=1" / "pblntf_ty=B" / "bgn_de=2025x").mkdir()
    (listing / "corp_code=1" / "pblntf_ty=B" / "bgn_de=2025x" / "end_de=x").mkdir()
    (listing / "corp_code=1" / "pblntf_ty=B" / "bgn_de=2025x" / "end_de=x" / "page_no=broken").mkdir()
    assert sorted(r.rcept_no for r in found.collect()) == ["3", "4"]
    reader = filing_pages.PageReader(f"file://{listing}", 1)
    column = ("corp_code",), ("pblntf_ty",), ("rcept_dt",)
    left = list(reader.pushFilters([filing_pages.EqualTo(column[0], "1"), filing_pages.In(column[1], ("A", "C")), filing_pages.GreaterThan(column[2], "20250101"), filing_pages.EqualTo(("report_nm",), "r")]))
    assert [f.attribute[0] for f in left] == ["rcept_dt", "report_nm"]
    assert [p.folder.split("bgn_de=")[1][:4] for p in reader.listed()] == ["2025"] and len(reader.partitions()) == 1
    assert filing_pages.filing_pages(spark, str(listing)).where("corp_code = 'none'").count() == 0


def test_stored_pages_come_back(spark, tmp_path):
    rows = [("1", "A", "20250101", "20251231", None, None, "r", f"{n:02}", None, f"2025010{n % 3 + 1}", None) for n in range(7)]
    names = "corp_code string, pblntf_ty string, bgn_de string, end_de string, corp_name string, stock_code string, report_nm string, rcept_no string, flr_nm string, rcept_dt string, rm string"
    filing_pages.store_pages(spark.createDataFrame(rows, names), str(tmp_path / "pages"), page_count=3)
    found = filing_pages.filing_pages(spark, str(tmp_path / "pages"), pages=2).collect()
    newest = sorted(rows, key=lambda r: (r[9], r[7]), reverse=True)
    assert [(r.page_no, r.nth, r.rcept_no) for r in sorted(found, key=lambda r: (r.page_no, r.nth))] == [(i // 3 + 1, i % 3, r[7]) for i, r in enumerate(newest)]


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


def test_archives(spark):
    korean = "보고서.xml".encode("euc-kr").decode("cp437")
    broken = bytearray(_zip(**{"a.txt": b"first member", "b.txt": b"second member"}))
    broken[broken.index(b"first")] ^= 1
    files = [("1.zip", _zip(**{korean: b"<p>text</p>", "sub/": b"", "é.txt": "글".encode(), "i.xbrl": XBRL.encode(), "s.xsd": b"<x/>"})), ("2.zip", b'{"status":"013"}'), ("3.zip", bytes(broken)), ("4.zip", b"PK\x03\x04cut"), ("5.zip", None), ("6.zip", _zip())]
    frame = spark.createDataFrame(files, "path string, content binary")
    rows = archives.members(frame).collect()
    assert [(r.member, r.nth, r.n_bytes) for r in rows if r.path == "1.zip"][:2] == [("보고서.xml", 0, 11), ("é.txt", 1, 3)]
    assert [(r.member, bytes(r.content)) for r in rows if r.path == "3.zip" and not r.reason] == [("b.txt", b"second member")]
    assert {(r.path, r.member): r.reason.split(":")[0] for r in rows if r.reason} == {("2.zip", None): "not ZIP", ("3.zip", "a.txt"): "broken member", ("4.zip", None): "broken ZIP", ("5.zip", None): "not ZIP"}
    texts, _ = markup.filing_texts(archives.document_files(frame)[0])
    assert {r.path: r.text for r in texts.collect() if r.path.startswith("1.zip")}["1.zip!보고서.xml"] == "text"
    package, lost = archives.xbrl_files(frame)
    assert {r.concept for r in markup.xbrl_facts(markup.xbrl_elements(package.where("path like '%xbrl'"))).collect()} == {"ifrs-full:Assets", "ifrs-full:Revenue", "ifrs-full:Lost"}
    assert {r.path: r.reason for r in lost.collect()}["2.zip"] == "no XBRL"


def test_corp_code_archives(spark):
    one = "<list><corp_code>{}</corp_code><corp_name>n</corp_name><stock_code>{}</stock_code><modify_date>1</modify_date></list>"
    codes = f"<?xml version='1.0' encoding='UTF-8'?><result>{one.format('00126380', '005930')}{one.format('1', ' ')}</result>"
    frame = spark.createDataFrame([("a.zip", _zip(**{"CORPCODE.xml": codes.encode()})), ("b.zip", _zip(**{"x": b""})), ("c.zip", b"{}")], "path string, content binary")
    rows, lost = archives.corp_code_rows(frame)
    assert [tuple(r) for r in tables.last_codes(rows).collect()] == [("005930", "00126380")]
    assert {r.path: r.reason for r in lost.collect()} == {"b.zip": "no CORPCODE.xml", "c.zip": "not ZIP"}


def test_cache_refetches_stale_keys_only(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "ticker string, v int").schema
    kept = cache.Cache(str(tmp_path / "c"), rows, ttl_hours=6)
    asked = []

    def fetch(n):
        def brought(keys):
            asked.append(sorted(r.ticker for r in keys.collect()))
            return keys.select("ticker", F.explode(F.array(F.lit(n), F.lit(n + 1))).alias("v")).where("ticker != 'none'").unionByName(spark.createDataFrame([("other", 9)], rows))

        return brought

    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "ticker string")
    served = lambda frame: sorted((r.ticker, r.v, r.fetched_at.hour) for r in frame.collect())
    at = lambda h: datetime(2026, 1, 1, h)
    assert served(cache.read_through(keys("a", "b", "a", None), kept, fetch(10), at(0))) == [("a", 10, 0), ("a", 11, 0), ("b", 10, 0), ("b", 11, 0)]
    assert served(cache.read_through(keys("b", "c", "none"), kept, fetch(20), at(4))) == [("b", 10, 0), ("b", 11, 0), ("c", 20, 4), ("c", 21, 4)]
    # a write that broke off is not seen, and its number is taken anew
    shutil.copytree(tmp_path / "c/rows/version=2", tmp_path / "c/rows/version=3")
    shutil.copytree(tmp_path / "c/manifest/version=2", tmp_path / "c/manifest/version=3")
    (tmp_path / "c/manifest/version=3/_SUCCESS").unlink()
    before = cache.cached(spark, kept)
    assert served(cache.read_through(keys("a", "c"), kept, fetch(30), at(6))) == [("a", 30, 6), ("a", 31, 6), ("c", 20, 4), ("c", 21, 4)]
    assert asked == [["a", "b"], ["c", "none"], ["a"]]
    assert served(before)[0] == ("a", 10, 0)  # a reader that began before the fetch still reads what it saw
    assert served(cache.read_through(keys("a"), kept, fetch(40), at(7))) == [("a", 30, 6), ("a", 31, 6)] and len(asked) == 3
    cache.read_through(keys("b"), kept, fetch(50), at(8))
    assert cache.superseded(spark, kept) == [1]
    cache.vacuum(spark, kept)
    assert served(cache.cached(spark, kept)) == [("a", 30, 6), ("a", 31, 6), ("b", 50, 8), ("b", 51, 8), ("c", 20, 4), ("c", 21, 4)]
    few = cache.Cache(str(tmp_path / "d"), rows, least_rows=3)
    assert len(served(cache.read_through(keys("a"), few, fetch(1), at(0)))) == 2 and len(served(cache.read_through(keys("a"), few, fetch(2), at(0)))) == 2
    assert asked[-2:] == [["a"], ["a"]]


def _files(spark, path, *batches, schema):
    path.mkdir(exist_ok=True)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_newest_rows_with_late_ones(spark, tmp_path):
    schema = "ticker string, dt date, v int"
    day = lambda n: date(2026, 1, n)
    batches = [[("a", day(9), 9), ("a", day(3), 3), ("b", day(1), 1)], [("a", day(5), 5), ("a", day(1), 1), ("a", None, 0)], [("a", day(9), 90), ("a", day(4), 4), ("a", day(8), 8)]]
    out = state.newest_rows(_files(spark, tmp_path / "in", *batches, schema=schema), 3)
    found = feeds.run_once(out, str(tmp_path / "out"), str(tmp_path / "state"), "update")
    assert sorted((r.ticker, r.v) for r in state.unpacked(found).collect()) == [("a", 5), ("a", 8), ("a", 90), ("b", 1)]
    assert max(len(r.newest) for r in found.collect()) == 3


def test_answers_expire(spark, tmp_path):
    schema = "ticker string"
    run = lambda ttl, *batches: sorted((r.version, r.ticker, r.asked, r.fetch) for r in feeds.run_once(state.to_fetch(_files(spark, tmp_path / "in", *batches, schema=schema), ttl), str(tmp_path / "out"), str(tmp_path / "state"), "update", empty_batches=False).collect())
    assert run(20_000, [("a",), ("a",)], [("a",)]) == [(0, "a", 2, True), (1, "a", 1, False)]
    time.sleep(21)
    assert run(20_000, [("a",), ("b",)])[2:] == [(2, "a", 1, True), (2, "b", 1, True)]


def test_polls_after_restart_and_replay(spark, tmp_path):
    poll = lambda n, *numbers: _answer(tmp_path / "polls" / f"poll={n}", [_item(x) for x in numbers])
    new = lambda: feeds.new_filings(filing_pages.filing_polls(spark, str(tmp_path / "polls")).where("reason is null"), time="polled_at").select("rcept_no")
    run = lambda: sorted(r.rcept_no for r in feeds.run_once(new(), str(tmp_path / "out"), str(tmp_path / "state")).collect())
    poll(1, 1, 2)
    poll(2, 2, 3)
    assert run() == ["1", "2", "3"]
    poll(3, 3, 4)
    _answer(tmp_path / "polls" / "poll=4", [], status="020")
    poll(10, 4, 5, 1)
    assert run() == ["1", "2", "3", "4", "5"]
    # the batch's rows were written, but its commit was lost: it is delivered again
    commits = sorted((tmp_path / "state/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last = commits[-1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == ["1", "2", "3", "4", "5"]


def test_a_batch_that_comes_twice_renders_once(spark, tmp_path):
    sources = spark.createDataFrame([("a", 2), ("b", 1), ("c", 5)], "name string, modified int")
    targets = spark.createDataFrame([("b", 1), ("c", 4)], "name string, modified int")
    runs = []

    def render(due):
        runs.append(1)
        return due.select("name", "modified")

    on_batch = feeds.render_changes(lambda: targets, render, str(tmp_path))
    on_batch(sources, 0)
    on_batch(sources, 0)
    on_batch(sources.where("name = 'a'").withColumn("modified", F.lit(7)), 1)
    assert len(runs) == 2
    (tmp_path / "version=1/_SUCCESS").unlink()  # broke off: not seen, and done anew
    assert sorted((r.name, r.modified) for r in feeds.rendered(spark, str(tmp_path), "name string, modified int").collect()) == [("a", 2), ("c", 5)]
    on_batch(sources.where("name = 'a'").withColumn("modified", F.lit(8)), 1)
    assert sorted((r.name, r.modified) for r in feeds.rendered(spark, str(tmp_path), "name string, modified int").collect()) == [("a", 8), ("c", 5)]
    assert versions.committed(spark, str(tmp_path)) == [0, 1]
