"""Queries on paged lists, archives, caches and stateful streams, all written from the driver's tables and read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filings as filing_ops
from ..operators import series, triggers
from ..sources import archives, cache, filing_pages, markup
from ..sources.folders import shared_folder, write_once
from ..sources.versions import read_versions
from ..streaming import feeds, state
from .registry import query
from .tables import REPORT_NAMES, SQL_BARS, SQL_FLOWS, bars, flows, read

PAGE_COUNT, PAGES_A_TASK = 100, 64
KINDS = {name: "ABCDE"[i] for i, name in enumerate(REPORT_NAMES)}


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings: the customer's nation is the corp, the priority the kind, a request is about a year."""
    kind = F.coalesce(*(F.when(F.col("o_orderpriority") == k, F.lit(v)) for k, v in KINDS.items()))
    name = F.when(F.quarter("o_orderdate") == 4, "사업보고서").when(F.quarter("o_orderdate") == 3, "반기보고서").otherwise("분기보고서")
    year = F.date_format("o_orderdate", "yyyy")
    corp = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("corp_code"))
    return read(spark, sf_dir, "orders").join(corp, "o_custkey").select(
        "corp_code", kind.alias("pblntf_ty"), F.concat(year, F.lit("0101")).alias("bgn_de"), F.concat(year, F.lit("1231")).alias("end_de"), F.lit(None).cast("string").alias("corp_name"),
        F.col("o_custkey").cast("string").alias("stock_code"), F.concat(name, F.date_format("o_orderdate", " (yyyy.MM)")).alias("report_nm"), F.lpad(F.col("o_orderkey").cast("string"), 14, "0").alias("rcept_no"),
        F.lit("제출인").alias("flr_nm"), F.date_format("o_orderdate", "yyyyMMdd").alias("rcept_dt"), F.lit("").alias("rm"),
    )


_KIND_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())
SQL_LISTED = f"""listed AS (SELECT CAST(c_nationkey AS VARCHAR) AS corp_code, CASE o_orderpriority {_KIND_CASES} END AS pblntf_ty, strftime(o_orderdate, '%Y') AS y, lpad(CAST(o_orderkey AS VARCHAR), 14, '0') AS rcept_no, strftime(o_orderdate, '%Y%m%d') AS rcept_dt,
  CASE quarter(o_orderdate) WHEN 4 THEN '사업보고서' WHEN 3 THEN '반기보고서' ELSE '분기보고서' END || strftime(o_orderdate, ' (%Y.%m)') AS report_nm FROM orders JOIN customer ON o_custkey = c_custkey),
paged AS (SELECT *, row_number() OVER (PARTITION BY corp_code, pblntf_ty, y ORDER BY rcept_dt DESC, rcept_no DESC) - 1 AS place FROM listed)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "answers")
    filing_pages.store_pages(_listed(spark, sf_dir), folder, PAGE_COUNT)
    return filing_pages.filing_pages(spark, folder, PAGES_A_TASK)


@query(f"WITH {SQL_LISTED} SELECT corp_code, pblntf_ty, CAST(place // 100 + 1 AS INTEGER) AS page_no, CAST(place % 100 AS INTEGER) AS nth, rcept_no, rcept_dt, report_nm, CAST(NULL AS VARCHAR) AS reason FROM paged")
def filing_pages_source(spark, sf_dir):
    return _pages(spark, sf_dir).select("corp_code", "pblntf_ty", "page_no", "nth", "rcept_no", "rcept_dt", "report_nm", "reason")


@query(f"""WITH {SQL_LISTED} SELECT corp_code, rcept_no, report_nm, CAST(row_number() OVER (PARTITION BY corp_code ORDER BY rcept_dt DESC, place) AS INTEGER) AS nth FROM paged
WHERE pblntf_ty = 'A' AND contains(report_nm, '분기보고서') AND contains(report_nm, '(1997.03)') AND rcept_dt BETWEEN '19970101' AND '19980630'""")
def periodic_reports_paged(spark, sf_dir):
    """A year's first-quarter reports by the list's pages: kind and days choose the folders that are read."""
    found = _pages(spark, sf_dir).where("pblntf_ty = 'A' and rcept_dt >= '19970101' and rcept_dt <= '19980630'")
    found = found.withColumn("ord", (F.col("page_no") - 1) * PAGE_COUNT + F.col("nth"))
    return filing_ops.periodic_reports(found, 1997, "11013").select("corp_code", "rcept_no", "report_nm", F.col("nth").cast("int").alias("nth"))


ARCHIVED = 40  # pages of an archive; every seventh answer is a refusal instead


def _archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").withColumn("archive", F.expr(f"page_id div {ARCHIVED}"))
    korean = F.concat(F.lit("문서_"), F.col("page_id").cast("string"), F.lit(".html"))
    document = pages.select("archive", korean.alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    note = pages.select("archive", F.concat(F.lit("notes/"), F.col("page_id").cast("string"), F.lit(".txt")).alias("name"), F.coalesce("url", F.lit("")).cast("binary").alias("content"))
    folder = shared_folder(spark, "archives")
    archives.write_archives(document.unionByName(note).where("archive % 7 <> 6"), folder).write.format("noop").mode("overwrite").save()
    refused = pages.where("archive % 7 = 6").select(F.concat(F.lit(f"{folder}/"), F.col("archive").cast("string"), F.lit(".zip")).alias("path"), F.lit('{"status":"013"}').cast("binary").alias("content")).distinct()
    stored = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path", "content") if not pages.where("archive % 7 <> 6").isEmpty() else refused.limit(0)
    return write_once(stored.unionByName(refused).withColumn("path", F.substring_index("path", "/", -1)), "fetched")


SQL_ARCHIVED = """a AS (SELECT *, page_id // 40 AS archive FROM pages),
m AS (SELECT archive, '문서_' || page_id || '.html' AS member, coalesce(html, '') AS content FROM a WHERE archive % 7 <> 6 UNION ALL SELECT archive, 'notes/' || page_id || '.txt', coalesce(url, '') FROM a WHERE archive % 7 <> 6)"""


@query(f"""WITH {SQL_ARCHIVED} SELECT archive || '.zip' AS path, member, CAST(strlen(content) AS BIGINT) AS n_bytes, md5(content) AS digest, CAST(NULL AS VARCHAR) AS reason FROM m
UNION ALL SELECT DISTINCT archive || '.zip', CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 'not ZIP' FROM a WHERE archive % 7 = 6""")
def filing_archives(spark, sf_dir):
    return archives.members(_archive_files(spark, sf_dir)).select("path", "member", "n_bytes", F.md5("content").alias("digest"), "reason")


@query(f"WITH {SQL_ARCHIVED} SELECT archive || '.zip!' || member AS path, content AS text FROM m WHERE member LIKE 'notes/%'")
def archived_note_texts(spark, sf_dir):
    """The notes among the archives' files, through the loader of filing texts."""
    files, _ = archives.document_files(_archive_files(spark, sf_dir))
    texts, _ = markup.filing_texts(files.where(F.endswith("path", F.lit(".txt"))))
    return texts.select("path", "text")


FETCHES = (datetime(2024, 1, 10), datetime(2024, 1, 11, 12), datetime(2024, 1, 12))
_T1, _T2, _T3 = (f"TIMESTAMP '{t}'" for t in FETCHES)


@query(f"""WITH e AS (SELECT user_id AS ticker, event_id, ts FROM events), fetched AS (SELECT ticker, count(*) AS n FROM e WHERE ts <= {_T2} AND ticker IN (SELECT ticker FROM e WHERE ts > {_T1} AND ts <= {_T2}) GROUP BY ticker)
SELECT e.ticker, event_id, CASE WHEN n >= 2 THEN {_T2} ELSE {_T3} END AS fetched_at FROM e LEFT JOIN fetched f ON e.ticker = f.ticker WHERE ts <= CASE WHEN n >= 2 THEN {_T2} ELSE {_T3} END""")
def cache_read_through(spark, sf_dir):
    """Three runs over one cache: users seen so far, users active since, all users. The last fetches only those that the
    second didn't, as what the first fetched is older than a day by then."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    kept = cache.Cache(shared_folder(spark, "cache"), rows.select("ticker", "event_id").schema, ttl_hours=24, least_rows=2)
    until = lambda t: rows.where(F.col("ts") <= F.lit(t))
    fetch = lambda t: lambda keys: until(t).join(keys, "ticker", "left_semi")
    first, second, third = FETCHES
    cache.read_through(until(first), kept, fetch(first), first)
    cache.read_through(until(second).where(F.col("ts") > F.lit(first)), kept, fetch(second), second)
    found = cache.read_through(rows, kept, fetch(third), third)
    return found.select("ticker", "event_id", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"))


def _as_stream(rows: DataFrame, name: str, files: int = 6, each: int = 2) -> DataFrame:
    """The rows as a stream of files in no order, ``each`` of them to a batch."""
    folder = shared_folder(rows.sparkSession, name)
    rows.repartition(files, F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")])).write.parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(folder)


def _newest(rows: DataFrame, n: int) -> DataFrame:
    spark = rows.sparkSession
    updates = state.newest_rows(_as_stream(rows, "rows"), n)
    return state.unpacked(feeds.run_once(updates, shared_folder(spark, "newest"), shared_folder(spark, "newest-state"), "update"))


@query(f"WITH {SQL_FLOWS} SELECT ticker, CAST(sum(net_krw) AS DOUBLE) AS cumulative, count(*) AS n FROM flows WHERE rn <= 5 GROUP BY ticker")
def stream_cumulative_flow_5row(spark, sf_dir):
    newest = _newest(flows(spark, sf_dir).select("ticker", "dt", "net_krw"), 5)
    return triggers.cumulative_flow(newest, 5).withColumn("cumulative", F.col("cumulative").cast("double"))


@query(f"""WITH {SQL_BARS} SELECT ticker, dt, close, prev_close, pct_change, (close / nullif(back, 0) - 1) * 100 AS pct_60 FROM (SELECT *, lag(close, 59) OVER (PARTITION BY ticker ORDER BY dt) AS back FROM moves) WHERE rn = 1""")
def stream_last_changes(spark, sf_dir):
    """The last bar's change against the bar before and the 60th newest, from a stream that keeps 60 bars of a ticker."""
    newest = _newest(bars(spark, sf_dir).select("ticker", "dt", "close"), 60)
    found = series.latest(series.change_over_rows(series.one_row_change(newest)))
    return found.select("ticker", "dt", "close", "prev_close", "pct_change", F.col("pct").alias("pct_60"))


@query("SELECT user_id AS ticker, count(*) AS asked, 1 AS fetches FROM events GROUP BY 1")
def stream_refetches(spark, sf_dir):
    """Requests by key against answers that are kept for a day: within one, each key is fetched once."""
    requests = _as_stream(read(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), "event_id"), "requests")
    found = feeds.run_once(state.to_fetch(requests, 24 * 3600 * 1000), shared_folder(spark, "fetches"), shared_folder(spark, "fetches-state"), "update", empty_batches=False)
    return found.groupBy("ticker").agg(F.sum("asked").alias("asked"), F.count_if("fetch").cast("int").alias("fetches"))


POLLS = 8


@query("SELECT lpad(CAST(o_orderkey AS VARCHAR), 14, '0') AS rcept_no, CAST(1 AS BIGINT) AS times FROM orders JOIN customer ON o_custkey = c_custkey")
def stream_polled_filings(spark, sf_dir):
    """Polls that each list what the one before did, too: the stream gives each filing once."""
    listed = _listed(spark, sf_dir).drop("pblntf_ty", "bgn_de", "end_de").withColumn("poll", F.pmod(F.xxhash64("rcept_no"), F.lit(POLLS)))
    listed = listed.withColumn("poll", F.explode(F.array("poll", F.col("poll") + 1))).withColumn("part", F.pmod(F.xxhash64("rcept_no", F.lit(1)), F.lit(16)))
    item = F.struct(*filing_pages.ITEM)
    page = listed.groupBy((F.col("poll") * 16 + F.col("part")).alias("poll")).agg(F.collect_list(item).alias("list"))
    folder = shared_folder(spark, "polls")
    page.select("poll", F.to_json(F.struct(F.lit("000").alias("status"), "list")).alias("value")).repartition("poll").write.partitionBy("poll").text(folder)
    new = feeds.new_filings(filing_pages.filing_polls(spark, folder).where("reason is null"), time="polled_at").select("rcept_no")
    found = feeds.run_once(new, shared_folder(spark, "polled"), shared_folder(spark, "polled-state"))
    return found.groupBy("rcept_no").agg(F.count("*").alias("times"))


@query("""WITH s AS (SELECT o_orderkey AS name, o_orderdate AS modified FROM orders), t AS (SELECT l_orderkey AS name, max(l_shipdate) AS modified FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT s.name, CAST(epoch(s.modified) AS BIGINT) AS modified, 'report ' || s.name AS page FROM s LEFT JOIN t ON s.name = t.name WHERE t.name IS NULL OR s.modified > t.modified""")
def stream_rendered(spark, sf_dir):
    """Changed sources as a stream whose batches are each rendered once, though every one is delivered twice."""
    sources = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("modified"))
    returned = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("name")).agg(F.unix_timestamp(F.max("l_shipdate").cast("timestamp")).alias("modified"))
    folder = shared_folder(spark, "rendered")
    page = lambda due: due.select("name", "modified", F.concat(F.lit("report "), F.col("name").cast("string")).alias("page"))
    on_batch = feeds.render_changes(lambda: returned, page, folder)

    def twice(batch: DataFrame, number: int) -> None:
        on_batch(batch, number)
        on_batch(batch, number)

    stream = _as_stream(sources, "sources")
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", shared_folder(spark, "rendered-state")).trigger(availableNow=True).start().awaitTermination()
    return read_versions(spark, folder, "name long, modified long, page string").drop("version")
