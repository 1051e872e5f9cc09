"""Queries on artefacts and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report, triggers
from ..sources.folders import shared_folder
from ..streaming import feeds
from . import market
from .registry import query
from .tables import read

_IDS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(report.SECTIONS))


@query(f"""WITH s AS (SELECT * FROM (VALUES {_IDS}) AS v(ord, section_id)), r AS (SELECT DISTINCT conv_id AS doc_id FROM conversations), t AS (SELECT conv_id AS doc_id, turn, any_value(text) AS text FROM conversations WHERE turn < 10 GROUP BY 1, 2)
SELECT r.doc_id, md5(string_agg('## ' || section_id || chr(10) || chr(10) || coalesce(text, '_(섹션 없음)_'), chr(10) || chr(10) ORDER BY ord)) AS bodies_md5, count(text) AS present
FROM r CROSS JOIN s LEFT JOIN t ON t.doc_id = r.doc_id AND t.turn = s.ord GROUP BY r.doc_id""")
def report_assembly(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").where("turn < 10")
    ids = F.array(*map(F.lit, report.SECTIONS))
    texts = turns.select(F.col("conv_id").alias("doc_id"), F.get(ids, F.col("turn").cast("int")).alias("section_id"), "text")
    whole = report.assembled(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct(), texts)
    bodies = F.substr("report", F.position(F.lit("## "), F.col("report")))
    return whole.select("doc_id", F.md5(bodies.cast("binary")).alias("bodies_md5"), "present")


@query(market.SQL_HITS + """, c AS (SELECT trigger_type, count(*) AS n, CASE trigger_type WHEN 'price_move' THEN 0 WHEN 'dart_disclosure' THEN 1 WHEN 'foreign_flow' THEN 2 ELSE 3 END AS o FROM hits GROUP BY 1)
SELECT string_agg(trigger_type || ' ' || n, ', ' ORDER BY o) AS summary FROM c""")
def daily_note_summary(spark, sf_dir):
    counts = triggers.counts_by_type(market._hits(spark, sf_dir))
    return counts.agg(report.joined(F.concat_ws(" ", "trigger_type", F.col("n").cast("string")), [F.col("display_ord")], ", ").alias("summary"))


SQL_TOP = """top AS (SELECT ticker, sum(score) AS total_score, min(rank) AS first_rank FROM ranked GROUP BY ticker ORDER BY 2 DESC, 3 LIMIT 3)"""


@query(market.SQL_HITS + f""", {SQL_TOP}, c AS (SELECT trigger_type, count(*) AS n, CASE trigger_type WHEN 'price_move' THEN 0 WHEN 'dart_disclosure' THEN 1 WHEN 'foreign_flow' THEN 2 ELSE 3 END AS o FROM hits GROUP BY 1),
cards AS (SELECT ticker, total_score, first_rank, '### ' || ticker || chr(10) || string_agg('- ' || trigger_type || ' ' || printf('%.2f', severity), chr(10) ORDER BY rank) AS card FROM ranked JOIN top USING (ticker) GROUP BY ticker, total_score, first_rank)
SELECT '# 2026-05-12' || chr(10) || chr(10) || '> **트리거**: ' || (SELECT string_agg(trigger_type || ' ' || n, ', ' ORDER BY o) FROM c) || chr(10) || chr(10) || (SELECT string_agg(card, chr(10) || chr(10) ORDER BY total_score DESC, first_rank) FROM cards) AS note""")
def daily_note(spark, sf_dir):
    hits = market._hits(spark, sf_dir)
    return report.daily_note("2026-05-12", hits, triggers.counts_by_type(hits), triggers.top_tickers(hits))


REPORT = "fetch_date string, should_publish boolean, tickers bigint, top array<struct<ticker:bigint,total_score:double>>, hits array<struct<rank:int,ticker:bigint,trigger_type:string,severity:double,score:double>>"


@query(market.SQL_HITS + f""", {SQL_TOP}, placed AS (SELECT ticker, row_number() OVER (ORDER BY total_score DESC, first_rank) AS place FROM top)
SELECT '2026-05-12' AS fetch_date, true AS should_publish, (SELECT count(DISTINCT ticker) FROM ranked) AS tickers, r.rank, r.ticker, trigger_type, round(severity, 6) AS severity, round(score, 6) AS score, coalesce(place, 0) AS top_place
FROM ranked r LEFT JOIN placed p ON r.ticker = p.ticker""")
def trigger_report_json(spark, sf_dir):
    """The report's JSON, read back: a row for each hit, with its ticker's place among the top ones (0 for none)."""
    hits = market._hits(spark, sf_dir)
    told = report.trigger_report("2026-05-12", hits, triggers.top_tickers(hits)).select(F.from_json("report", REPORT).alias("r"))
    rows = told.select("r.fetch_date", "r.should_publish", "r.tickers", F.transform("r.top", lambda t: t.ticker).alias("top"), F.explode("r.hits").alias("h"))
    return rows.select("fetch_date", "should_publish", "tickers", "h.rank", "h.ticker", "h.trigger_type", F.round("h.severity", 6).alias("severity"), F.round("h.score", 6).alias("score"), F.array_position("top", F.col("h.ticker")).alias("top_place"))


@query("""WITH e AS (SELECT event_type, ts, CAST(value AS DECIMAL(18,2)) AS v FROM events), w AS (SELECT event_type, date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS start, v FROM e CROSS JOIN range(0, 3) AS r(k))
SELECT event_type, CAST(start AS TIMESTAMP) AS start, CAST(sum(v) AS DOUBLE) AS total, count(*) AS n FROM w GROUP BY 1, 2""")
def stream_windowed_sums(spark, sf_dir):
    stream = feeds.files(spark, f"{sf_dir}/events.parquet*", read(spark, sf_dir, "events").schema).select("event_type", "ts", F.col("value").cast("decimal(18,2)").alias("value"))
    out = feeds.windowed_sums(stream, "event_type", "ts", "value", late="60 days")
    found = feeds.run_available(out, shared_folder(spark, "stream"), shared_folder(spark, "stream-state"))
    return found.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.col("total").cast("double").alias("total"), "n")


@query("SELECT DISTINCT user_id AS rcept_no FROM events")
def stream_new_filings(spark, sf_dir):
    schema = read(spark, sf_dir, "events").schema
    stream = feeds.files(spark, f"{sf_dir}/events.parquet*", schema).select(F.col("user_id").alias("rcept_no"), F.col("ts").alias("rcept_ts"))
    out = feeds.new_filings(stream, late="60 days").select("rcept_no")
    return feeds.run_available(out, shared_folder(spark, "stream"), shared_folder(spark, "stream-state"), "append")
