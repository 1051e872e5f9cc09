"""Queries on work selection and dashboards."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dashboard, planner
from ..rules import PERIODS, period_frame
from .registry import query
from .tables import SQL_WATCHLIST, read, watchlist

AS_OF = date(2026, 9, 1)
_VALUES = ", ".join(f"({i}, '{label}', DATE '{deadline}')" for i, (label, _, _, deadline) in enumerate(PERIODS))
SQL_PERIODS = f"periods AS (SELECT * FROM (VALUES {_VALUES}) AS v(period_ord, period_label, filing_deadline))"
# Reports: of each nation and period k, the cents that the customers with c_custkey % 6 = k hold decide: no report if they
# divide by 3 or all the nation's divide by 5, a failed one if they divide by 5.
SQL_REPORTS = """cents AS (SELECT c_nationkey AS ticker, period_label, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) * 100 AS BIGINT) AS c FROM customer JOIN periods ON c_custkey % 6 = period_ord GROUP BY 1, 2),
reports AS (SELECT ticker, period_label, c % 5 = 0 AS failed FROM (SELECT *, sum(c) OVER (PARTITION BY ticker) AS whole FROM cents) WHERE c % 3 <> 0 AND whole % 5 <> 0),
usable AS (SELECT DISTINCT ticker, period_label FROM reports WHERE NOT failed), skipped AS (SELECT DISTINCT c_nationkey AS ticker, '2025-annual' AS period_label FROM customer WHERE c_nationkey % 7 = 6)"""
SQL_HEAD = f"WITH {SQL_WATCHLIST}, {SQL_PERIODS}, {SQL_REPORTS}"


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = period_frame(spark).select(F.col("period_ord").cast("long").alias("k"), "period_label")
    held = read(spark, sf_dir, "customer").join(periods, F.col("c_custkey") % 6 == F.col("k")).groupBy(F.col("c_nationkey").alias("ticker"), "period_label").agg((F.sum(F.col("c_acctbal").cast("decimal(18,2)")) * 100).cast("bigint").alias("c"))
    held = held.withColumn("whole", F.sum("c").over(Window.partitionBy("ticker")))  # six periods at most
    return held.where("c % 3 <> 0 and whole % 5 <> 0").select("ticker", "period_label", (F.col("c") % 5 == 0).alias("failed"))


def _usable(spark, sf_dir):
    return _reports(spark, sf_dir).where("not failed").select("ticker", "period_label").distinct()


def _skipped(spark, sf_dir):
    return read(spark, sf_dir, "customer").where("c_nationkey % 7 = 6").select(F.col("c_nationkey").alias("ticker"), F.lit("2025-annual").alias("period_label")).distinct()


SQL_OPEN = f"""{SQL_HEAD}, todo AS (SELECT w.ord, w.ticker, p.period_ord, p.period_label FROM watchlist w CROSS JOIN periods p WHERE p.filing_deadline <= DATE '2026-09-01'
  AND NOT EXISTS (SELECT 1 FROM usable u WHERE u.ticker = w.ticker AND u.period_label = p.period_label) AND NOT EXISTS (SELECT 1 FROM skipped s WHERE s.ticker = w.ticker AND s.period_label = p.period_label))"""


@query(SQL_OPEN + " SELECT * FROM todo")
def open_work(spark, sf_dir):
    return planner.open_work(period_frame(spark), watchlist(spark, sf_dir), _usable(spark, sf_dir), _skipped(spark, sf_dir), AS_OF)


@query(SQL_OPEN + " SELECT * FROM todo ORDER BY period_ord, ord LIMIT 1")
def next_work_antijoin(spark, sf_dir):
    return planner.next_work(period_frame(spark), watchlist(spark, sf_dir), _usable(spark, sf_dir), _skipped(spark, sf_dir), AS_OF)


@query(SQL_HEAD + " SELECT ticker, name FROM watchlist w WHERE NOT EXISTS (SELECT 1 FROM usable u WHERE u.ticker = w.ticker) ORDER BY ord LIMIT 1")
def next_ticker(spark, sf_dir):
    return planner.next_ticker(watchlist(spark, sf_dir), _usable(spark, sf_dir)).select("ticker", "name")


SQL_SECTORS = f"""WITH {SQL_WATCHLIST}, history AS (SELECT DISTINCT r_name AS sector, '2025-W' || lpad(CAST(10 + r_regionkey AS VARCHAR), 2, '0') AS iso_week FROM region WHERE r_regionkey <> 2),
disclosures AS (SELECT r_name AS sector, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderpriority = '1-URGENT' GROUP BY r_name),
s AS (SELECT w.sector, count(*) AS members, min(w.ord) AS ord FROM watchlist w GROUP BY w.sector HAVING count(*) >= 2),
j AS (SELECT s.*, CASE WHEN last_week IS NULL THEN 999 ELSE CAST(floor(date_diff('day', DATE '2025-03-03' + 7 * (CAST(substr(last_week, 7) AS INTEGER) - 10), DATE '2025-06-02') / 7.0) AS INTEGER) END AS weeks_since, coalesce(n, 0) AS n
  FROM s LEFT JOIN (SELECT sector, max(iso_week) AS last_week FROM history GROUP BY sector) h ON s.sector = h.sector LEFT JOIN disclosures d ON s.sector = d.sector)
SELECT sector, members, weeks_since, n, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, weeks_since + 2 * n AS score, row_number() OVER (ORDER BY weeks_since + 2 * n DESC, ord) AS rank FROM j)"""


def _sectors(spark, sf_dir):
    region = read(spark, sf_dir, "region")
    history = region.where("r_regionkey <> 2").select(F.col("r_name").alias("sector"), F.format_string("2025-W%02d", F.col("r_regionkey") + 10).alias("iso_week"))
    nation = watchlist(spark, sf_dir).select(F.col("ticker").alias("c_nationkey"), "sector")
    urgent = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    disclosures = urgent.join(read(spark, sf_dir, "customer"), "c_custkey").join(nation, "c_nationkey").groupBy("sector").agg(F.count("*").alias("n"))
    return planner.sector_scores(watchlist(spark, sf_dir), history, disclosures, "2025-W23").select("sector", "members", "weeks_since", "n", "score", "rank")


@query(SQL_SECTORS)
def sector_scores(spark, sf_dir):
    return _sectors(spark, sf_dir)


@query(f"SELECT * FROM ({SQL_SECTORS}) WHERE rank = 1")
def sector_pick(spark, sf_dir):
    return _sectors(spark, sf_dir).where("rank = 1")


@query(f"WITH {SQL_WATCHLIST}, m AS (SELECT s_nationkey AS ticker, count(*) AS suppliers FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1) SELECT w.ticker, w.name, m.suppliers, m.ticker IS NOT NULL AS available FROM watchlist w LEFT JOIN m ON w.ticker = m.ticker WHERE sector = 'ASIA'")
def sector_compare_left(spark, sf_dir):
    snapshots = read(spark, sf_dir, "supplier").where("s_nationkey % 3 <> 0").groupBy(F.col("s_nationkey").alias("ticker")).agg(F.count("*").alias("suppliers"))
    return planner.sector_comparison(watchlist(spark, sf_dir), snapshots, "ASIA").select("ticker", "name", "suppliers", "available")


@query(f"""{SQL_HEAD}, d AS (SELECT period_label, count(*) AS done FROM (SELECT DISTINCT u.ticker, period_label FROM usable u JOIN watchlist w ON u.ticker = w.ticker) GROUP BY 1), t AS (SELECT count(*) AS total FROM watchlist)
SELECT period_ord, p.period_label, coalesce(done, 0) AS done, total, coalesce(done, 0) * 100.0 / total AS pct,
CASE WHEN filing_deadline > DATE '2026-09-01' THEN '대기' WHEN coalesce(done, 0) = total THEN '완성' WHEN coalesce(done, 0) = 0 THEN '진행X' ELSE '진행중' END AS status FROM periods p LEFT JOIN d ON p.period_label = d.period_label CROSS JOIN t""")
def period_completion(spark, sf_dir):
    return dashboard.period_completion(period_frame(spark), watchlist(spark, sf_dir), _usable(spark, sf_dir), AS_OF)


SQL_COUNTED = f"{SQL_HEAD}, r AS (SELECT ticker, period_label FROM reports)"


@query(f"{SQL_COUNTED}, n AS (SELECT ticker, count(*) AS reports FROM r GROUP BY 1) SELECT count(*) AS total, count(reports) AS with_reports, CAST(coalesce(sum(reports), 0) AS BIGINT) AS reports_total, count(DISTINCT sector) AS sectors FROM watchlist w LEFT JOIN n ON w.ticker = n.ticker")
def dashboard_counts(spark, sf_dir):
    return dashboard.totals(watchlist(spark, sf_dir), _reports(spark, sf_dir))


@query(f"{SQL_COUNTED}, n AS (SELECT DISTINCT ticker, 1 AS has FROM r) SELECT sector, count(*) AS n, count(has) AS with_reports, min(ord) AS first_ord FROM watchlist w LEFT JOIN n ON w.ticker = n.ticker GROUP BY sector")
def sector_pills(spark, sf_dir):
    return dashboard.sector_pills(watchlist(spark, sf_dir), _reports(spark, sf_dir))


@query(f"{SQL_COUNTED} SELECT ticker, count(*) AS reports, max(period_label) AS latest_period FROM r GROUP BY ticker")
def company_latest(spark, sf_dir):
    return dashboard.company_latest(_reports(spark, sf_dir))


@query(f"""{SQL_COUNTED}, n AS (SELECT ticker, count(*) AS reports, max(period_label) AS latest_period FROM r GROUP BY 1),
m AS (SELECT s_nationkey AS ticker, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS market_cap FROM supplier GROUP BY 1), f AS (SELECT c_nationkey AS ticker, count(*) AS holders FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1)
SELECT w.ticker, w.sector, coalesce(reports, 0) AS reports, latest_period, market_cap, holders, CASE WHEN market_cap IS NOT NULL THEN least(market_cap / nullif(max(market_cap) OVER (), 0) * 100, 100.0) END AS cap_bar
FROM watchlist w LEFT JOIN n ON w.ticker = n.ticker LEFT JOIN m ON w.ticker = m.ticker LEFT JOIN f ON w.ticker = f.ticker""")
def dashboard_join(spark, sf_dir):
    market = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("ticker")).agg(F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double").alias("market_cap"))
    foreign = read(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").alias("ticker")).agg(F.count("*").alias("holders"))
    out = dashboard.dashboard(watchlist(spark, sf_dir), _reports(spark, sf_dir), market, foreign)
    return out.select("ticker", "sector", "reports", "latest_period", "market_cap", "holders", F.when(F.col("market_cap").isNotNull(), F.col("cap_bar")).alias("cap_bar"))


SQL_FILES = """src AS (SELECT l_orderkey AS name, max(l_shipdate) AS modified FROM lineitem GROUP BY 1), tgt AS (SELECT o_orderkey AS name, o_orderdate + INTERVAL 90 DAY AS modified FROM orders WHERE o_orderkey % 5 <> 0)"""


def _files(spark, sf_dir):
    source = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.max("l_shipdate").alias("modified"))
    target = read(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("name"), (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("modified"))
    return source, target


@query(f"WITH {SQL_FILES} SELECT s.name FROM src s LEFT JOIN tgt t ON s.name = t.name WHERE t.name IS NULL OR s.modified > t.modified")
def rerender_antijoin(spark, sf_dir):
    return planner.to_render(*_files(spark, sf_dir)).select("name")


@query(f"WITH {SQL_FILES} SELECT t.name FROM tgt t WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.name = t.name AND s.name % 4 <> 1)")
def stale_cleanup(spark, sf_dir):
    source, target = _files(spark, sf_dir)
    return planner.stale(target, source.where("name % 4 <> 1")).select("name")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE s_acctbal > 0) AS ok, count(*) FILTER (WHERE NOT s_acctbal > 0) AS fail FROM supplier")
def refresh_tally(spark, sf_dir):
    return dashboard.refresh_tally(read(spark, sf_dir, "supplier").select((F.col("s_acctbal") > 0).alias("ok")))
