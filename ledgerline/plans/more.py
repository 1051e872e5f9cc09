"""Queries on joins of sources, caches and selections of facts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.dates import friendly_period
from ..functions.numbers import fact_decimals, lenient_int, lenient_pct, to_int
from ..operators import facts as fact_ops
from ..operators import filings as filing_ops
from ..operators import flows as flow_ops
from ..operators import report, series
from ..rules import CONSOLIDATED_AXIS, INDICATORS
from ..sources import markup, tables
from ..sources.folders import dealt
from .registry import query
from .tables import SQL_BARS, SQL_WATCHLIST, bars, read, watchlist

_HEAD = '<xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:ifrs="http://xbrl.ifrs.org/taxonomy/2021-03-24/ifrs-full"><xbrli:context id="c"><xbrli:period><xbrli:instant>2025-12-31</xbrli:instant></xbrli:period></xbrli:context>'


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, 'ifrs-full:Assets' AS concept, CAST(p_size AS DOUBLE) AS value, 'instant' AS period_type, '2025-12-31' AS period_end, -6 AS decimals FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'ifrs-full:Equity', CAST(p_partkey AS DOUBLE), '?', NULL, NULL FROM part""")
def xbrl_scan(spark, sf_dir):
    body = F.format_string(_HEAD + '<ifrs:Assets contextRef="c" decimals="-6"> %d </ifrs:Assets><ifrs:Equity contextRef="lost" decimals="INF">%d</ifrs:Equity><ifrs:Name contextRef="c">text</ifrs:Name></xbrli:xbrl>', "p_size", "p_partkey")
    files = dealt(read(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").cast("string").alias("path"), body.cast("binary").alias("content"))
    return markup.xbrl_facts(markup.xbrl_elements(files)).select("path", "concept", "value", "period_type", "period_end", "decimals")


@query(f"""WITH {SQL_BARS}, i AS (SELECT s_nationkey AS ticker, CAST(l_shipdate AS DATE) AS dt, sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS f, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) SELECT b.ticker, b.dt, close, CAST(f AS DOUBLE) AS foreign_net_krw, CAST(n AS DOUBLE) AS inst_net_krw FROM bars b JOIN i ON b.ticker = i.ticker AND b.dt = i.dt WHERE f IS NOT NULL""")
def flow_join(spark, sf_dir):
    seller = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("ticker"))
    who = F.when(F.col("l_returnflag") == "A", "외국인").when(F.col("l_returnflag") == "R", "기관합계").otherwise("개인")
    rows = read(spark, sf_dir, "lineitem").join(seller, "l_suppkey").select("ticker", F.to_date("l_shipdate").alias("dt"), who.alias("investor"), F.col("l_extendedprice").cast("decimal(18,2)").alias("net_krw"))
    out = flow_ops.join_flows(bars(spark, sf_dir), rows)
    return out.select("ticker", "dt", "close", F.col("foreign_net_krw").cast("double").alias("foreign_net_krw"), F.col("inst_net_krw").cast("double").alias("inst_net_krw"))


SQL_CODES = f"WITH {SQL_WATCHLIST}, m AS (SELECT s_nationkey AS ticker, max(s_suppkey) AS corp_code FROM supplier WHERE s_nationkey % 4 <> 1 GROUP BY 1)"


def _filled(spark, sf_dir):
    mapping = tables.last_codes(read(spark, sf_dir, "supplier").where("s_nationkey % 4 <> 1").select(F.col("s_nationkey").cast("string").alias("stock_code"), F.col("s_suppkey").cast("string").alias("corp_code"), F.col("s_suppkey").alias("ord")))
    listed = watchlist(spark, sf_dir).select("ord", F.col("ticker").cast("string").alias("ticker"), F.lit(None).cast("string").alias("corp_code"))
    return filing_ops.fill_corp_codes(listed, mapping)


@query(SQL_CODES + " SELECT CAST(w.ticker AS VARCHAR) AS ticker, CAST(corp_code AS VARCHAR) AS corp_code FROM watchlist w LEFT JOIN m ON w.ticker = m.ticker")
def corp_code_fill(spark, sf_dir):
    return _filled(spark, sf_dir)[0].select("ticker", "corp_code")


@query(SQL_CODES + " SELECT CAST(w.ticker AS VARCHAR) AS ticker FROM watchlist w WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.ticker = w.ticker)")
def corp_code_missing(spark, sf_dir):
    return _filled(spark, sf_dir)[1].select("ticker")


@query("""WITH h AS (SELECT user_id AS ticker, event_id, CASE WHEN event_id % 5 <> 0 THEN floor(value) END AS shares, ts FROM events)
SELECT ticker, event_id, CAST(shares AS BIGINT) AS shares FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, event_id DESC) AS rn FROM h WHERE shares IS NOT NULL) WHERE rn <= 30""")
def holding_history_topn(spark, sf_dir):
    raw = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.format_number(F.floor("value"), 0))
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), "event_id", to_int(raw).alias("shares"), F.struct("ts", "event_id").alias("dt"))
    return series.latest(rows.where("shares is not null"), 30).select("ticker", "event_id", "shares")


@query("""WITH c AS (SELECT user_id AS ticker, event_id, ts AS fetched_at FROM events), y AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM c WHERE date_diff('second', fetched_at, (SELECT TIMESTAMP '2024-01-20 00:00:00')) < 24 * 3600)
SELECT ticker, event_id FROM y WHERE n >= 2""")
def cache_fresh(spark, sf_dir):
    cache = read(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), "event_id", F.col("ts").cast("timestamp").alias("fetched_at"))
    return flow_ops.fresh(cache, datetime(2024, 1, 20), 24, 2).select("ticker", "event_id")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber AS ord, l_returnflag AS context_id FROM lineitem), c AS (SELECT * FROM (VALUES ('A', 'instant'), ('R', 'duration')) AS v(context_id, period_type))
SELECT l_orderkey, ord, coalesce(period_type, '?') AS period_type FROM f LEFT JOIN c ON f.context_id = c.context_id""")
def context_join(spark, sf_dir):
    known = spark.createDataFrame([("A", "instant", []), ("R", "duration", [])], "context_id string, period_type string, dimensions array<struct<axis:string,member:string>>")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("context_id"))
    return fact_ops.with_contexts(rows, known).select("l_orderkey", "ord", "period_type")


@query("""WITH r AS (SELECT p_type AS concept_id, p_name AS text, p_partkey AS ord, p_size % 3 AS role FROM part WHERE p_size % 3 <> 2), b AS (SELECT concept_id, text, row_number() OVER (PARTITION BY concept_id ORDER BY role, CASE WHEN role = 0 THEN -ord ELSE ord END) AS nth FROM r)
SELECT concept_id, text AS label FROM b WHERE nth = 1""")
def label_links(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    role = F.when(F.col("p_size") % 3 == 0, "http://www.xbrl.org/2003/role/label").when(F.col("p_size") % 3 == 1, "http://x/role/label/terse").otherwise("http://x/label/documentation")
    labels = part.select(F.concat(F.lit("r-"), "p_type").alias("res"), F.lit("ko").alias("lang"), role.alias("role"), F.col("p_name").alias("text"), F.col("p_partkey").alias("ord"))
    kinds = part.select("p_type").distinct()
    locators = kinds.select(F.concat(F.lit("l-"), "p_type").alias("loc"), F.col("p_type").alias("concept_id"))
    arcs = kinds.select(F.lit(0).alias("ord"), F.concat(F.lit("l-"), "p_type").alias("loc"), F.concat(F.lit("r-"), "p_type").alias("res"))
    return fact_ops.labels_of(locators, arcs, labels).select("concept_id", "label")


@query("""SELECT p_partkey FROM part WHERE p_size % 5 <> 0 AND (p_partkey % 4 = 0 OR p_partkey % 4 = 1)""")
def consolidated_facts(spark, sf_dir):
    axis = F.lit(f"ifrs-full:{CONSOLIDATED_AXIS}")
    member = lambda a, m: F.struct(a.alias("axis"), F.lit(m).alias("member"))
    k = F.col("p_partkey") % 4
    none = F.array().cast("array<struct<axis:string,member:string>>")
    dims = (
        F.when(k == 0, none).when(k == 1, F.array(member(axis, "ifrs-full:ConsolidatedMember"))).when(k == 2, F.array(member(axis, "ifrs-full:SeparateMember")))
        .otherwise(F.array(member(axis, "ifrs-full:ConsolidatedMember"), member(F.lit("other"), "x:y")))
    )
    end = F.when(F.col("p_size") % 5 == 0, "2022-12-31").otherwise("2025-12-31")
    return read(spark, sf_dir, "part").where(fact_ops.is_consolidated_primary(end, dims)).select("p_partkey")


@query(f"WITH {SQL_BARS} SELECT ticker, dt, CASE WHEN pct_change > 0.5 THEN 'up' WHEN pct_change < -0.5 THEN 'down' ELSE 'flat' END AS trend FROM moves")
def trend_classes(spark, sf_dir):
    return series.one_row_change(bars(spark, sf_dir)).select("ticker", "dt", series.trend(F.col("pct_change")).alias("trend"))


@query("""WITH p AS (SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS VARCHAR) AS y, o_orderkey % 6 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN y || '년 연간' WHEN 1 THEN y || '년 상반기' WHEN 2 THEN y || '년 1분기' WHEN 3 THEN y || '년 3분기' WHEN 4 THEN y || '-q1' ELSE 'x' || y END AS friendly FROM p""")
def friendly_periods(spark, sf_dir):
    part = F.get(F.array(*map(F.lit, ("-annual", "-H1", "-Q1", "-Q3", "-q1"))), (F.col("o_orderkey") % 6).cast("int"))
    year = F.year("o_orderdate").cast("string")
    label = F.coalesce(F.concat(year, part), F.concat(F.lit("x"), year))
    return read(spark, sf_dir, "orders").select("o_orderkey", friendly_period(label).alias("friendly"))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN s_suppkey * 1000 + 1007 WHEN 3 THEN -s_suppkey ELSE 0 END AS as_int,
CASE s_suppkey % 5 WHEN 0 THEN CAST(s_suppkey * 1000 + 1007 AS DOUBLE) WHEN 1 THEN CAST(s_suppkey AS DOUBLE) WHEN 3 THEN CAST(-s_suppkey AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS as_pct, CASE s_suppkey % 5 WHEN 3 THEN CAST(-s_suppkey AS INTEGER) END AS as_decimals FROM supplier""")
def lenient_numbers(spark, sf_dir):
    key = F.col("s_suppkey")
    text, k = key.cast("string"), key % 5
    raw = F.when(k == 0, F.format_number(key * 1000 + 1007, 0)).when(k == 1, F.concat(F.lit("+"), text, F.lit("%"))).when(k == 2, "x").when(k == 3, F.concat(F.lit("-"), text)).otherwise("INF")
    return read(spark, sf_dir, "supplier").select("s_suppkey", lenient_int(raw).alias("as_int"), lenient_pct(raw).alias("as_pct"), fact_decimals(raw).alias("as_decimals"))


@query("SELECT o_custkey AS customer, string_agg(o_orderpriority || ': ' || CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY o_orderkey) AS feedback FROM orders GROUP BY 1")
def feedback_text(spark, sf_dir):
    line = F.concat("o_orderpriority", F.lit(": "), F.col("o_orderkey").cast("string"))
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(report.joined(line, [F.col("o_orderkey")]).alias("feedback"))


_SYMBOLS = ", ".join(f"({i}, '{label}', '{symbol}')" for i, (label, symbol) in enumerate(INDICATORS))


@query(f"WITH {SQL_BARS}, d AS (SELECT * FROM (VALUES {_SYMBOLS}) AS v(ticker, label, symbol)) SELECT label, symbol, close AS latest FROM d JOIN moves m ON d.ticker = m.ticker WHERE rn = 1")
def indicator_prices(spark, sf_dir):
    dim = spark.createDataFrame([(i, *x) for i, x in enumerate(INDICATORS)], "ticker int, label string, symbol string")
    return series.latest(bars(spark, sf_dir).join(F.broadcast(dim), "ticker")).select("label", "symbol", F.col("close").alias("latest"))
