"""Queries on prices, flows, holders and filings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import compact_date, days_after, iso_week, next_weekday_run, period_end, weeks_between
from ..operators import filings as filing_ops
from ..operators import flows as flow_ops
from ..operators import holdings, series, triggers
from ..sources import answers
from .registry import query
from .tables import SQL_BARS, SQL_FILINGS, SQL_FLOWS, SQL_IMPACT, SQL_WATCHLIST, bars, filings, flows, read, watchlist

# Thresholds of these tables, whose synthetic values move more than market data; the operators' defaults are others.
FLOW, PCT = 50_000.0, 2.0

SQL_HITS = f"""WITH {SQL_WATCHLIST}, {SQL_BARS}, {SQL_FLOWS}, {SQL_FILINGS},
price AS (SELECT ticker, 'price_move' AS trigger_type, abs(pct_change) / 5.0 AS severity FROM moves WHERE rn = 1 AND prev_close IS NOT NULL AND abs(pct_change) >= 5.0),
flow3 AS (SELECT ticker, count(*) AS n, CAST(sum(net_krw) AS DOUBLE) AS cumulative, min(dt) AS first_date, max(dt) AS last_date, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM flows WHERE rn <= 3 GROUP BY ticker),
flow AS (SELECT ticker, 'foreign_flow' AS trigger_type, abs(cumulative) / 50000.0 AS severity, CASE WHEN cumulative > 0 THEN '매수' ELSE '매도' END AS direction, cumulative, first_date, last_date, sources
         FROM flow3 WHERE n = 3 AND abs(cumulative) >= 50000.0),
decoupled AS (SELECT f.ticker, 'decoupling' AS trigger_type, (abs(m.pct_change) / 2.0 + abs(CAST(f.net_krw AS DOUBLE)) / 20000.0) / 2 AS severity,
              CASE WHEN m.pct_change > 0 THEN '국내 환호 / 외인 매도' ELSE '국내 패닉 / 외인 매수' END AS label, f.dt, m.pct_change, CAST(f.net_krw AS DOUBLE) AS net_krw
              FROM flows f JOIN moves m ON f.ticker = m.ticker AND f.dt = m.dt
              WHERE f.rn = 1 AND abs(m.pct_change) >= 2.0 AND abs(CAST(f.net_krw AS DOUBLE)) >= 20000.0 AND (m.pct_change > 0) <> (f.net_krw > 0)),
scored AS (SELECT *, {SQL_IMPACT} AS severity FROM filings),
disclosed AS (SELECT ticker, 'dart_disclosure' AS trigger_type, CAST(severity AS DOUBLE) AS severity, rcept_no, report_nm, matched_count FROM (
              SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY severity DESC, ord) AS rn2, count(*) OVER (PARTITION BY ticker) AS matched_count FROM scored
              WHERE severity > 0 AND day >= (SELECT max(day) - 1 FROM filings)) WHERE rn2 = 1),
hits AS (SELECT ticker, trigger_type, severity FROM price UNION ALL SELECT ticker, trigger_type, severity FROM flow
         UNION ALL SELECT ticker, trigger_type, severity FROM disclosed UNION ALL SELECT ticker, trigger_type, severity FROM decoupled),
valued AS (SELECT h.*, w.ord, CASE trigger_type WHEN 'price_move' THEN 20.0 * severity WHEN 'foreign_flow' THEN 12.0 * ln(1 + severity) WHEN 'dart_disclosure' THEN 30.0 * severity ELSE 50.0 * severity END AS score
           FROM hits h JOIN watchlist w ON h.ticker = w.ticker),
ranked AS (SELECT row_number() OVER (ORDER BY round(score, 6) DESC, ord, CASE trigger_type WHEN 'price_move' THEN 0 WHEN 'foreign_flow' THEN 1 WHEN 'dart_disclosure' THEN 2 ELSE 3 END) AS rank, ticker, trigger_type, severity, score, ord FROM valued)
"""


def _price(spark, sf_dir: str) -> DataFrame:
    return triggers.price_moves(bars(spark, sf_dir))


def _recent_disclosures(spark, sf_dir: str) -> DataFrame:
    found = filings(spark, sf_dir).withColumn("day", compact_date(F.col("rcept_dt")))
    last = found.agg(F.max("day").alias("last"))
    return triggers.best_disclosures(found.join(F.broadcast(last), F.col("day") >= F.date_sub("last", 1)).drop("last"))


def _hits(spark, sf_dir: str) -> DataFrame:
    flow = flows(spark, sf_dir)
    return triggers.ranked_hits(watchlist(spark, sf_dir), _price(spark, sf_dir), triggers.flow_hits(flow, FLOW), _recent_disclosures(spark, sf_dir), triggers.decoupling_hits(flow, PCT, 20_000.0))


@query(f"WITH {SQL_BARS} SELECT ticker, 'price_move' AS trigger_type, abs(pct_change) / 5.0 AS severity, dt, close, prev_close, pct_change FROM moves WHERE rn = 1 AND prev_close IS NOT NULL AND abs(pct_change) >= 5.0")
def price_move_hits(spark, sf_dir):
    return _price(spark, sf_dir)


@query(f"""WITH {SQL_WATCHLIST}, {SQL_BARS} SELECT m.ticker, 20.0 * (abs(pct_change) / 5.0) AS total_score FROM moves m JOIN watchlist w ON m.ticker = w.ticker
WHERE rn = 1 AND prev_close IS NOT NULL AND abs(pct_change) >= 5.0 ORDER BY total_score DESC, w.ord LIMIT 3""")
def price_move_top3(spark, sf_dir):
    return triggers.top_tickers(triggers.ranked_hits(watchlist(spark, sf_dir), _price(spark, sf_dir)))


@query(SQL_HITS + "SELECT * FROM flow")
def flow_3row_hits(spark, sf_dir):
    return triggers.flow_hits(flows(spark, sf_dir), FLOW)


@query(f"WITH {SQL_FLOWS} SELECT ticker, CAST(sum(net_krw) AS DOUBLE) AS cumulative, count(*) AS n FROM flows WHERE rn <= 5 GROUP BY ticker")
def cumulative_flow_5row(spark, sf_dir):
    return triggers.cumulative_flow(flows(spark, sf_dir), 5).withColumn("cumulative", F.col("cumulative").cast("double"))


@query(SQL_HITS + "SELECT * FROM decoupled")
def decoupling_hits(spark, sf_dir):
    return triggers.decoupling_hits(flows(spark, sf_dir), PCT, 20_000.0)


@query(f"""WITH {SQL_FILINGS}, scored AS (SELECT *, CAST({SQL_IMPACT} AS DOUBLE) AS severity FROM filings)
SELECT corp_code, 'dart_disclosure' AS trigger_type, severity, rcept_no, report_nm, matched_count FROM (
SELECT *, row_number() OVER (PARTITION BY corp_code ORDER BY severity DESC, ord) AS rn, count(*) OVER (PARTITION BY corp_code) AS matched_count FROM scored WHERE severity > 0) WHERE rn = 1""")
def disclosure_best(spark, sf_dir):
    return triggers.best_disclosures(filings(spark, sf_dir), "corp_code")


@query(SQL_HITS + "SELECT rank, ticker, trigger_type, severity, round(score, 6) AS score FROM ranked")
def triggers_union_ranked(spark, sf_dir):
    return _hits(spark, sf_dir).select("rank", "ticker", "trigger_type", "severity", F.round("score", 6).alias("score"))


@query(SQL_HITS + "SELECT ticker, round(sum(score), 6) AS total_score FROM ranked GROUP BY ticker ORDER BY sum(score) DESC, min(rank) LIMIT 3")
def triggers_top3(spark, sf_dir):
    return triggers.top_tickers(_hits(spark, sf_dir)).withColumn("total_score", F.round("total_score", 6))


@query(SQL_HITS + "SELECT trigger_type, count(*) AS n, CASE trigger_type WHEN 'price_move' THEN 0 WHEN 'dart_disclosure' THEN 1 WHEN 'foreign_flow' THEN 2 ELSE 3 END AS display_ord FROM hits GROUP BY trigger_type")
def trigger_counts_by_type(spark, sf_dir):
    return triggers.counts_by_type(_hits(spark, sf_dir))


@query(f"WITH {SQL_BARS} SELECT ticker, dt, close, prev_close, pct_change FROM moves")
def ret_1row(spark, sf_dir):
    return series.one_row_change(bars(spark, sf_dir)).select("ticker", "dt", "close", "prev_close", "pct_change")


@query(f"WITH {SQL_BARS} SELECT ticker, dt, (close / nullif(lag(close, 59) OVER (PARTITION BY ticker ORDER BY dt), 0) - 1) * 100 AS pct FROM bars")
def ret_60row(spark, sf_dir):
    return series.change_over_rows(bars(spark, sf_dir)).select("ticker", "dt", "pct")


@query(f"""WITH {SQL_BARS} SELECT ticker, dt, CASE WHEN nth >= 240 THEN (close / nullif(lag(close, 239) OVER w, 0) - 1) * 100 WHEN nth >= 2 THEN (close / nullif(first_value(close) OVER w, 0) - 1) * 100 END AS pct
FROM moves WINDOW w AS (PARTITION BY ticker ORDER BY dt)""")
def ret_240row_or_first(spark, sf_dir):
    return series.change_over_rows_or_first(bars(spark, sf_dir)).select("ticker", "dt", "pct")


@query(f"""WITH {SQL_BARS}, f AS (SELECT ticker, dt, volume, count(volume) OVER w AS n, avg(volume) OVER w AS mean, stddev_samp(volume) OVER w AS std FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT ticker, dt, round(mean, 6) AS mean, CASE WHEN n >= 10 THEN round((volume - mean) / nullif(std, 0), 6) END AS z FROM f""")
def volume_z60(spark, sf_dir):
    return series.volume_score(bars(spark, sf_dir)).select("ticker", "dt", F.round("mean", 6).alias("mean"), F.round("z", 6).alias("z"))


@query(f"""WITH {SQL_BARS}, f AS (SELECT ticker, dt, count(volume) OVER w AS n, avg(volume) OVER w AS mean FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT ticker, dt, CASE WHEN n >= 10 THEN round(mean, 6) END AS avg_volume FROM f""")
def volume_mean60_guarded(spark, sf_dir):
    return series.guarded_mean(bars(spark, sf_dir)).select("ticker", "dt", F.round("avg_volume", 6).alias("avg_volume"))


@query(f"WITH {SQL_BARS} SELECT ticker, CAST(row_number() OVER (PARTITION BY ticker ORDER BY dt) - 1 AS INTEGER) AS pos, close FROM moves WHERE rn <= 60")
def tail60_array(spark, sf_dir):
    return series.tail(bars(spark, sf_dir)).select("ticker", F.posexplode("series").alias("pos", "close"))


@query(f"WITH {SQL_BARS}, d AS (SELECT *, close - lag(close, 5) OVER (PARTITION BY ticker ORDER BY dt) AS delta FROM moves) SELECT ticker, dt, delta FROM d WHERE rn = 1")
def delta_5row(spark, sf_dir):
    return series.delta_rows(bars(spark, sf_dir), "close").select("ticker", "dt", "delta")


@query(f"""WITH {SQL_BARS}, t AS (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n, min(close) OVER (PARTITION BY ticker) AS low, max(close) OVER (PARTITION BY ticker) AS high FROM moves WHERE rn <= 60)
SELECT ticker, CAST(i AS INTEGER) AS pos, CASE WHEN n > 1 THEN CAST(i AS DOUBLE) / CAST(n - 1 AS DOUBLE) ELSE 0.0 END AS x, 1 - (close - low) / coalesce(nullif(high - low, 0), 1) AS y FROM t""")
def minmax_norm_points(spark, sf_dir):
    points = series.tail(bars(spark, sf_dir)).select("ticker", F.posexplode(series.normalised_points(F.col("series"))).alias("pos", "p"))
    return points.select("ticker", "pos", "p.x", "p.y")


@query(f"""WITH {SQL_BARS}, t AS (SELECT *, first_value(close) OVER w AS first, first_value(close) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS tail_first FROM moves WINDOW w AS (PARTITION BY ticker ORDER BY dt))
SELECT ticker, close AS latest, close - prev_close AS change_1d, (close / nullif(prev_close, 0) - 1) * 100 AS pct_1d, (close / nullif(first, 0) - 1) * 100 AS pct_since_first,
CASE WHEN tail_first > 0 THEN (close / nullif(tail_first, 0) - 1) * 100 END AS pct_tail FROM t WHERE rn = 1""")
def macro_change(spark, sf_dir):
    return series.indicator_snapshot(bars(spark, sf_dir))


SQL_HOLDERS = """reports AS (SELECT c_nationkey AS ticker, CASE c_nationkey % 4 WHEN 0 THEN 'BlackRock ' WHEN 1 THEN '국민연금 ' WHEN 2 THEN '' ELSE '123 ' END || CASE WHEN c_nationkey % 4 = 3 THEN '' ELSE c_name END AS holder,
  strftime(o_orderdate, '%Y%m%d') AS rcept_dt, o_orderkey AS ord, CAST(o_totalprice AS DECIMAL(18,2)) AS holding_pct FROM orders JOIN customer ON o_custkey = c_custkey),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, trim(holder) ORDER BY rcept_dt DESC, ord) AS nth FROM reports) WHERE nth = 1)"""


def _holders(spark, sf_dir: str) -> DataFrame:
    k = F.col("c_nationkey") % 4
    prefix = F.when(k == 0, "BlackRock ").when(k == 1, "국민연금 ").when(k == 2, "").otherwise("123 ")
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("ticker"), F.concat(prefix, F.when(k == 3, "").otherwise(F.col("c_name"))).alias("holder"))
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyyMMdd").alias("rcept_dt"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").cast("decimal(18,2)").alias("holding_pct"))
    return holdings.latest_per_holder(orders.join(customer, "o_custkey"))


@query(f"WITH {SQL_HOLDERS} SELECT ticker, trim(holder) AS holder, rcept_dt, ord, CAST(holding_pct AS DOUBLE) AS holding_pct FROM latest")
def latest_per_holder(spark, sf_dir):
    return _holders(spark, sf_dir).select("ticker", "holder", "rcept_dt", "ord", F.col("holding_pct").cast("double").alias("holding_pct"))


@query(f"""WITH {SQL_HOLDERS}, c AS (SELECT *, CASE WHEN holder LIKE '%BlackRock%' THEN 'FOREIGN' WHEN regexp_matches(holder, '[가-힯]') THEN 'KR' WHEN regexp_matches(holder, '[A-Za-z]') THEN 'FOREIGN' ELSE 'UNKNOWN' END AS nat FROM latest)
SELECT ticker, count(*) AS holders, count(*) FILTER (WHERE nat = 'FOREIGN') AS foreign_holders, CAST(nullif(sum(holding_pct) FILTER (WHERE nat = 'FOREIGN'), 0) AS DOUBLE) AS foreign_pct FROM c GROUP BY ticker""")
def holder_class_sum(spark, sf_dir):
    return holdings.foreign_summary(_holders(spark, sf_dir)).withColumn("foreign_pct", F.col("foreign_pct").cast("double"))


@query("""WITH items AS (SELECT o_custkey AS ticker, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '보통주' WHEN o_orderpriority = '3-MEDIUM' THEN '우선주' ELSE '합계' END AS se, o_orderkey AS ord,
  CAST(floor(o_totalprice) AS BIGINT) AS istc, CAST(o_orderkey AS BIGINT) AS tes, CAST(o_custkey AS BIGINT) AS dist FROM orders)
SELECT ticker, (array_agg(istc ORDER BY ord DESC) FILTER (WHERE se = '보통주'))[1] AS common_shares, (array_agg(tes ORDER BY ord DESC) FILTER (WHERE se = '보통주'))[1] AS treasury_shares,
(array_agg(dist ORDER BY ord DESC) FILTER (WHERE se = '보통주'))[1] AS distributed_shares, (array_agg(istc ORDER BY ord DESC) FILTER (WHERE se = '우선주'))[1] AS preferred_shares FROM items GROUP BY ticker""")
def conditional_share_pick(spark, sf_dir):
    p = F.col("o_orderpriority")
    items = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("ord"), F.when(p.isin("1-URGENT", "2-HIGH"), "보통주").when(p == "3-MEDIUM", "우선주").otherwise("합계").alias("se"),
        F.format_number(F.floor("o_totalprice"), 0).alias("istc_totqy"), F.format_number("o_orderkey", 0).alias("tesstk_co"), F.format_number("o_custkey", 0).alias("distb_stock_co"),
    )
    return holdings.share_counts(items)


@query("SELECT p_partkey, CASE WHEN p_retailprice IS NOT NULL AND p_size % 7 <> 0 THEN p_retailprice * (p_size % 7) END AS market_cap FROM part")
def market_cap(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", holdings.market_cap(F.col("p_retailprice"), F.col("p_size") % 7).alias("market_cap"))


SQL_PERIOD = """CASE WHEN report_nm LIKE '%1분기%' THEN make_date(y, 3, 31) WHEN report_nm LIKE '%반기%' OR report_nm LIKE '%2분기%' THEN make_date(y, 6, 30) WHEN report_nm LIKE '%3분기%' THEN make_date(y, 9, 30)
WHEN report_nm LIKE '%잠정실적%' OR report_nm LIKE '%영업(잠정)실적%' OR report_nm LIKE '%분기보고서%' OR report_nm LIKE '%반기보고서%' THEN
CASE WHEN m <= 2 THEN make_date(y - 1, 12, 31) WHEN m <= 5 THEN make_date(y, 3, 31) WHEN m <= 8 THEN make_date(y, 6, 30) ELSE make_date(y, 9, 30) END END"""


@query(f"WITH {SQL_FILINGS}, d AS (SELECT *, CAST(year(day) AS INTEGER) AS y, CAST(month(day) AS INTEGER) AS m FROM filings) SELECT rcept_no, {SQL_PERIOD} AS likely_period_end FROM d")
def interim_period_end(spark, sf_dir):
    return filings(spark, sf_dir).select("rcept_no", period_end(F.col("report_nm"), compact_date(F.col("rcept_dt"))).alias("likely_period_end"))


@query(f"""WITH {SQL_FILINGS}, d AS (SELECT *, CAST(year(day) AS INTEGER) AS y, CAST(month(day) AS INTEGER) AS m FROM filings WHERE (report_nm LIKE '%잠정%실적%' OR report_nm LIKE '%분기보고서%' OR report_nm LIKE '%반기보고서%' OR report_nm LIKE '%주요사항보고서%')
AND day > DATE '1996-03-31' AND day <= DATE '1996-03-31' + 400)
SELECT corp_code, rcept_no, CAST(day - DATE '1996-03-31' AS INTEGER) AS days_after_annual, {SQL_PERIOD} AS likely_period_end, CAST(row_number() OVER (PARTITION BY corp_code ORDER BY rcept_dt DESC, ord) AS INTEGER) AS nth FROM d""")
def interim_window_filter(spark, sf_dir):
    return filing_ops.interim_filings(filings(spark, sf_dir), "19960331").select("corp_code", "rcept_no", "days_after_annual", "likely_period_end", "nth")


SQL_NAMED = """named AS (SELECT *, CASE ord % 4 WHEN 0 THEN '사업보고서 (' || (CAST(year(day) AS INTEGER) - 1) || '.12)' WHEN 1 THEN '반기보고서 (' || CAST(year(day) AS INTEGER) || '.06)'
  WHEN 2 THEN '분기보고서 (' || CAST(year(day) AS INTEGER) || '.03)' ELSE '[정정]분기보고서 (' || CAST(year(day) AS INTEGER) || '.09)' END AS nm FROM filings)"""


@query(f"""WITH {SQL_FILINGS}, {SQL_NAMED} SELECT corp_code, rcept_no, nm AS report_nm, CAST(row_number() OVER (PARTITION BY corp_code ORDER BY rcept_dt DESC, ord) AS INTEGER) AS nth FROM named
WHERE nm LIKE '%분기보고서%' AND nm LIKE '%(1996.09)%' AND day BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'""")
def periodic_report_match(spark, sf_dir):
    year = F.substring("rcept_dt", 1, 4)
    k = F.col("ord") % 4
    name = (
        F.when(k == 0, F.concat(F.lit("사업보고서 ("), (year.cast("int") - 1).cast("string"), F.lit(".12)"))).when(k == 1, F.concat(F.lit("반기보고서 ("), year, F.lit(".06)")))
        .when(k == 2, F.concat(F.lit("분기보고서 ("), year, F.lit(".03)"))).otherwise(F.concat(F.lit("[정정]분기보고서 ("), year, F.lit(".09)")))
    )
    named = filings(spark, sf_dir).withColumn("report_nm", name)
    return filing_ops.periodic_reports(named, 1996, "11014").select("corp_code", "rcept_no", "report_nm", "nth")


@query("""WITH p AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS dt, event_id // 20 AS page, event_id % 20 AS pos, event_id FROM events),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, dt ORDER BY page, pos) AS nth FROM p) WHERE nth = 1)
SELECT ticker, dt, event_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS rn FROM k) WHERE rn <= 10""")
def paged_union_dedup(spark, sf_dir):
    pages = read(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("dt"), F.floor(F.col("event_id") / 20).alias("page"), (F.col("event_id") % 20).alias("pos"), "event_id")
    return flow_ops.deduplicated_pages(pages, "ticker", "dt", 10).select("ticker", "dt", "event_id")


@query("""WITH s AS (SELECT user_id AS ticker, event_id, value, 0 AS source_rank FROM events WHERE event_type = 'purchase' AND user_id % 3 <> 0 UNION ALL SELECT user_id, event_id, value, 1 FROM events WHERE event_type <> 'purchase')
SELECT ticker, event_id, value, source_rank FROM (SELECT *, min(source_rank) OVER (PARTITION BY ticker) AS best FROM s) WHERE source_rank = best""")
def source_failover(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), "event_id", "value", "event_type")
    first = events.where("event_type = 'purchase' and ticker % 3 <> 0").withColumn("source_rank", F.lit(0))
    return flow_ops.failover(first.unionByName(events.where("event_type <> 'purchase'").withColumn("source_rank", F.lit(1)))).select("ticker", "event_id", "value", "source_rank")


@query("""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS d FROM events) SELECT event_id, CAST(isoyear(d) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(d) AS VARCHAR), 2, '0') AS iso_week,
CAST(floor(date_diff('day', date_trunc('week', d), DATE '2025-06-02') / 7.0) AS BIGINT) AS weeks FROM e""")
def iso_weeks(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", iso_week(F.to_date("ts")).alias("iso_week"), weeks_between(iso_week(F.to_date("ts")), F.lit("2025-W23")).alias("weeks"))


@query("""WITH e AS (SELECT event_id, ts, CASE WHEN hour(ts) >= 16 THEN CAST(ts AS DATE) + 1 ELSE CAST(ts AS DATE) END AS d FROM events)
SELECT event_id, CAST(d + CAST(CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS INTEGER) AS DATE) AS next_run FROM e""")
def next_run_day(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", next_weekday_run(F.col("ts")).alias("next_run"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INTEGER) AS days FROM orders")
def days_after_annual(spark, sf_dir):
    day = compact_date(F.date_format("o_orderdate", "yyyyMMdd"))
    return read(spark, sf_dir, "orders").select("o_orderkey", days_after(day, F.lit("1995-01-01").cast("date")).alias("days"))




@query(f"WITH {SQL_FILINGS} SELECT corp_code, rcept_no, rcept_dt, report_nm FROM filings WHERE day BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' ORDER BY rcept_dt DESC, rcept_no DESC LIMIT 100 OFFSET 100")
def filing_page(spark, sf_dir):
    return filing_ops.filing_list(filings(spark, sf_dir), begin="19960101", end="19971231", page_no=2).select("corp_code", "rcept_no", "rcept_dt", "report_nm")


# Each customer's answer: no JSON, refused, without a status, without a list, or whole.
SQL_ANSWERS = """items AS (SELECT o_custkey AS ticker, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '보통주' ELSE '우선주' END AS se, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord,
CAST(floor(o_totalprice) AS BIGINT) AS istc, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey AS BIGINT) END AS tes FROM orders)"""


def _share_answers(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    item = F.struct(
        "o_orderkey", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "보통주").otherwise("우선주").alias("se"), F.format_number(F.floor("o_totalprice"), 0).alias("istc_totqy"),
        F.when(F.col("o_orderkey") % 3 > 0, F.format_number("o_orderkey", 0)).otherwise("x").alias("tesstk_co"), F.lit("-").alias("distb_stock_co"),
    )
    whole = orders.groupBy(F.col("o_custkey").alias("ticker")).agg(F.array_sort(F.collect_list(item)).alias("list"))  # a customer's orders are few
    k = F.col("ticker") % 5
    status = F.when(k == 1, "013").when(k != 2, "000")
    text = F.to_json(F.struct(status.alias("status"), F.when(k == 1, "조회된 데이타가 없습니다.").alias("message"), F.lit("1").alias("page_no"), F.when(k != 3, F.col("list")).alias("list")))
    return answers.answers(whole.select("ticker", F.when(k == 0, F.left(text, F.lit(30))).otherwise(text).alias("text")), answers.SHARES)


@query(f"""WITH {SQL_ANSWERS} SELECT ticker, (array_agg(istc ORDER BY ord DESC) FILTER (WHERE se = '보통주'))[1] AS common_shares, (array_agg(tes ORDER BY ord DESC) FILTER (WHERE se = '보통주'))[1] AS treasury_shares,
CAST(NULL AS BIGINT) AS distributed_shares, (array_agg(istc ORDER BY ord DESC) FILTER (WHERE se = '우선주'))[1] AS preferred_shares FROM items WHERE ticker % 5 IN (2, 4) GROUP BY ticker""")
def share_answers(spark, sf_dir):
    found, _ = answers.items(_share_answers(spark, sf_dir), "ticker")
    return holdings.share_counts(found.withColumnRenamed("nth", "ord"))


@query("SELECT DISTINCT o_custkey AS ticker, CASE o_custkey % 5 WHEN 0 THEN 'no JSON' ELSE '013 조회된 데이타가 없습니다.' END AS reason FROM orders WHERE o_custkey % 5 < 2")
def refused_answers(spark, sf_dir):
    return answers.items(_share_answers(spark, sf_dir), "ticker")[1]
