"""The reference concepts on the driver's tables: nations stand for tickers, regions for sectors, a nation's sales by
ship date for its bars and flows, orders for filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_NAMES = {"1-URGENT": "연결재무제표기준영업(잠정)실적(공정공시)", "2-HIGH": "주요사항보고서(합병)", "3-MEDIUM": "[정정]분기보고서", "4-NOT SPECIFIED": "자기주식취득결정", "5-LOW": "기업설명회(IR)개최"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("sector"))
    return read(spark, sf_dir, "nation").join(region, "n_regionkey").select(F.col("n_nationkey").alias("ord"), F.col("n_nationkey").alias("ticker"), F.col("n_name").alias("name"), "sector")


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = read(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("dt"), "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
    seller = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("ticker"))
    return sold.join(seller, "l_suppkey")


def _money(column: str):
    return F.col(column).cast("decimal(18,2)")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, dt, close (value over quantity) and volume."""
    price, quantity = F.sum(_money("l_extendedprice")).cast("double"), F.sum(_money("l_quantity")).cast("double")
    return _sales(spark, sf_dir).groupBy("ticker", "dt").agg((price / quantity).alias("close"), quantity.alias("volume"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, dt, net_krw (returned lines count against) and source, with the bar's change."""
    from ..operators.series import one_row_change

    x = _money("l_extendedprice")
    net = F.sum(F.when(F.col("l_returnflag") == "A", x).when(F.col("l_returnflag") == "R", -x).otherwise(F.lit(0).cast("decimal(18,2)")))
    days = _sales(spark, sf_dir).groupBy("ticker", "dt").agg(net.alias("net_krw"), F.max("l_linestatus").alias("source"))
    return days.join(one_row_change(bars(spark, sf_dir)).select("ticker", "dt", "pct_change"), ["ticker", "dt"])


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker (the customer's nation), corp_code, rcept_no, ord, report_nm, rcept_dt (as yyyyMMdd)."""
    name = F.coalesce(*(F.when(F.col("o_orderpriority") == k, F.lit(v)) for k, v in REPORT_NAMES.items()))
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("ticker"))
    return read(spark, sf_dir, "orders").join(customer, "o_custkey").select(
        "ticker", F.col("o_custkey").alias("corp_code"), F.col("o_orderkey").alias("rcept_no"), F.col("o_orderkey").alias("ord"), name.alias("report_nm"), F.date_format("o_orderdate", "yyyyMMdd").alias("rcept_dt"),
    )


# The same in SQL, as common table expressions.
SQL_WATCHLIST = "watchlist AS (SELECT n_nationkey AS ord, n_nationkey AS ticker, n_name AS name, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey)"
SQL_BARS = """bars AS (
  SELECT s_nationkey AS ticker, CAST(l_shipdate AS DATE) AS dt,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
moves AS (
  SELECT *, lag(close) OVER w AS prev_close,
         CASE WHEN lag(close) OVER w = 0 THEN 0.0 ELSE (close / lag(close) OVER w - 1) * 100 END AS pct_change,
         row_number() OVER w AS nth, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS rn
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY dt))"""
SQL_FLOWS = """flows AS (
  SELECT s_nationkey AS ticker, CAST(l_shipdate AS DATE) AS dt,
         sum(CASE l_returnflag WHEN 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2)) WHEN 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS net_krw,
         max(l_linestatus) AS source, row_number() OVER (PARTITION BY s_nationkey ORDER BY CAST(l_shipdate AS DATE) DESC) AS rn
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REPORT_NAMES.items())
SQL_FILINGS = f"""filings AS (
  SELECT c_nationkey AS ticker, o_custkey AS corp_code, o_orderkey AS rcept_no, o_orderkey AS ord, CASE o_orderpriority {_CASES} END AS report_nm,
         strftime(o_orderdate, '%Y%m%d') AS rcept_dt, CAST(o_orderdate AS DATE) AS day
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
SQL_IMPACT = """CASE WHEN report_nm LIKE '%잠정실적%' OR report_nm LIKE '%영업(잠정)실적%' THEN 1.5 WHEN report_nm LIKE '%주요사항보고%' OR report_nm LIKE '%합병%' THEN 1.3
  WHEN report_nm LIKE '%정정%' THEN 1.2 WHEN report_nm LIKE '%자기주식%' THEN 1.1 ELSE 0.0 END"""
