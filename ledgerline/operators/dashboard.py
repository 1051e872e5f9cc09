"""Counts for report pages and dashboards."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .planner import deadline_passed


def totals(watchlist: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: tickers, tickers with reports, reports, sectors."""
    per = reports.groupBy("ticker").agg(F.count("*").alias("reports"))
    joined = watchlist.join(per, "ticker", "left")
    return joined.agg(
        F.count("*").alias("total"), F.count("reports").alias("with_reports"), F.coalesce(F.sum("reports"), F.lit(0)).alias("reports_total"), F.countDistinct("sector").alias("sectors"),
    )


def sector_pills(watchlist: DataFrame, reports: DataFrame) -> DataFrame:
    """Per sector, in order of first appearance: tickers, and tickers with reports."""
    have = reports.select("ticker").distinct().withColumn("has", F.lit(1))
    return watchlist.join(have, "ticker", "left").groupBy("sector").agg(F.count("*").alias("n"), F.count("has").alias("with_reports"), F.min("ord").alias("first_ord"))


def period_completion(periods: DataFrame, watchlist: DataFrame, usable: DataFrame, as_of: date) -> DataFrame:
    """Per period: done, total, pct and status. total is one row."""
    total = watchlist.agg(F.count("*").alias("total"))
    known = usable.join(watchlist.select("ticker"), "ticker", "left_semi").select("ticker", "period_label").distinct()
    done = known.groupBy("period_label").agg(F.count("*").alias("done"))
    out = periods.join(done, "period_label", "left").withColumn("done", F.coalesce("done", F.lit(0))).crossJoin(total)
    status = F.when(~deadline_passed(F.col("filing_deadline"), as_of), "대기").when(F.col("done") == F.col("total"), "완성").when(F.col("done") == 0, "진행X").otherwise("진행중")
    return out.select("period_ord", "period_label", "done", "total", (F.col("done") * 100 / F.nullif("total", F.lit(0))).alias("pct"), status.alias("status"))


def company_latest(reports: DataFrame) -> DataFrame:
    """Each ticker's reports and its latest period (as text)."""
    return reports.groupBy("ticker").agg(F.count("*").alias("reports"), F.max("period_label").alias("latest_period"))


def dashboard(watchlist: DataFrame, reports: DataFrame, market: DataFrame, foreign: DataFrame) -> DataFrame:
    """The watchlist with each ticker's reports, market and holdings, any of which may be missing; cap_bar is its
    market cap in percent of the largest."""
    out = watchlist.join(company_latest(reports), "ticker", "left").join(market, "ticker", "left").join(foreign, "ticker", "left")
    out = out.crossJoin(market.join(watchlist.select("ticker"), "ticker", "left_semi").agg(F.max("market_cap").alias("most")))  # one row
    bar = F.least(F.col("market_cap") / F.nullif(F.col("most"), F.lit(0.0)) * 100, F.lit(100.0))
    return out.withColumn("reports", F.coalesce("reports", F.lit(0))).withColumn("cap_bar", bar).drop("most")


def flow_display(eok: Column) -> Column:
    """An amount of 억 with its sign: from 10000 on in 조, one decimal."""
    return F.when(F.abs(eok) >= 10000, F.format_string("%+.1f조", eok / 10000)).otherwise(F.format_string("%+.0f억", eok))


def refresh_tally(runs: DataFrame) -> DataFrame:
    """One row: total, ok and fail of runs (ok boolean)."""
    return runs.agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("fail"))
