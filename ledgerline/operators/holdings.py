"""Holders, share counts and market values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.dates import holds_any
from ..functions.numbers import to_int, trimmed


def nationality(name: Column) -> Column:
    """FOREIGN by a known part of the name, else KR by any Hangul, else FOREIGN by Latin letters, else UNKNOWN."""
    plain = trimmed(F.coalesce(name, F.lit("")))
    return (
        F.when(plain == "", "UNKNOWN")
        .when(holds_any(plain, rules.FOREIGN_NAMES), "FOREIGN")
        .when(plain.rlike("[가-힯]"), "KR")
        .when(plain.rlike("[A-Za-z]"), "FOREIGN")
        .otherwise("UNKNOWN")
    )


def latest_per_holder(reports: DataFrame, key: str = "ticker") -> DataFrame:
    """Each holder's report of the greatest date (as text), the first in order on a tie; blank names are left out."""
    named = reports.withColumn("holder", trimmed(F.col("holder"))).where("holder is not null and holder != ''")
    newest = Window.partitionBy(key, "holder").orderBy(F.desc("rcept_dt"), "ord")
    return named.withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth")


def foreign_summary(holders: DataFrame, key: str = "ticker") -> DataFrame:
    """Holders, foreign holders and their summed share: null without foreign holders and where it is 0."""
    foreign = nationality(F.col("holder")) == "FOREIGN"
    return holders.groupBy(key).agg(
        F.count("*").alias("holders"), F.count_if(foreign).alias("foreign_holders"),
        F.nullif(F.sum(F.when(foreign, F.col("holding_pct"))), F.lit(0)).alias("foreign_pct"),
    )


def share_counts(items: DataFrame, key: str = "ticker") -> DataFrame:
    """Counts of a key's rows (se, istc_totqy, tesstk_co, distb_stock_co as text, ord): the last row of common shares
    and the last of preferred ones."""
    common = F.col("se").rlike("보통주|통상주")
    preferred = F.contains(F.col("se"), F.lit("우선주")) & ~common
    last = lambda value, which: F.max_by(to_int(F.col(value)), F.when(which, F.col("ord")))
    return items.groupBy(key).agg(
        last("istc_totqy", common).alias("common_shares"), last("tesstk_co", common).alias("treasury_shares"),
        last("distb_stock_co", common).alias("distributed_shares"), last("istc_totqy", preferred).alias("preferred_shares"),
    )


def market_cap(close: Column, shares: Column) -> Column:
    """Close times common shares; null where either is missing or there are no shares."""
    return F.when(close.isNotNull() & (shares != 0), close * shares)


def ticker_snapshot(prices: DataFrame, shares: DataFrame) -> DataFrame:
    """Prices (ticker, close, ...) and share counts side by side, either of which may be missing."""
    return prices.join(shares, "ticker", "full").withColumn("market_cap", market_cap(F.col("close"), F.col("common_shares")))
