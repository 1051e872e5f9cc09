"""What to work on next: periods, tickers, sectors and files."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import weeks_between

NEVER = 999  # weeks of a sector that was never covered


def deadline_passed(deadline: Column, as_of: date) -> Column:
    """On the day itself too."""
    return F.lit(as_of) >= deadline


def open_work(periods: DataFrame, watchlist: DataFrame, usable: DataFrame, skipped: DataFrame, as_of: date) -> DataFrame:
    """Periods whose deadline has passed by tickers, without those that have a usable report or were skipped. periods is a table of literal rows, so each task pairs its tickers with all."""
    due = periods.where(deadline_passed(F.col("filing_deadline"), as_of)).select(F.collect_list(F.struct("period_ord", "period_label")).alias("due"))
    listed = watchlist.select("ord", "ticker").crossJoin(due).select("ord", "ticker", F.inline("due"))
    return listed.join(usable, ["ticker", "period_label"], "left_anti").join(skipped, ["ticker", "period_label"], "left_anti")


def next_work(periods: DataFrame, watchlist: DataFrame, usable: DataFrame, skipped: DataFrame, as_of: date) -> DataFrame:
    return open_work(periods, watchlist, usable, skipped, as_of).orderBy("period_ord", "ord").limit(1)


def next_ticker(watchlist: DataFrame, usable: DataFrame) -> DataFrame:
    """The first ticker without a usable report; skipped ones count as without."""
    return watchlist.join(usable.select("ticker"), "ticker", "left_anti").orderBy("ord").limit(1)


def sector_scores(watchlist: DataFrame, history: DataFrame, disclosures: DataFrame, this_week: str) -> DataFrame:
    """Sectors of two tickers or more: weeks since they were last covered (NEVER if not), disclosures, score and rank."""
    sectors = watchlist.groupBy("sector").agg(F.count("*").alias("members"), F.min("ord").alias("ord"), F.array_sort(F.collect_list("ticker")).alias("tickers")).where("members >= 2")
    last = history.groupBy("sector").agg(F.max("iso_week").alias("last_week"))
    joined = sectors.join(last, "sector", "left").join(disclosures.select("sector", "n"), "sector", "left")
    weeks = F.when(F.col("last_week").isNull(), F.lit(NEVER)).otherwise(weeks_between(F.col("last_week"), F.lit(this_week)))
    out = joined.withColumn("weeks_since", weeks.cast("int")).withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.withColumn("score", F.col("weeks_since") * 1 + F.col("n") * 2)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ord")))


def pick_sector(watchlist: DataFrame, history: DataFrame, disclosures: DataFrame, this_week: str) -> DataFrame:
    return sector_scores(watchlist, history, disclosures, this_week).where("rank = 1")


def sector_comparison(watchlist: DataFrame, snapshots: DataFrame, sector: str) -> DataFrame:
    """The sector's tickers with their snapshot, available or not."""
    own = watchlist.where(F.col("sector") == sector)
    return own.join(snapshots.withColumn("found", F.lit(True)), "ticker", "left").withColumn("available", F.coalesce("found", F.lit(False))).drop("found")


def to_render(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources (name, modified) without a target, or modified after it."""
    out = sources.join(targets.select("name", F.col("modified").alias("rendered")), "name", "left")
    return out.where("rendered is null or modified > rendered")


def stale(targets: DataFrame, sources: DataFrame) -> DataFrame:
    return targets.join(sources.select("name"), "name", "left_anti")
