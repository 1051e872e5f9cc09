"""Row-offset time series: every window counts rows of its key, not days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.numbers import pct_change


def ascending(key: str = "ticker", order: str = "dt") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def newest_first(key: str = "ticker", order: str = "dt") -> WindowSpec:
    return Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())


def latest(df: DataFrame, n: int = 1, key: str = "ticker", order: str = "dt") -> DataFrame:
    """Each key's n newest rows, with rn from 1 for the newest."""
    return df.withColumn("rn", F.row_number().over(newest_first(key, order))).where(F.col("rn") <= n)


def one_row_change(bars: DataFrame) -> DataFrame:
    """Adds prev_close and pct_change against the row before; 0.0 where that was 0; the first row has neither."""
    prev = F.lag("close").over(ascending())
    return bars.where("close is not null").withColumn("prev_close", prev).withColumn("pct_change", pct_change(F.col("close"), F.col("prev_close"), F.lit(0.0)))


def change_over_rows(bars: DataFrame, rows: int = 60) -> DataFrame:
    """Adds pct against the ``rows``-th newest row, that is rows - 1 intervals back; null with fewer rows."""
    return bars.withColumn("pct", pct_change(F.col("close"), F.lag("close", rows - 1).over(ascending())))


def change_over_rows_or_first(bars: DataFrame, rows: int = 240) -> DataFrame:
    """As change_over_rows(); with fewer rows (two at least) against the first."""
    first = F.first("close").over(ascending().rowsBetween(Window.unboundedPreceding, 0))
    nth = F.row_number().over(ascending())
    base = F.when(nth >= rows, F.lag("close", rows - 1).over(ascending())).when(nth >= 2, first)
    return bars.withColumn("pct", pct_change(F.col("close"), base))


def volume_score(bars: DataFrame, rows: int = 60, least: int = 10) -> DataFrame:
    """Adds mean, std and z of the volume over the last rows, this one included; z is null where the deviation is 0 or
    there are fewer than ``least`` rows."""
    frame = ascending().rowsBetween(-(rows - 1), 0)
    out = bars.withColumn("n", F.count("volume").over(frame)).withColumn("mean", F.avg("volume").over(frame)).withColumn("std", F.stddev_samp("volume").over(frame))
    z = (F.col("volume") - F.col("mean")) / F.nullif("std", F.lit(0.0))
    return out.withColumn("z", F.when(F.col("n") >= least, z)).drop("n")


def guarded_mean(bars: DataFrame, rows: int = 60, least: int = 10) -> DataFrame:
    """Adds avg_volume over the last rows, null with fewer than ``least``."""
    frame = ascending().rowsBetween(-(rows - 1), 0)
    return bars.withColumn("avg_volume", F.when(F.count("volume").over(frame) >= least, F.avg("volume").over(frame)))


def tail(bars: DataFrame, rows: int = 60, value: str = "close") -> DataFrame:
    """Each key's newest values as an array, oldest first; shorter series are whole."""
    found = latest(bars.where(F.col(value).isNotNull()), rows)
    return found.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("dt", value))), lambda x: x[value]).alias("series"))


def normalised_points(series: Column) -> Column:
    """Points (x, y) of an array of values: x from 0 to 1 by place, y 1 for the least value and 0 for the greatest."""
    n, low = F.size(series), F.array_min(series)
    span = F.coalesce(F.nullif(F.array_max(series) - low, F.lit(0.0)), F.lit(1.0))
    x = lambda i: F.when(n > 1, i / (n - 1)).otherwise(F.lit(0.0))
    return F.transform(series, lambda v, i: F.struct(x(i).alias("x"), (1 - (v - low) / span).alias("y")))


def polyline(series: Column, width: float, height: float) -> Column:
    """The points as "x,y x,y" with one decimal."""
    return F.array_join(F.transform(normalised_points(series), lambda p: F.format_string("%.1f,%.1f", p.x * width, p.y * height)), " ")


def delta_rows(df: DataFrame, value: str, rows: int = 5) -> DataFrame:
    """Each key's newest value less the one ``rows`` rows before; null with fewer rows."""
    lagged = df.withColumn("delta", F.col(value) - F.lag(value, rows).over(ascending()))
    return latest(lagged).drop("rn")


def indicator_snapshot(bars: DataFrame, rows: int = 60) -> DataFrame:
    """Per key: latest, change_1d, pct_1d, pct_since_first and pct_tail (over the last rows, where their first is above 0)."""
    prices = bars.where("close is not null")
    whole = ascending().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = prices.withColumn("first", F.first("close").over(whole)).withColumn("prev", F.lag("close").over(ascending()))
    nth = F.row_number().over(newest_first())
    start = F.first("close").over(ascending().rowsBetween(-(rows - 1), 0))
    out = out.withColumn("tail_first", start).withColumn("nth", nth).where("nth = 1")
    return out.select(
        "ticker", F.col("close").alias("latest"), (F.col("close") - F.col("prev")).alias("change_1d"), pct_change(F.col("close"), F.col("prev")).alias("pct_1d"),
        pct_change(F.col("close"), F.col("first")).alias("pct_since_first"), F.when(F.col("tail_first") > 0, pct_change(F.col("close"), F.col("tail_first"))).alias("pct_tail"),
    )


def trend(change: Column, band: float = 0.5) -> Column:
    return F.when(change > band, "up").when(change < -band, "down").otherwise("flat")
