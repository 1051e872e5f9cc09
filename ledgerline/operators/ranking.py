"""Ranks and running sums over orders of any length: by ranges of the order, no one of which is the whole."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import write_once

PLACE_BITS = 33  # of monotonically_increasing_id: the row's number inside its partition, which stands above them


def ranked(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds the rank (from 1) in an order that has no ties. Rows are dealt out by ranges of the order and sorted inside
    each; a row's rank is its place there and the rows of all ranges before. Only the ranges' counts meet on the driver,
    one number for each partition."""
    rows = write_once(rows, "unranked")  # ranges are found by a sample, which would compute the rows twice
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = write_once(placed, "ranks")
    part = F.shiftright("_place", PLACE_BITS)
    sizes = sorted((r["_range"], r["count"]) for r in placed.groupBy(part.alias("_range")).count().collect())
    before = list(accumulate((n for _, n in sizes), initial=0))
    starts = rows.sparkSession.createDataFrame([(k, b) for (k, _), b in zip(sizes, before, strict=False)], "_range long, _before long")
    rank = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    return placed.withColumn("_range", part).join(F.broadcast(starts), "_range").withColumn(name, rank).drop("_place", "_range", "_before")


def running(rows: DataFrame, by: str, order: str, sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum over the rows of the same ``by`` that come before in the order, and as name_all that
    over all of them. Sums of ranges first, then inside each range, so that a key of any size isn't one task. Nulls of
    ``by`` are one key, null values count as 0."""
    rows = write_once(rows, "unsummed")
    ranged = write_once(rows.repartitionByRange(F.col(by), F.col(order)).withColumn("_range", F.spark_partition_id()), "running")
    per = ranged.groupBy(F.col(by).alias("_by"), "_range").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"{name}_here") for name, c in sums.items()))
    key = Window.partitionBy("_by")  # as many rows as ranges at most
    earlier = key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    for name in sums:
        per = per.withColumn(f"{name}_before", F.coalesce(F.sum(f"{name}_here").over(earlier), F.lit(0))).withColumn(f"{name}_all", F.sum(f"{name}_here").over(key))
    per = per.withColumnRenamed("_range", "_its").drop(*(f"{name}_here" for name in sums))
    inside = Window.partitionBy("_range", by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    for name, value in sums.items():
        ranged = ranged.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    out = ranged.join(per, (F.col("_range") == F.col("_its")) & F.col(by).eqNullSafe(F.col("_by")))
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.col(f"{name}_before"))
    return out.drop("_range", "_its", "_by", *(f"{name}_before" for name in sums))


def budgets(docs: DataFrame, most: int, total: int, key: str = "grp", order: str = "ord", size: str = "n_chars") -> DataFrame:
    """Adds budget: each row of a key gets an equal share of ``total`` (no more than its size and ``most``), and what
    is left goes to the rows in order. A key may hold any number of rows."""
    counts = docs.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    rows = docs.join(counts, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    want = F.least(F.col(size), F.lit(most))
    rows = rows.withColumn("_base", F.least(want, F.greatest(F.lit(1), F.floor(F.lit(total) / F.col("_n"))))).withColumn("_room", want - F.col("_base"))
    rows = running(rows, key, order, {"_bases": F.col("_base"), "_rooms": F.col("_room")})
    rest = F.lit(total) - F.col("_bases_all") - F.col("_rooms")
    budget = (F.col("_base") + F.least("_room", F.greatest(rest, F.lit(0)))).cast("long")
    return rows.withColumn("budget", budget).select(*docs.columns, "budget")
