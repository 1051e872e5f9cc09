"""Structured Streaming forms of what is scheduled polling otherwise: an extension, the batch operators are canonical."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.planner import to_render
from ..sources.versions import committed, read_versions, write_version


def files(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """New files of a folder or pattern as a stream."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def with_event_time(stream: DataFrame, column: str, late: str) -> DataFrame:
    """With a watermark; times without a zone are taken as of the session's."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def new_filings(stream: DataFrame, key: str = "rcept_no", time: str = "rcept_ts", late: str = "2 days") -> DataFrame:
    """Each filing once, as long as its copies come within ``late``."""
    return with_event_time(stream, time, late).dropDuplicatesWithinWatermark([key])


def windowed_sums(stream: DataFrame, key: str, time: str, value: str, width: str = "3 days", every: str | None = "1 day", late: str = "1 day") -> DataFrame:
    """Sums and counts by key and window of time (days, not rows: not the batch operator's windows)."""
    timed = with_event_time(stream, time, late)
    window = F.window(time, width, every) if every else F.window(time, width)
    return timed.groupBy(key, window.alias("w")).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "total", "n")


def sessions(stream: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of a key's events that are less than ``gap`` apart."""
    timed = with_event_time(stream, time, late)
    return timed.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(write: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps what ``write`` makes of a batch as the version of the batch's number. A batch that is
    delivered again after its version was committed writes nothing, one that broke off is written anew; either way its
    rows are there once (``sources.versions.read_versions``)."""

    def on_batch(batch: DataFrame, number: int) -> None:
        if number in committed(batch.sparkSession, path):
            batch.write.format("noop").mode("overwrite").save()  # a stream with state has to commit it
        else:
            write_version(write(batch), path, number)

    return on_batch


def render_changes(targets: Callable[[], DataFrame], render: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: what ``render`` makes of a batch's sources that have no target or a newer one than it, each
    batch once."""
    return once(lambda batch: render(to_render(batch, targets())), path)


def rendered(spark: SparkSession, path: str, schema, key: str = "name") -> DataFrame:
    """The newest rendering of each source, of the batches that are whole."""
    rows = read_versions(spark, path, schema)
    names = [f.name for f in rows.schema if f.name not in (key, "version")]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*names), "version").alias("newest"))
    return newest.select(key, "newest.*")


EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", empty_batches: bool = True) -> DataFrame:
    """Runs a stream over what there is now; the rows of all batches so far, each batch once, with its number as version.
    A stream that is started again with the same folders goes on where it ended. State that expires by the clock asks for
    batches without data for ever, so such a stream ends only without ``empty_batches``."""
    spark = stream.sparkSession
    before = spark.conf.get(EMPTY_BATCHES)
    spark.conf.set(EMPTY_BATCHES, str(empty_batches).lower())  # a query takes the setting when it starts
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(once(lambda batch: batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(EMPTY_BATCHES, before)
    query.awaitTermination()
    return read_versions(spark, path, stream.schema)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is now, writing each batch's rows as Parquet; the result of the last batch in
    complete mode, of all in others."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
