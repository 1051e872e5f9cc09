"""Writers of snapshots, notes and health rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime
from functools import partial

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import as_uri


def _write_files(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = fs.FileSystem.from_uri(folder)
    made = {root}
    for batch in batches:
        for name, text in zip(batch.column("name"), batch.column("text"), strict=True):
            parent, _, last = f"{root}/{name.as_py()}".rpartition("/")
            if parent not in made:
                files.create_dir(parent, recursive=True)
                made.add(parent)
            begun = f"{parent}/.{last}-{uuid.uuid4().hex}"  # readers pass over names with a dot
            with files.open_output_stream(begun) as file:
                file.write((text.as_py() or "").encode())
            files.move(begun, f"{parent}/{last}")
    yield from ()


def write_files(texts: DataFrame, path: str) -> None:
    """Writes a file for each row (name, which may have folders in it, and text) into a new folder, from the tasks that have
    the rows: there is no shuffle and no list of files on the driver. A file is seen whole or not at all, and a task that
    runs again writes the same ones."""
    folder = as_uri(path)
    files, root = fs.FileSystem.from_uri(folder)
    if files.get_file_info(root).type != fs.FileType.NotFound:
        raise ValueError(f"{path} exists")
    files.create_dir(root, recursive=True)
    texts.select("name", "text").mapInArrow(partial(_write_files, folder=folder), "name string").write.format("noop").mode("overwrite").save()


def write_snapshot(df: DataFrame, path: str, *partitions: str) -> None:
    """Parquet by company and period (or others); only the partitions that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_text(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column)).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_health(spark: SparkSession, path: str, timer: str, status: str, last_run: datetime, **details: str) -> None:
    row = spark.createDataFrame([(timer, last_run, status, details)], "timer string, last_run timestamp, status string, details map<string,string>")
    row.write.mode("append").json(path)


def skip(spark: SparkSession, path: str, ticker: str, period: str) -> None:
    """Marks a period of a ticker as not to be tried again."""
    spark.createDataFrame([(ticker, period)], "ticker string, period_label string").write.mode("append").parquet(path)
