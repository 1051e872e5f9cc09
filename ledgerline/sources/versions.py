"""Tables in versions: a version is seen whole or not at all.

Each is a folder of its own, version=N, that counts from the moment its job has been committed (_SUCCESS). Readers list
committed versions only, so that a write that is under way, or that was broken off, changes nothing for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "_SUCCESS"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def committed(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the versions that are whole, in order."""
    files, place = _folder(spark, root)
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()]
    numbers = sorted(int(n[8:]) for n in names if n.startswith("version=") and n[8:].isdigit())
    return [n for n in numbers if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/version={n}/{MARK}"))]


def write_version(df: DataFrame, root: str, number: int) -> None:
    """Writes a version; what a broken write left under its number goes."""
    df.write.mode("overwrite").parquet(f"{root}/version={number}")


def read_versions(spark: SparkSession, root: str, schema, numbers: list[int] | None = None) -> DataFrame:
    """The rows of the committed versions (or of those given), with their version."""
    numbers = committed(spark, root) if numbers is None else numbers
    if not numbers:
        return spark.createDataFrame([], schema).withColumn("version", F.lit(0))
    paths = [f"{root}/version={n}" for n in numbers]
    return spark.read.schema(schema).option("basePath", root).parquet(*paths)


def drop_versions(spark: SparkSession, root: str, numbers: list[int]) -> None:
    for n in numbers:
        files, place = _folder(spark, f"{root}/version={n}")
        files.delete(place, True)
