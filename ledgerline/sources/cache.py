"""A read-through cache of rows by key: what is young enough is served, the rest is fetched and kept.

Under the cache's folder, rows/version=N holds what the N-th fetch brought and manifest/version=N the keys it brought it
for: fetched_at and the number of rows. A key's rows are those of the newest version whose manifest names it. The
manifest is written last and counts once it is whole, so readers see a fetch whole or not at all, and a fetch that broke
off is fetched again. One writer at a time; readers need no lock.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .versions import committed, drop_versions, read_versions, write_version


@dataclass(frozen=True)
class Cache:
    """rows: the schema of what is kept, with the key; ttl_hours: how old it may be; least_rows: fewer aren't served."""

    folder: str
    rows: StructType
    key: str = "ticker"
    ttl_hours: float = 6
    least_rows: int = 1


def manifest(spark: SparkSession, cache: Cache) -> DataFrame:
    """key, fetched_at, n_rows and version of each key's newest fetch."""
    key = cache.rows[cache.key]
    schema = StructType([key]).add("fetched_at", "timestamp").add("n_rows", "long")
    found = read_versions(spark, f"{cache.folder}/manifest", schema)
    newest = F.max_by(F.struct("fetched_at", "n_rows", "version"), "version")
    return found.groupBy(cache.key).agg(newest.alias("newest")).select(cache.key, "newest.*")


def fresh(known: DataFrame, cache: Cache, as_of: datetime) -> DataFrame:
    """The manifest's keys that may be served at ``as_of``; ages are counted between whole seconds of the clock."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("fetched_at")
    return known.where((age < cache.ttl_hours * 3600) & (F.col("n_rows") >= cache.least_rows))


def cached(spark: SparkSession, cache: Cache, keys: DataFrame | None = None) -> DataFrame:
    """All rows that the cache holds, however old, with fetched_at; of the given rows of ``manifest`` only, if any."""
    keys = manifest(spark, cache) if keys is None else keys
    versions = committed(spark, f"{cache.folder}/manifest")
    rows = read_versions(spark, f"{cache.folder}/rows", cache.rows, versions)
    return rows.join(keys.select(cache.key, "version", "fetched_at"), [cache.key, "version"]).drop("version")


def read_through(wanted: DataFrame, cache: Cache, fetch: Callable[[DataFrame], DataFrame], as_of: datetime) -> DataFrame:
    """The rows of the wanted keys, with fetched_at. Keys that the cache has fresh come from it; the others are handed to
    ``fetch``, once each, and what it gives for them is kept (rows of other keys aren't). Keys for which it gives
    no row, or under ``least_rows``, are asked for again the next time; what little there is is given. Null keys aren't
    fetched. Whatever was in the cache for keys that aren't wanted stays."""
    spark = wanted.sparkSession
    keys = wanted.select(F.col(cache.key).cast(cache.rows[cache.key].dataType).alias(cache.key)).where(F.col(cache.key).isNotNull()).distinct()
    young = fresh(manifest(spark, cache), cache, as_of)
    stale = keys.join(young, cache.key, "left_anti")
    if not stale.isEmpty():
        numbers = committed(spark, f"{cache.folder}/manifest")
        version = (numbers[-1] if numbers else 0) + 1
        brought = fetch(stale).select(*cache.rows.names).join(stale, cache.key, "left_semi")
        write_version(brought, f"{cache.folder}/rows", version)
        kept = spark.read.schema(cache.rows).parquet(f"{cache.folder}/rows/version={version}")
        entries = kept.groupBy(cache.key).agg(F.lit(as_of).cast("timestamp").alias("fetched_at"), F.count("*").alias("n_rows"))
        write_version(entries, f"{cache.folder}/manifest", version)
    newest = manifest(spark, cache)
    at_hand = newest.join(fresh(newest, cache, as_of).select(cache.key), cache.key, "left_semi").unionByName(newest.where((F.col("fetched_at") == F.lit(as_of).cast("timestamp")) & (F.col("n_rows") < cache.least_rows)))
    return cached(spark, cache, at_hand.join(keys, cache.key, "left_semi"))


def superseded(spark: SparkSession, cache: Cache) -> list[int]:
    """Versions of which no key is the newest, in order: a list as long as the number of fetches at most."""
    in_use = {r.version for r in manifest(spark, cache).select("version").distinct().collect()}
    return [n for n in committed(spark, f"{cache.folder}/manifest")[:-1] if n not in in_use]


def vacuum(spark: SparkSession, cache: Cache) -> None:
    """Removes superseded versions: the manifest's entry first, then the rows. Not while older readers still run."""
    gone = superseded(spark, cache)
    drop_versions(spark, f"{cache.folder}/manifest", gone)
    drop_versions(spark, f"{cache.folder}/rows", gone)
