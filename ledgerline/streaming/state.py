"""Streams with a state of their own: newest rows by number, and answers that may be served for a while.

Both keep their state in RocksDB, so that it needn't fit in an executor's memory.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """What a session needs before a query with these processors starts; queries that have begun keep what they have."""
    spark.conf.set(PROVIDER, ROCKSDB)


class NewestRows(StatefulProcessor):
    """Each key's newest ``n`` rows by ``order``, whenever they come: a late row takes its place among them. Of rows with
    the same place the one that came last stays. A batch holds no more than n rows of a key at a time."""

    def __init__(self, n: int, key: str, order: str, row: StructType):
        self.n, self.key, self.order, self.row = n, key, order, row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("newest", self.row)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = {self._place(tuple(r)): tuple(r) for r in self.state.get()} if self.state.exists() else {}
        heap = list(newest)
        heapq.heapify(heap)
        for row in rows:
            row = tuple(row[name] for name in self.row.names)
            place = self._place(row)
            if place in newest:
                newest[place] = row
            elif len(heap) < self.n:
                heapq.heappush(heap, place)
                newest[place] = row
            elif place > heap[0]:
                newest.pop(heapq.heapreplace(heap, place))
                newest[place] = row
        kept = [newest[place] for place in sorted(newest, reverse=True)]
        self.state.put(kept)
        yield Row(self.key, "newest")(key[0], [Row(*self.row.names)(*row) for row in kept])

    def _place(self, row: tuple):
        return row[self.row.names.index(self.order)]

    def close(self) -> None:
        pass


def newest_rows(stream: DataFrame, n: int, key: str = "ticker", order: str = "dt") -> DataFrame:
    """For each batch and key that it brings rows of: the key and newest, its newest n rows so far (without the key), newest
    first. Rows without an order value have no place and are left out. Operators over the last n rows (not days) give
    the same on these as on the whole table; in update mode a key's last row is what counts."""
    keep_state(stream.sparkSession)
    row = StructType([f for f in stream.schema if f.name != key])
    out = StructType([stream.schema[key]]).add("newest", ArrayType(row))
    return stream.where(F.col(order).isNotNull()).groupBy(key).transformWithState(NewestRows(n, key, order, row), out, "Update", "None")


def unpacked(newest: DataFrame, batch: str = "version", key: str = "ticker") -> DataFrame:
    """The rows of the last update of each key, as a table like the one that was streamed."""
    last = newest.groupBy(key).agg(F.max_by("newest", batch).alias("newest"))
    return last.select(key, F.explode("newest").alias("row")).select(key, "row.*")


class Served(StatefulProcessor):
    """Whether what a key asks for has been fetched within ``ttl_ms``: state that expires by itself."""

    def __init__(self, ttl_ms: int, key: str):
        self.ttl_ms, self.key = ttl_ms, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fetched = handle.getValueState("fetched", StructType().add("asked", LongType()), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = sum(1 for _ in rows)
        known = self.fetched.exists()
        if not known:
            self.fetched.update((n,))
        yield Row(self.key, "asked", "fetch")(key[0], n, not known)

    def close(self) -> None:
        pass


def to_fetch(requests: DataFrame, ttl_ms: int, key: str = "ticker") -> DataFrame:
    """For each batch and key asked for: the key, asked (requests in the batch) and fetch: whether it has to be fetched,
    as it never was or ``ttl_ms`` have gone by (by the clock) since it last was; otherwise it is served from what is kept.
    Serving doesn't lengthen its time."""
    keep_state(requests.sparkSession)
    out = StructType([requests.schema[key]]).add("asked", LongType()).add("fetch", BooleanType())
    return requests.groupBy(key).transformWithState(Served(ttl_ms, key), out, "Update", "ProcessingTime")
