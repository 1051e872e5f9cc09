"""Substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Its minimiser is the least hash of the runs of ``run``
words inside it. Consecutive windows with the same minimiser travel as one packed string to the minimiser's bucket;
equal windows have equal minimisers and so meet there, where sorting counts them exactly.

1. Count the different super-k-mers and the documents of each minimiser (map-side combined). A bucket of one document
   has nothing to remove and is left out before any text moves. Where a minimiser has over ``hot_documents``
   different super-k-mers, its windows are divided by a second minimiser, of longer runs, counted in the same way.
2. Pack the windows of the other buckets, combine equal strings (keeping the smallest doc_id) and send the
   different strings to their buckets. Only where the second minimiser is hot too, a string is one window, and that
   window is its own bucket: equal windows combine on the map side and the rest spread out.
3. In a bucket, rank all windows by sorting (prefix doubling over exact word ids) and find the smallest doc_id of each.
4. Send back, per string, which windows are repeats; a document that has a string but isn't its owner repeats all of it.

What is used twice is written once. A bucket holds ``hot_documents`` strings of ``LONGEST_RUN`` windows at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, as_signed, chunks, mixed, rolled, sliding_min, words_of
from .shared import materialise

NO_ID = -(1 << 63)  # stands for a null doc_id
LONGEST_RUN = 256  # windows in one packed string
BUCKET_BYTES = 2 << 20  # packed bytes that are ranked together, if buckets are smaller


def _windows(words: Words, window: int) -> np.ndarray:
    """The first word of each window."""
    counts = np.maximum(np.diff(words.rows) - window + 1, 0)
    begin = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - np.repeat(begin, counts) + np.repeat(words.rows[:-1], counts)


def _first_minimisers(hashes: np.ndarray, at: np.ndarray, window: int, run: int) -> np.ndarray:
    return sliding_min(rolled(hashes, run), window - run + 1)[at]


def _second_minimisers(hashes: np.ndarray, at: np.ndarray, first: np.ndarray, window: int, run: int) -> np.ndarray:
    """Of runs half the window's length or three times the first's, whichever is more; together with the first."""
    run = max(window // 2, min(3 * run, window))
    return mixed(first ^ sliding_min(rolled(hashes, run, 2), window - run + 1)[at])


def _super_kmers(at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer. Windows are named by their first word."""
    if not len(at):
        return at, at, value
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    pieces = -(-size // LONGEST_RUN)
    part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(first, pieces) + part * LONGEST_RUN
    size = np.minimum(np.repeat(size, pieces) - part * LONGEST_RUN, LONGEST_RUN)
    return at[first], size, value[first]


def _minimisers(batches: Iterator[pa.RecordBatch], window: int, run: int, second: bool) -> Iterator[pa.RecordBatch]:
    """Different super-k-mers of each document, by minimiser and a hash of their words; second: those of windows whose
    first minimiser is hot."""
    for batch in batches:
        for part in chunks(batch, "text"):
            words = words_of(part.column("text"))
            hashes, at = words.hashes(), _windows(words, window)
            value = _first_minimisers(hashes, at, window, run)
            if second:
                hot = np.isin(value, as_unsigned(part.column("hot").flatten()))
                at, value = at[hot], _second_minimisers(hashes, at[hot], value[hot], window, run)
            first, size, value = _super_kmers(at, value)
            sums = np.append(np.uint64(0), np.cumsum(rolled(hashes, 2, 3)))  # of pairs of words, up to each
            words_hash = sums[first + size + window - 2] - sums[first] if len(first) else value
            row = np.searchsorted(words.rows, first, "right") - 1
            order = np.lexsort((words_hash, value, row))
            row, value, words_hash = row[order], value[order], words_hash[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1]) | (words_hash[1:] != words_hash[:-1])
            at = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("text_hash").take(at), pa.array(as_signed(value[new])), pa.array(as_signed(words_hash[new]))], ["doc_id", "text_hash", "minimiser", "words_hash"])


def _pack(batches: Iterator[pa.RecordBatch], window: int, run: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_hash", "first", "windows", "bucket", "digest", "packed"]
    for batch in batches:
        for part in chunks(batch, "text"):
            words = words_of(part.column("text"))
            hashes, at = words.hashes(), _windows(words, window)
            value = _first_minimisers(hashes, at, window, run)
            cool, hot, second_cool, second_hot = (as_unsigned(part.column(c).flatten()) for c in ("cool", "hot", "second_cool", "second_hot"))
            is_cool, is_hot = np.isin(value, cool), np.isin(value, hot)
            second = _second_minimisers(hashes, at[is_hot], value[is_hot], window, run)
            singles = at[is_hot][np.isin(second, second_hot)]
            second_too = np.isin(second, second_cool)
            found = [_super_kmers(at[is_cool], value[is_cool]), _super_kmers(at[is_hot][second_too], second[second_too]), (singles, np.ones(len(singles), np.int64), np.zeros(len(singles), np.uint64))]
            first, size, value = (np.concatenate(x) for x in zip(*found, strict=True))
            row = np.searchsorted(words.rows, first, "right") - 1
            data = words.data.tobytes()
            packed = [data[a:b] for a, b in zip(words.at[first].tolist(), words.at[first + size + window - 1].tolist(), strict=True)]
            digest = [xxhash.xxh3_128_digest(x) for x in packed]
            alone = len(first) - len(singles)
            value[alone:] = mixed(np.fromiter((int.from_bytes(x[:8], "little") for x in digest[alone:]), np.uint64, len(singles)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), part.column("text_hash").take(pa.array(row)), pa.array(first - words.rows[row]), pa.array(size), pa.array(as_signed(value)), pa.array(digest, pa.binary()), pa.array(packed, pa.binary())], names)


def as_unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _window_ranks(ids: np.ndarray, window: int) -> np.ndarray:
    """Equal numbers for equal runs of ``window`` ids from each place on; places too near the end get any number."""

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)

    rank, span = ids, 1
    while span * 2 <= window:
        rank, span = joined(rank, np.roll(rank, -span)), span * 2
    return joined(rank, np.roll(rank, span - window)) if span < window else rank


def _repeats(strings: pa.Table, window: int) -> pa.RecordBatch:
    """Which windows of each string also start in a smaller document; strings of whole buckets."""
    packed, owner = strings.column("packed").combine_chunks(), strings.column("owner").to_numpy()
    words = words_of(packed)
    ids, _ = words.encoded()
    rank = _window_ranks(ids, window)
    counts = np.diff(words.rows) - window + 1
    string = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    rank = rank[words.rows[:-1][string] + nth]
    order = np.argsort(rank, kind="stable")
    group = np.flatnonzero(np.append(True, np.diff(rank[order]) > 0))
    smallest = np.empty(len(rank), np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(owner[string][order], group), np.diff(np.append(group, len(rank))))
    repeat = smallest < owner[string]
    edge = np.diff(np.concatenate([[False], repeat, [False]]).astype(np.int8))
    edge_at = np.zeros(len(repeat) + 1, bool)
    edge_at[np.cumsum(counts)] = True
    edge_at[0] = True
    start = np.flatnonzero(repeat & ((edge[:-1] == 1) | edge_at[:-1]))
    end = np.flatnonzero(repeat & ((edge[1:] == -1) | edge_at[1:])) + 1
    per = np.bincount(string[start], minlength=len(counts))
    offsets = pa.array(np.append(0, np.cumsum(per)), pa.int32())
    low = nth[start]
    struct = pa.StructArray.from_arrays([pa.array(low), pa.array(low + end - start)], ["lo", "hi"])
    digest = pa.array([xxhash.xxh3_128_digest(x) for x in packed.to_pylist()], pa.binary())
    return pa.RecordBatch.from_arrays([digest, strings.column("owner").combine_chunks(), pa.ListArray.from_arrays(offsets, struct)], ["digest", "owner", "repeats"])


def _count_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; whole buckets are ranked together, some MB at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        bucket = batch.column("bucket").to_numpy()
        if size >= BUCKET_BYTES and (held[0].column("bucket")[0].as_py() != bucket[-1]):
            table = pa.Table.from_batches(held)
            keys = table.column("bucket").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            yield _repeats(table.slice(0, cut), window)
            held = table.slice(cut).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held)
    if held:
        yield _repeats(pa.Table.from_batches(held), window)


def _remove(batches: Iterator[pa.RecordBatch], window: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            words = words_of(part.column("text"))
            lists = part.column("cuts").fill_null([]) if part.column("cuts").null_count else part.column("cuts")
            n = np.diff(lists.offsets.to_numpy())
            flat, base = lists.flatten(), np.repeat(words.rows[:-1], n)
            change = np.zeros(len(words) + 1, np.int32)
            np.add.at(change, base + flat.field("lo").to_numpy(zero_copy_only=False), 1)
            np.add.at(change, base + flat.field("hi").to_numpy(zero_copy_only=False) + window - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = words.data[np.repeat(~gone, np.diff(words.at))]
            sizes = np.append(0, np.cumsum(np.where(gone, 0, np.diff(words.at))))[words.rows]
            data = kept.tobytes()
            texts = [data[a : max(a, b - 1)] for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]
            removed = np.append(0, np.cumsum(gone))[words.rows]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(np.diff(words.rows)), pa.array(np.diff(removed)), pa.array(texts, pa.binary()).cast(pa.string())], [*names, "n_words", "n_removed", "kept_text"])


def _wanted(docs: DataFrame, window: int, run: int, most: int, second: bool) -> tuple[DataFrame, bool]:
    """Of each text its minimisers that another document has too: cool and hot ones; and whether any is hot."""
    found = docs.mapInArrow(partial(_minimisers, window=window, run=run, second=second), "doc_id long, text_hash long, minimiser long, words_hash long")
    found = materialise(found, "minimisers")
    different = found.groupBy("minimiser", "words_hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    shared = different.groupBy("minimiser").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    shared = materialise(shared.select("minimiser", (F.col("n") > most).alias("is_hot")), "shared")
    one = lambda hot: F.collect_set(F.when(F.col("is_hot") == hot, F.col("minimiser")))
    wanted = found.join(shared, "minimiser").groupBy("doc_id", "text_hash").agg(one(False).alias("cool"), one(True).alias("hot"))
    return wanted, not shared.where("is_hot").isEmpty()


def substring_dedup(docs: DataFrame, window: int = 50, run: int = 8, hot_documents: int = 2000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in ``carry`` (text may be one), n_words, n_removed and kept_text (the kept words, one
    space between) of every row.

    A word goes if a window over it also starts in a document of a smaller doc_id; windows are judged on the input.
    Null text: no words, empty kept_text. Null doc_id: the row keeps all and takes nothing from others. Repeated rows
    of one doc_id are one document: they don't remove each other. A text of
    any length is held whole by its task. Texts under ``window`` words keep all. Columns not
    in ``carry`` aren't read; the operator's own columns have names of their own inside, so none can clash, unless
    carried under the names of its results. An empty table gives an empty table.
    """
    # a key that can't be null keeps both joins' filters away, so that the texts are shuffled once for both
    extra = [c for c in carry if c != "text"]
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"), *(F.col(c).alias(f"carried_{c}") for c in extra))
    some = docs.where((F.col("doc_id") != NO_ID) & F.col("text").isNotNull())
    wanted, hot = _wanted(some, window, run, hot_documents, second=False)
    of_hot = wanted.where(F.size("hot") > 0).select("doc_id", "text_hash", "hot")
    if hot:
        second, _ = _wanted(docs.join(of_hot, ["doc_id", "text_hash"]), window, run, hot_documents, second=True)
        wanted = wanted.join(second.toDF("doc_id", "text_hash", "second_cool", "second_hot"), ["doc_id", "text_hash"], "left")
    else:
        wanted = wanted.withColumns({c: F.lit(None).cast("array<long>") for c in ("second_cool", "second_hot")})
    schema = "doc_id long, text_hash long, first long, windows long, bucket long, digest binary, packed binary"
    packed = materialise(docs.join(wanted, ["doc_id", "text_hash"]).mapInArrow(partial(_pack, window=window, run=run), schema), "packed")
    strings = packed.groupBy("bucket", "packed").agg(F.min("doc_id").alias("owner"))
    counted = strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(partial(_count_windows, window=window), "digest binary, owner long, repeats array<struct<lo:long,hi:long>>")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("windows").alias("hi")))
    cuts = (
        packed.drop("packed", "bucket")
        .join(counted, "digest")
        .withColumn("repeats", F.when(F.col("doc_id") > F.col("owner"), all_of_it).otherwise(F.col("repeats")))
        .where(F.size("repeats") > 0)
        .select("doc_id", "text_hash", F.transform("repeats", lambda x: F.struct((F.col("first") + x.lo).alias("lo"), (F.col("first") + x.hi).alias("hi"))).alias("cuts"))
        .groupBy("doc_id", "text_hash")
        .agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    )
    names = ["doc_id", *(["text"] if "text" in carry else []), *(f"carried_{c}" for c in extra)]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    out = docs.join(cuts, ["doc_id", "text_hash"], "left").mapInArrow(partial(_remove, window=window, names=names), f"{kinds}, n_words long, n_removed long, kept_text string")
    out = out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
    return out.withColumnsRenamed({f"carried_{c}": c for c in extra})


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
