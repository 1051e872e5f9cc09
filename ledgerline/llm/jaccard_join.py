"""N-gram Jaccard join by chosen paths.

A text is the set of its runs of ``n`` words, and the set a signature of minima of ``PLACES`` hashes; two sets agree
at a place with a chance of their Jaccard similarity. In each run a signature chooses some of its (place, minimum)
pairs, the same ones in all signatures that have them, and goes to a bucket for each. In buckets over ``small`` sets
those alike the bucket's first set are linked to it, and the others choose again, to ``depth`` levels; small ones are compared all with all,
and so are large ones that are left at the last level, by pairs of blocks of about ``small`` sets. ``runs`` repeats make up
for pairs whose choices die out: with 1 / CHOICE pairs chosen on average, a pair of similarity 0.8 is missed by one
run with a chance of 0.2 (one level) to 0.32 (three), by twelve with one in 10**6 at most.

What the buckets find are candidate links, handed on as stars. Each component of them is then compared exactly, on
the sets of hashed n-grams, all members with all; a component over ``most`` members is cut in blocks and each pair of
blocks compared, so that nothing is lost and no task holds more than two blocks. A set goes to as many cells as its
component has blocks, so a component of M different sets ships 2 M^2 / most sets of hashes.

Sets are told apart by their digest and named by a number of their own, never by a doc_id, which may come with several
texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, as_signed, chunks, flat_bytes, mixed, multipliers, rolled, words_of
from .components import components
from .shared import materialise

PLACES = 64
CHOICE = 0.5
SLACK = 4.5  # deviations by which a signature may fall short of the threshold and still be a candidate
COMPARED_ROWS = 256


def _sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different (row, n-gram hash), sorted. A text of fewer than n words is one n-gram of all its words."""
    hashes, owner = words.hashes(), words.row_of_word()
    grams = rolled(hashes, n, n)
    whole = owner[: len(grams)] == owner[len(owner) - len(grams) :] if len(grams) else np.empty(0, bool)
    row, gram = owner[: len(grams)][whole], grams[whole]
    sizes = np.diff(words.rows)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        row = np.append(row, short)
        gram = np.append(gram, np.array([rolled(hashes[words.rows[r] : words.rows[r + 1]], int(sizes[r]), int(sizes[r]))[0] for r in short], np.uint64))
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.append(True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])) if len(row) else np.empty(0, bool)
    return row[new], gram[new]


def _signatures(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    factor, shift = multipliers(PLACES, 3), multipliers(PLACES, 4)
    for batch in batches:
        for part in chunks(batch, "text"):
            row, gram = _sets(words_of(part.column("text")), n)
            begin = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, np.int64)
            minima = np.empty((len(begin), PLACES), np.uint32)
            for k in range(PLACES if len(begin) else 0):
                minima[:, k] = np.minimum.reduceat(((gram ^ shift[k]) * factor[k]) >> np.uint64(32), begin)
            data, ends = gram.tobytes(), np.append(begin[1:], len(gram))[: len(begin)]
            digest = [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
            at = pa.array(row[begin])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(at), part.column("text_hash").take(at), pa.array(digest, pa.binary()), pa.array([x.tobytes() for x in minima], pa.binary())],
                ["doc_id", "text_hash", "digest", "signature"],
            )


def _gram_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            row, gram = _sets(words_of(part.column("text")), n)
            ends = np.searchsorted(row, np.arange(part.num_rows + 1)).tolist()
            data = gram.tobytes()
            sets = [data[8 * a : 8 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(sets, pa.binary())], ["rep", "grams"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, PLACES)


def _chosen(signatures: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each choice; path: what was chosen before, of each row."""
    value = mixed(signatures.astype(np.uint64) + (np.arange(PLACES, dtype=np.uint64) << np.uint64(32)) ^ path[:, None])
    row, place = np.nonzero(value < np.uint64(int(2**64 / (CHOICE * PLACES))))
    return row, mixed(value[row, place] + np.uint64(1))


def _first_choices(batches: Iterator[pa.RecordBatch], runs: int) -> Iterator[pa.RecordBatch]:
    starts = multipliers(runs, 5)
    for batch in batches:
        signatures = _matrix(batch.column("signature"))
        for start in starts:
            row, bucket = _chosen(signatures, np.full(len(signatures), start))
            yield pa.RecordBatch.from_arrays([pa.array(as_signed(bucket)), batch.column("rep").take(pa.array(row))], ["bucket", "rep"])


def _least(threshold: float) -> int:
    """Places at which a candidate's signatures agree."""
    mean = threshold * PLACES
    return int(mean - SLACK * (mean * (1 - threshold)) ** 0.5)


def _next_choices(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Members of large buckets meet their bucket's head, its smallest set. Those alike are linked to it and leave; the
    others choose again. Rows with a head are links, rows with a bucket choices.

    Only sets well above the threshold leave. Places at which signatures differ obey the triangle inequality: what agrees
    with one that leaves at ``least`` places agrees with the head at ``leaves + least - PLACES`` or more. All sets with
    that are linked to the head, so whoever leaves meets all its candidates in the head's component, and what is lost
    is only what ``least`` loses everywhere (SLACK deviations: by the binomial a chance of 4e-06 at 0.8).

    Rows come sorted by rep, so that a set's meetings with one head, which many of its buckets share, are one link.
    """
    mean = threshold * PLACES
    leaves = min(PLACES, int(np.ceil(mean + 1.5 * (mean * (1 - threshold)) ** 0.5)))
    linked = leaves + _least(threshold) - PLACES
    names = ["bucket", "rep", "head"]
    for batch in batches:
        signatures, rep, head = _matrix(batch.column("signature")), batch.column("rep"), batch.column("head")
        alike = (signatures == _matrix(batch.column("head_signature"))).sum(1)
        pairs = np.column_stack([rep.to_numpy(), head.to_numpy()])
        near = np.flatnonzero((alike >= linked) & (pairs[:, 0] != pairs[:, 1]))
        near = near[np.unique(pairs[near], axis=0, return_index=True)[1]]
        at = pa.array(near)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(near), pa.int64()), rep.take(at), head.take(at)], names)
        rest = np.flatnonzero(alike < leaves)
        path = batch.column("bucket").to_numpy().view(np.uint64)[rest]
        row, bucket = _chosen(signatures[rest], mixed(path))
        yield pa.RecordBatch.from_arrays([pa.array(as_signed(bucket)), rep.take(pa.array(rest[row])), pa.nulls(len(row), pa.int64())], names)


def _labels(near: np.ndarray) -> np.ndarray:
    """The first member of each one's component; near: a symmetric matrix."""
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows come sorted by keys: the rows of each key."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        edges = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))), len(key)).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            here = tuple(key[a].tolist())
            if here != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def _agree(one: np.ndarray, other: np.ndarray, least: int) -> np.ndarray:
    return np.concatenate([(one[i : i + COMPARED_ROWS, None, :] == other[None]).sum(2, dtype=np.uint8) >= least for i in range(0, len(one), COMPARED_ROWS)])


def _candidates(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """A star of links for each group of sets in a cell whose signatures agree at ``least`` places. left and right: a
    cell of two blocks of a bucket compares across them only."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for table in _groups(batches, ["bucket", "left", "right"]):
        if table.num_rows < 2:
            continue
        reps = table.column("rep").to_numpy()
        signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, PLACES)
        order = np.argsort(reps)
        reps, low = reps[order], signatures[order].astype(np.uint8)
        left = table.column("left")[0].as_py()
        if left == table.column("right")[0].as_py():
            near = _agree(low, low, least)
        else:
            of_left = table.column("block").to_numpy()[order] == left
            if of_left.all() or not of_left.any():
                continue
            across = _agree(low[of_left], low[~of_left], least)
            if not across.any():
                continue
            near = np.zeros((len(low), len(low)), bool)
            near[np.ix_(of_left, ~of_left)] = across
            near |= near.T
        label = _labels(near)
        linked = label != np.arange(len(label))
        a.append(reps[linked])
        b.append(reps[label[linked]])
    pairs = np.unique(np.column_stack([np.concatenate(a), np.concatenate(b)]), axis=0) if a else np.empty((0, 2), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _common(row: np.ndarray, token: np.ndarray, left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """How many tokens each set of left has in common with each of right (numbers of sets); tokens are 0, 1, ..."""
    place = np.full((2, int(max(left.max(), right.max())) + 1), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        at = slice(*np.searchsorted(token, (low, low + width)))
        sides = []
        for side, size in zip(place, (len(left), len(right)), strict=True):
            inside = side[row[at]] >= 0
            has = np.zeros((size, width), np.float32)
            has[side[row[at]][inside], token[at][inside] - low] = 1
            sides.append(has)
        out += sides[0] @ sides[1].T
    return out


def _links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Each member's exact links in a cell. left and right: a cell of two blocks compares across them only."""
    for table in _groups(batches, ["component", "left", "right"]):
        grams = table.column("grams").combine_chunks().cast(pa.large_binary())
        data, ends = flat_bytes(grams)
        gram = np.frombuffer(data.tobytes(), np.uint64)
        size = np.diff(ends) // 8
        row = np.repeat(np.arange(len(size)), size)
        _, token, seen = np.unique(gram, return_inverse=True, return_counts=True)
        shared = seen[token] > 1
        row, token = row[shared], np.unique(token[shared], return_inverse=True)[1]
        reps, copies = table.column("rep").to_numpy(), table.column("n_copies").to_numpy()
        block = table.column("block").to_numpy()
        left = right = np.argsort(reps)
        across = table.column("left")[0].as_py() != table.column("right")[0].as_py()
        if across:
            left, right = left[block[left] == table.column("left")[0].as_py()], right[block[right] == table.column("right")[0].as_py()]
            if not (len(left) and len(right)):
                continue
        common = _common(row, token, left, right)
        near = common.astype(np.float64) * (1 + threshold) >= threshold * (size[left][:, None] + size[right][None, :]) - 1e-6
        if across:
            both = np.concatenate([left, right])
            whole = np.zeros((len(both), len(both)), bool)
            whole[: len(left), len(left) :] = near
            whole |= whole.T
            order = np.argsort(reps[both])
            both, whole = both[order], whole[np.ix_(order, order)]
        else:
            both, whole = left, near
            np.fill_diagonal(whole, False)
        yield pa.RecordBatch.from_arrays([pa.array(reps[both]), pa.array(reps[both][_labels(whole)]), pa.array(whole @ copies[both]), pa.array(whole.sum(1))], ["rep", "root", "links", "texts"])


def _buckets(choices: DataFrame) -> DataFrame:
    """bucket, rep and members of the buckets of two sets or more."""
    counts = choices.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    return materialise(choices.join(counts, "bucket"), "buckets")


def candidate_links(sets: DataFrame, threshold: float, runs: int, depth: int, small: int) -> DataFrame:
    """a, b: stars of sets (rep, signature) that a bucket found alike."""
    leaves, links = [], []
    found = _buckets(sets.select("rep", "signature").mapInArrow(partial(_first_choices, runs=runs), "bucket long, rep long"))
    for level in range(1, depth + 1):
        if level == depth:
            # what choosing didn't divide: each pair of blocks
            blocks = F.ceil(F.col("members") / small)
            cut = found.withColumn("block", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            leaves.append(cut.select("bucket", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "rep"))
            break
        whole = [F.lit(0).cast("long").alias(name) for name in ("left", "right", "block")]
        leaves.append(found.where(F.col("members") <= small).select("bucket", *whole, "rep"))
        large = found.where(F.col("members") > small)
        if large.isEmpty():
            break
        signed = sets.select("rep", "signature")
        heads = large.groupBy("bucket").agg(F.min("rep").alias("head")).join(signed.toDF("head", "head_signature"), "head")
        met = large.join(heads, "bucket").join(signed.hint("merge"), "rep").select("bucket", "rep", "signature", "head", "head_signature")
        chosen = materialise(met.mapInArrow(partial(_next_choices, threshold=threshold), "bucket long, rep long, head long"), "choices")
        links.append(chosen.where("head is not null").select(F.col("rep").alias("a"), F.col("head").alias("b")))
        found = _buckets(chosen.where("bucket is not null").select("bucket", "rep"))
    cells = leaves[0]
    for more in leaves[1:]:
        cells = cells.unionByName(more)
    cells = cells.join(sets.select("rep", "signature"), "rep").repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right")
    out = cells.mapInArrow(partial(_candidates, least=_least(threshold)), "a long, b long")
    for more in links:
        out = out.unionByName(more)
    return out


def jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, runs: int = 12, depth: int = 3, small: int = 1500, most: int = 2000) -> DataFrame:
    """doc_id, class_id, n_links, n_texts and class_key of every row.

    class_id: the smallest doc_id that links of similarity >= threshold lead to. n_links: rows linked to this one
    directly, rows of the same set (copies) included. n_texts: different sets linked to this one's. class_key: the class
    by the least digest of its sets (hexadecimal).

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D, n-grams of them are taken of whole texts; a text of
    fewer than n words is one n-gram. Null texts and texts without words have no set, hence no links: each is a class
    of its own, without a key. Rows with a null doc_id are left as they are, with a null class and no links. Repeated
    rows are copies of each other. A doc_id with several texts doesn't link them: each row has its own text's class, and
    where two classes have the same smallest doc_id their keys tell them apart. A long text is one set, held whole by its
    task. Other columns aren't carried. An empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    own = docs.where("doc_id is not null and text is not null")
    signed = materialise(own.mapInArrow(partial(_signatures, n=n), "doc_id long, text_hash long, digest binary, signature binary"), "signatures")
    sets = signed.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("n_copies"), F.first("signature").alias("signature"))
    sets = materialise(sets.withColumn("rep", F.monotonically_increasing_id()), "sets")  # written once, so the numbers stay
    parts = components(candidate_links(sets, threshold, runs, depth, small))
    parts = parts.unionByName(parts.select(F.col("root").alias("id"), "root").distinct())
    parts = materialise(parts.join(parts.groupBy("root").agg(F.count("*").alias("members")), "root"), "parts")
    members = materialise(parts.withColumnRenamed("id", "rep").join(sets.select("rep", "n_copies", "first"), "rep"), "members")
    # merged at every size, so that what moves stays in proportion to the input
    texts = own.join(members.select("rep", "first.*").hint("merge"), ["doc_id", "text_hash"]).dropDuplicates(["rep"]).select("rep", "text")
    grams = texts.mapInArrow(partial(_gram_sets, n=n), "rep long, grams binary")
    blocks = F.when(F.col("members") > most, F.ceil(F.col("members") * 2 / most)).otherwise(1)
    cells = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ["component", "left", "right"]
    cells = cells.select(F.col("root").alias("component"), "rep", "n_copies", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    cells = grams.join(cells, "rep").repartition(*keys).sortWithinPartitions(*keys)
    found = materialise(cells.mapInArrow(partial(_links, threshold=threshold), "rep long, root long, links long, texts long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    roots = roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct()).withColumnRenamed("id", "rep")
    linked = roots.join(sets.select("rep", "digest", "first"), "rep")
    classes = linked.groupBy("root").agg(F.min("first.doc_id").alias("class_id"), F.min("digest").alias("class_key"))
    named = roots.join(classes, "root").drop("root")
    known = sets.select("digest", "rep", "n_copies", "first").join(links, "rep", "left").join(named, "rep", "left")
    known = known.select(
        "digest", F.coalesce("class_id", "first.doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_texts"), F.lower(F.hex(F.coalesce("class_key", "digest"))).alias("class_key"),
    )
    linked = signed.select("doc_id", "digest").join(known, "digest").drop("digest")
    alone = docs.where("doc_id is null or not coalesce(text, '') rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    none = F.lit(0).cast("long")
    alone = alone.select("doc_id", F.col("doc_id").alias("class_id"), none.alias("n_links"), none.alias("n_texts"), F.lit(None).cast("string").alias("class_key"))
    return linked.unionByName(alone)


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_key")
