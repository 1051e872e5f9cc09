"""Packing by order-preserving dynamic programming.

The documents of a partition, in order, are one stream of token ids. A window is a stretch of at most ``length`` ids
and becomes one sequence. Windows may end after a document or after a sentence; where neither is near, every
``step`` ids may end one. With f(j) the least cost of the stream up to candidate j,

    f(j) = penalty(j) + min over i with at(j) - at(i) <= length of  f(i) + length - (at(j) - at(i))

where penalty is 0 after a document, ``sentence_cost`` after a sentence and ``word_cost`` elsewhere (in padding ids).
f(i) + at(i) doesn't depend on j, so the least one in the sliding window comes from a monotone queue: each candidate
enters and leaves it once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks
from .pretokens import byte_letters, token_ids

VOCABULARY = "byte_bpe_50k.json"
BLOCK_IDS = 1 << 20  # ids that are planned together; a block's last windows go on into the next one
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


@lru_cache(4)
def sentence_ends(path: str) -> np.ndarray:
    """Of each id, whether a sentence may end after it: its bytes end with a stop or hold a line end."""
    library, letters = token_ids(path).library, byte_letters()
    out = np.zeros(library.get_vocab_size(), bool)
    for token, i in library.get_vocab(with_added_tokens=False).items():
        token = bytes(map(letters.__getitem__, token))
        out[i] = b"\n" in token or token.rstrip(b"\"')")[-1:] in (b".", b"!", b"?")
    return out


def cut_candidates(ids: np.ndarray, ends: np.ndarray, after: np.ndarray, step: int, sentence_cost: int, word_cost: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end in a stream (ascending, the stream's end included), and what each costs.
    ends: where documents end; after: of each id, whether a sentence may end there."""
    kind = np.zeros(len(ids) + 1, np.int8)  # 1 every step ids, 2 after a sentence, 3 after a document
    kind[1:][after] = 2
    kind[ends] = 3
    at = np.flatnonzero(kind)
    begin = np.append(0, at)[:-1]
    more = np.maximum(0, at - begin - 1) // step
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    kind[np.repeat(begin, more) + (nth + 1) * step] = 1
    at = np.flatnonzero(kind)
    return at, np.array([0, word_cost, sentence_cost, 0], np.int64)[kind[at]]


def best_cuts(at: np.ndarray, cost: np.ndarray, length: int) -> list[int]:
    """The ends of the windows of the cheapest cut; the last entry of ``at`` is the stream's end."""
    places, penalties = [0, *at.tolist()], [0, *cost.tolist()]
    back = [0] * len(places)
    keys, nodes, head = [0], [0], 0  # the queue from head on: f(i) + at(i), ascending, and i
    for j in range(1, len(places)):
        here = places[j]
        first = here - length
        while places[nodes[head]] < first:
            head += 1
        back[j] = nodes[head]
        key = penalties[j] + keys[head] + length  # f(j) + at(j)
        while keys[-1] >= key and len(keys) > head:
            keys.pop()
            nodes.pop()
        keys.append(key)
        nodes.append(j)
    cuts, j = [], len(places) - 1
    while j:
        cuts.append(places[j])
        j = back[j]
    return cuts[::-1]


class _Stream:
    """The ids of documents that aren't in a sequence yet."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []  # doc_id, ids of it before this part, ids of the document
        self.size = 0

    def add(self, doc_id: int | None, before: int, total: int, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, before, total))
        self.size += len(ids)


def _flush(stream: _Stream, last: bool, number: int, length: int, ends_table: np.ndarray, step: int, sentence_cost: int, word_cost: int) -> tuple[pa.RecordBatch, _Stream, int]:
    """The pieces of a block's windows, what goes on into the next block, and the next sequence's number."""
    ids = np.concatenate(stream.ids) if stream.ids else np.empty(0, np.uint32)
    sizes = np.array([len(x) for x in stream.ids], np.int64)
    doc_end = np.cumsum(sizes)
    at, cost = cut_candidates(ids, doc_end, ends_table[ids], step, sentence_cost, word_cost)
    cuts = best_cuts(at, cost, length)
    if not last:  # what follows may change the best cut of the last windows
        cuts = cuts[: max(1, len(cuts) - 8)]
    upto = cuts[-1]
    edges = np.union1d(doc_end[doc_end <= upto], cuts)
    begins = np.append(0, edges[:-1])
    doc = np.searchsorted(doc_end, begins, "right")
    window = np.searchsorted(cuts, begins, "right")
    data = ids.astype("<u4").tobytes()
    raw = [data[4 * a : 4 * b] for a, b in zip(begins.tolist(), edges.tolist(), strict=True)]
    meta = [stream.docs[d] for d in doc.tolist()]
    start = np.array([m[1] for m in meta], np.int64) + begins - (doc_end - sizes)[doc]
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([m[0] for m in meta], pa.int64()), pa.array(start), pa.array(edges - begins), pa.array([zlib.crc32(x) for x in raw], pa.int64()),
            pa.array([m[2] for m in meta], pa.int64()), pa.array(window + number), pa.array(begins - np.append(0, cuts)[window]), pa.array(raw, pa.binary()),
        ],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
    )
    rest = _Stream()
    for k in range(int(np.searchsorted(doc_end, upto, "right")), len(sizes)):
        done = max(0, upto - int(doc_end[k] - sizes[k]))
        doc_id, before, total = stream.docs[k]
        rest.add(doc_id, before + done, total, stream.ids[k][done:])
    return batch, rest, number + len(cuts)


def _pack(batches: Iterator[pa.RecordBatch], vocabulary: str, length: int, step: int, sentence_cost: int, word_cost: int) -> Iterator[pa.RecordBatch]:
    path = public_tokenizers.path(vocabulary)
    encode, table = token_ids(path), sentence_ends(path)
    number = TaskContext.get().partitionId() << 40
    stream = _Stream()
    plan = partial(_flush, length=length, ends_table=table, step=step, sentence_cost=sentence_cost, word_cost=word_cost)
    for batch in batches:
        for part in chunks(batch, "text"):
            found, begin = encode.of(part.column("text"))
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                ids = np.append(found[a:b], np.uint32(0))
                stream.add(doc_id, 0, len(ids), ids)
                if stream.size >= BLOCK_IDS:
                    out, stream, number = plan(stream, False, number)
                    yield out
    if stream.size:
        yield plan(stream, True, number)[0]


def pack(docs: DataFrame, length: int = 1024, step: int = 8, sentence_cost: int = 2, word_cost: int = 8, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and ids (little-endian unsigned 32-bit).

    A document's ids are its text's by the tokenizers library (null and empty: none; a special string inside a text is
    its one id) and then 0, so each has at least one piece. The library encodes each different piece (word) of a task
    once. Order is the order of rows in each partition; nothing is shuffled, and a partition's last sequence is the
    only one whose padding its neighbours can't take. A sequence's number is its partition's, times 2**40, plus its
    place there. A text of any length, with or without blanks, is one document, held whole by its task. Repeated rows
    are packed as often as they come, a null doc_id stays null, other columns aren't carried. No rows, no pieces.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(partial(_pack, vocabulary=vocabulary, length=length, step=step, sentence_cost=sentence_cost, word_cost=word_cost), SCHEMA)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
