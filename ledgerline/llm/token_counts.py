"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pieces and these into pre-tokens; the different ones of a slice lie end to end in one array of
symbols. In each round every sequence finds the lowest rank among its neighbouring pairs and merges all places of that
pair at once, from the left, until no sequence has a pair left. A later merge has a higher rank than the symbols it
joins, so this gives what merging one pair at a time gives. What survives is counted. A very long pre-token is merged
by the same rounds over linked places, so that a round costs what it merges.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, flat_bytes
from .pretokens import KNOWN_PIECES, byte_letters, pieces_of, splitter

VOCABULARY = "byte_bpe_50k.json"
NO_RANK = np.iinfo(np.int64).max
LONG_WORD = 512  # symbols of a pre-token that is merged by itself


@dataclass
class Merges:
    """keys: the pairs (left * width + right), sorted; rank and made: of each pair; symbol: of each byte; by_rank: left,
    right and made of each rank."""

    keys: np.ndarray
    rank: np.ndarray
    made: np.ndarray
    symbol: np.ndarray
    width: int
    by_rank: np.ndarray


@lru_cache(4)
def load_merges(path: str) -> Merges:
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary = model["vocab"]
    pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
    width = max(vocabulary.values()) + 1
    by_rank = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
    keys = by_rank[:, 0] * width + by_rank[:, 1]
    order = np.argsort(keys)
    symbol = np.zeros(256, np.int64)
    for letter, byte in byte_letters().items():
        symbol[byte] = vocabulary[letter]
    return Merges(keys[order], order.astype(np.int64), by_rank[order, 2], symbol, width, by_rank)


def _every_second(follows: np.ndarray) -> np.ndarray:
    """In a run of overlapping places every second one merges, from the left; follows: whether a place overlaps the one
    before it."""
    nth = np.arange(len(follows)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(follows))))
    return nth % 2 == 0


def surviving(words: pa.Array, merges: Merges) -> np.ndarray:
    """How many symbols are left of each word once no pair can merge."""
    data, rows = flat_bytes(words)
    out = np.diff(rows)
    long = np.flatnonzero(out > LONG_WORD)
    symbols, owner = merges.symbol[data], np.repeat(np.arange(len(out)), out)
    for i in long:
        out[i] = surviving_long(symbols[rows[i] : rows[i + 1]], merges)
    if len(long):
        short = ~np.isin(owner, long)
        symbols, owner = symbols[short], owner[short]
    while len(symbols) > 1:
        key = symbols[:-1] * merges.width + symbols[1:]
        at = np.minimum(np.searchsorted(merges.keys, key), len(merges.keys) - 1)
        found = (merges.keys[at] == key) & (owner[:-1] == owner[1:])
        rank = np.where(found, merges.rank[at], NO_RANK)
        # sequences end to end: the least rank of each
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        least = np.minimum.reduceat(np.append(rank, NO_RANK), first)
        size = np.diff(np.append(first, len(symbols)))
        merge = found & (rank == np.repeat(least, size)[:-1])
        if not merge.any():
            break
        place = np.flatnonzero(merge)
        place = place[_every_second(np.append(False, np.diff(place) == 1))]
        symbols = symbols.copy()
        symbols[place] = merges.made[at[place]]
        keep = np.ones(len(symbols), bool)
        keep[place + 1] = False
        np.subtract.at(out, owner[place], 1)
        # a sequence without a merge is done; it leaves the arrays
        alive = np.repeat(least != NO_RANK, size)
        symbols, owner = symbols[keep & alive], owner[keep & alive]
    return out


def surviving_long(symbols: np.ndarray, merges: Merges) -> int:
    """The same for one long sequence. Its places wait under the rank of the pair that begins there; a round takes the
    lowest rank's and looks again only beside what it merged, so that work follows the merges and not rounds times
    length. Ends are linked: a place knows the places before and after it."""
    n = len(symbols)
    symbol = np.append(symbols, -1).astype(np.int64)
    after = np.minimum(np.arange(1, n + 2), n)
    before = np.arange(-1, n)
    waiting: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def wait(places: np.ndarray) -> None:
        key = symbol[places] * merges.width + symbol[after[places]]
        at = np.minimum(np.searchsorted(merges.keys, key), len(merges.keys) - 1)
        found = (merges.keys[at] == key) & (after[places] < n)
        places, rank = places[found], merges.rank[at[found]]
        order = np.argsort(rank, kind="stable")
        places, rank = places[order], rank[order]
        edges = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else []
        for r, group in zip(rank[edges].tolist(), np.split(places, edges[1:]), strict=False):
            if r not in waiting:
                heapq.heappush(queue, r)
                waiting[r] = []
            waiting[r].append(group)

    wait(np.arange(n))
    left_over = n
    while queue:
        r = heapq.heappop(queue)
        left, right, made = merges.by_rank[r].tolist()
        place = np.unique(np.concatenate(waiting.pop(r)))
        place = place[(symbol[place] == left) & (symbol[after[place]] == right)]
        if not len(place):
            continue
        place = place[_every_second(np.append(False, after[place[:-1]] == place[1:]))]
        gone = after[place]
        symbol[place], symbol[gone] = made, -1
        onward = after[gone]
        after[place], before[onward] = onward, place
        left_over -= len(place)
        beside = before[place]
        wait(np.unique(np.append(place, beside[beside >= 0])))
    return left_over


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    merges, split = load_merges(path), splitter(path)
    special, known = dict.fromkeys(split.special, 1), {}  # tokens of each pre-token
    for batch in batches:
        for part in chunks(batch, "text"):
            number, pieces, first = pieces_of(part.column("text"))
            found = [split.split(p) for p in pieces]
            new = list({w for ws in found for w in ws if w not in known} - special.keys())
            if len(known) + len(new) > KNOWN_PIECES:
                known, new = {}, list({w for ws in found for w in ws} - special.keys())
            known.update(zip(new, surviving(pa.array(new, pa.large_string()), merges).tolist(), strict=True))
            known.update(special)
            tokens = np.array([sum(map(known.__getitem__, ws)) for ws in found], np.int64)[number]
            counts = np.diff(np.append(0, np.cumsum(tokens))[first])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row.

    Counts equal the tokenizers library's for this file, without added special tokens; a special string inside a text
    is one token, as is its default. Null and empty texts have 0; a text of megabytes without a blank takes time in
    proportion to its length (times its logarithm). Rows are judged alone: repeated rows repeat, a null
    doc_id stays null, other columns aren't carried. The vocabulary's path is resolved where the task runs.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = docs.mapInArrow(partial(_count_file, vocabulary=vocabulary), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def _count_file(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    return _count(batches, public_tokenizers.path(vocabulary))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
