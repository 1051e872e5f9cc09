"""Whole columns of text as flat numpy arrays: words, their ids and hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
CHUNK_BYTES = 2 << 20


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows end to end, and where each row begins (one more entry than rows). Null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[:1]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take about ``most`` bytes, so that memory follows the slice and not the batch.
    A text longer than that is a slice by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Words are runs of bytes other than 0x20 and 0x09 to 0x0D."""

    data: np.ndarray  #: every word followed by one space
    at: np.ndarray  #: where each word begins in data; one more entry than words
    rows: np.ndarray  #: the first word of each row; one more entry than rows

    def __len__(self) -> int:
        return len(self.at) - 1

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """An id for each word, and the different words (each with its space). Equal bytes, equal id."""
        column = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(self.at.astype(np.int64)), pa.py_buffer(self.data)]).dictionary_encode()
        return column.indices.to_numpy().astype(np.int64), column.dictionary

    def hashes(self) -> np.ndarray:
        ids, words = self.encoded()
        return hash_each(words)[ids] if len(ids) else np.empty(0, np.uint64)


def hash_each(values: pa.Array) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x) for x in values.to_pylist()), np.uint64, len(values))


def words_of(texts: pa.Array) -> Words:
    data, rows = flat_bytes(texts)
    inside = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = np.diff(rows) > 0
    before[rows[:-1][filled]] = False
    after[rows[1:][filled] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    sizes = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes + 1, out=at[1:])
    out = np.full(at[-1], 0x20, np.uint8)
    kept = data[inside]
    out[np.arange(len(kept)) + np.repeat(np.arange(len(sizes)), sizes)] = kept
    return Words(out, at, np.searchsorted(starts, rows))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants from a seed."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def rolled(hashes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A hash of each n consecutive entries; as many as there are full runs."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    m = len(hashes) - n + 1
    out = np.zeros(m, np.uint64)
    for i, c in enumerate(multipliers(n, seed)):
        out += hashes[i : i + m] * c
    return mixed(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive entries, by doubling."""
    if len(x) < w:
        return x[:0]
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
