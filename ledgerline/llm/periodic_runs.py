"""Runs of repeated words by Lyndon words: maximal stretches that go on with one period.

Every run has a root that is the longest Lyndon word at its place in one of the two orders of words. So a stack scanned
from right to left, once in each order, names a period for each place, and all that is left is to see how far it goes
on. Suffixes are compared, and periods extended, by binary search over rolling hashes; each run found is then compared
word by word. There is no suffix array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, mixed, words_of

LEAST, TIMES = 6, 4  # a run has at least so many words, and so many times its period
PRIMES = (2147483647, 2147483629)
DIRECT = 8  # words compared one by one before hashes are
ROUNDS = 6
WORD = "[^\\x20\\x09-\\x0D]+"


@lru_cache(2)
def _powers(prime: int, base: int, size: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < size:
        step = pow(base, len(out), prime)
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(prime)])
    return out


class Matches:
    """How far two places of a sequence of numbers agree, by prefix hashes modulo two primes."""

    def __init__(self, words: np.ndarray, seed: int = 0):
        self.n, self.words = len(words), words.tolist()
        values = mixed(words.astype(np.uint64) + np.uint64(1 + (seed << 40)))
        size = 1 << (len(words) + 1).bit_length()
        self.parts = []
        for k, prime in enumerate(PRIMES):
            powers = _powers(prime, 1000003 + 7919 * seed + k, size)
            terms = (values >> np.uint64(32 * k)) % np.uint64(prime) * powers[: self.n] % np.uint64(prime)
            sums = np.append(np.uint64(0), np.cumsum(terms, dtype=np.uint64)) % np.uint64(prime)
            self.parts.append((np.uint64(prime), powers, sums))
        self.lists = [(int(prime), powers[: self.n + 1].tolist(), sums.tolist()) for prime, powers, sums in self.parts]

    def all_same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from i and from j > i agree, for arrays of places."""
        out = np.ones(len(i), bool)
        for prime, powers, sums in self.parts:
            left, right = (sums[i + size] + prime - sums[i]) % prime, (sums[j + size] + prime - sums[j]) % prime
            out &= left * powers[j - i] % prime == right
        return out

    def same(self, i: int, j: int, size: int) -> bool:
        for prime, powers, sums in self.lists:
            if ((sums[i + size] - sums[i]) * powers[j - i] - sums[j + size] + sums[j]) % prime:
                return False
        return True

    def common(self, i: int, j: int) -> int:
        """The number of words that agree from i and from j > i on."""
        words, most, k = self.words, self.n - j, 0
        direct = min(most, DIRECT)
        while k < direct and words[i + k] == words[j + k]:
            k += 1
        if k < direct or k == most:
            return k
        step = DIRECT
        while k < most and self.same(i + k, j + k, min(step, most - k)):
            k += min(step, most - k)
            step *= 2
        low, high = 0, min(step, most - k)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.same(i + k, j + k, middle) else (low, middle)
        return k + low


def longest(agree: Callable[[np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
    """The largest size up to ``most`` for which ``agree`` holds, by binary search in all places at once."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        yes = agree(middle)
        low, high = np.where(yes, middle, low), np.where(yes, high, middle - 1)
    return low


def lyndon_ends(words: list[int], common: Callable[[int, int], int]) -> list[int]:
    """Where the longest Lyndon word of each place ends: at the next suffix that is smaller (an end is the smallest).
    The places that are linked from i + 1 on are the stack."""
    n = len(words)
    ends = [n] * n
    for i in range(n - 1, -1, -1):
        word, j = words[i], i + 1
        while j < n:
            if word == words[j]:
                k = common(i, j)
                if j + k == n or words[i + k] > words[j + k]:
                    break
            elif word > words[j]:
                break
            j = ends[j]
        ends[i] = j
    return ends


def runs_of(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of each run of a sequence of numbers >= 0, by start, then period. ``times`` is at least 3."""
    n = len(words)
    for seed in count():
        matches = Matches(words, seed)
        places = np.arange(n)
        ends = [np.array(lyndon_ends(x, matches.common), np.int64) for x in (matches.words, [-w for w in matches.words])]
        begin, period = np.concatenate([places, places]), np.concatenate(ends) - np.concatenate([places, places])
        # a run's first root lies in its first period and has times - 1 periods after its begin; no root stands before it
        fits = begin + (times - 1) * period <= n
        begin, period = begin[fits], period[fits]
        goes_on = matches.all_same(begin, begin + period, (times - 2) * period)
        begin, period = begin[goes_on], period[goes_on]
        before = np.minimum(period, begin)
        first = (before < period) | ~matches.all_same(begin - before, begin - before + period, before)
        begin, period = begin[first], period[first]
        right = longest(lambda k: matches.all_same(begin, begin + period, k), n - period - begin)  # noqa: B023
        left = longest(lambda k: matches.all_same(begin - k, begin - k + period, k), np.minimum(period, begin))  # noqa: B023
        start, length = begin - left, left + right + period
        long = length >= np.maximum(least, times * period)
        found = np.unique(np.stack([start[long], period[long], length[long]]), axis=1) if long.any() else np.zeros((3, 0), np.int64)
        start, period, length = found
        if all(_is_run(words, s, p, m) for s, p, m in found.T.tolist()):
            return start, length, period


def _is_run(words: np.ndarray, start: int, period: int, length: int) -> bool:
    end = start + length
    whole = np.array_equal(words[start : end - period], words[start + period : end])
    return whole and (start == 0 or words[start - 1] != words[start - 1 + period]) and (end == len(words) or words[end] != words[end - period])


def stretches(words: np.ndarray, rows: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of what may hold runs. Three words in a row that lie in a run come back in it: at least
    ``times - 1`` times, or ``least - 2`` times at period 1. So places whose three words are rarer in their document
    part it, and what is left is parted again by the counts inside each part. No run is lost or cut by that."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(words) < least:
        return none
    a, b, c = mixed(words[:-2].astype(np.uint64)), words[1:-1].astype(np.uint64), words[2:].astype(np.uint64)
    grams = mixed(mixed(a + b) + c)
    at, part = np.flatnonzero(rows[:-2] == rows[2:]), rows.astype(np.uint64)
    for _ in range(ROUNDS):
        _, inverse, counts = np.unique(mixed(grams[at] ^ mixed(part[at])), return_inverse=True, return_counts=True)
        kept = at[counts[inverse] >= min(times - 1, least - 2)]
        if not len(kept):
            return none
        cuts = np.flatnonzero(np.diff(kept) > 1)
        begins, ends = kept[np.append(0, cuts + 1)], kept[np.append(cuts, len(kept) - 1)] + 1
        long = ends - begins >= least - 2
        begins, ends = begins[long], ends[long]
        if not len(begins):
            return none
        sizes = ends - begins
        kept = np.repeat(begins - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        if len(kept) == len(at):
            break
        part[kept] = np.repeat(np.arange(len(begins)), sizes)
        at = kept
    return begins, ends + 2


def runs_of_rows(words: np.ndarray, rows: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of the runs inside rows, which lie end to end. The stretches are searched as one
    sequence, each followed by a number of its own, which no run can hold."""
    begins, ends = stretches(words, rows, least, times)
    if not len(begins):
        return begins, begins, begins
    sizes = ends - begins + 1
    at = np.repeat(begins - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
    apart = np.cumsum(sizes) - 1
    sequence = words[np.minimum(at, len(words) - 1)]
    sequence[apart] = words.max() + 1 + np.arange(len(apart))
    start, length, period = runs_of(sequence, least, times)
    order = np.lexsort([period, at[start]])
    return at[start][order], length[order], period[order]


def _find(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            words = words_of(part.column("text"))
            ids, _ = words.encoded()
            start, length, period = runs_of_rows(ids, words.row_of_word(), least, times)
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, start + period, 1)
            np.add.at(edges, start + length, -1)
            kept = np.cumsum(edges[:-1]) == 0
            taken = np.repeat(kept, np.diff(words.at))
            places = np.flatnonzero(kept)
            row = words.row_of_word()[places]
            taken[words.at[places[np.append(row[1:] != row[:-1], True)] + 1] - 1 if len(places) else places] = False  # the blank after a row's last word
            bytes_before = np.append(0, np.cumsum(taken))[words.at[words.rows]]
            text = pa.Array.from_buffers(pa.string(), part.num_rows, [None, pa.py_buffer(bytes_before.astype(np.int32)), pa.py_buffer(words.data[taken])])
            first = np.searchsorted(start, words.rows)
            spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - words.rows[:-1][np.searchsorted(words.rows, start, "right") - 1], length, period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(words.rows), pa.int64()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), spans), text], ["doc_id", "n_words", "runs", "collapsed_text"]
            )


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then period) and collapsed_text of every row.

    Words are runs of characters other than 0x20 and 0x09 to 0x0D; null and empty texts have none. A run is a stretch
    of ``least`` words and ``times`` periods or more that agrees with itself shifted by its smallest period, and
    that neither neighbour goes on with. The collapsed text drops what any run holds after its first period and
    joins the rest by one space. Rows are judged alone: repeated rows repeat, a null doc_id stays null, other columns
    aren't read, an empty table gives an empty result. Equal hashes of different words (a chance of some n / 2**62 for
    a comparison) could only hide a run; all that are returned are compared word by word.
    """
    if times < 3 or least < 4:
        raise ValueError("times must be at least 3 and least at least 4")
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(_find, least=least, times=times), schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten, by a checksum of its id, repeats its words from one place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.expr("div(crc32(cast(doc_id AS string)), 10)").alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("its_words"))
    n = F.col("n")
    rows = rows.withColumn("n", F.size("its_words").cast("long")).withColumn("a", F.when(n > 0, F.col("g") % n))
    rows = rows.withColumn("p", F.expr("1 + div(n - a, 3 + g % 8)"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    words = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("its_words", place(i).cast("int")))
    return rows.select("doc_id", F.when(n > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    more = lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)
    found = found.withColumn("best", F.reduce("runs", F.get("runs", 0), more))
    lines = F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("div(1000 * best.length, best.period)").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
