from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import periodic_runs as p

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, times=4):
    """Every stretch that agrees with itself shifted by q, for every q; of equal stretches that of the smallest q."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= 2 * q:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items() if n >= max(least, times * q)), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def check_runs(words, least=6, times=4):
    ids = np.array(words, np.int64)
    start, length, period = p.runs_of(ids, least, times)
    want = brute(words, least, times)
    assert sorted(zip(start.tolist(), length.tolist(), period.tolist(), strict=True), key=lambda r: (r[0], r[2])) == want
    start, length, period = p.runs_of_rows(ids, np.zeros(len(ids), np.int64), least, times)
    assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == want


block = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 7))


@settings(max_examples=400, deadline=None)
@given(st.lists(block, max_size=8))
def test_runs_against_every_period(blocks):
    check_runs([w for words, n in blocks for w in words * n])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=120), st.integers(4, 9), st.integers(3, 5))
def test_two_words_and_other_limits(words, least, times):
    check_runs(words, least, times)


def test_words_on_which_hashes_of_powers_of_two_fail():
    word = [0]
    while len(word) < 4096:
        word += [1 - w for w in word]
    check_runs(word[:600] + word[:300] * 4)
    matches = p.Matches(np.array(word + word), 0)
    assert matches.common(0, 4096) == 4096 and matches.common(0, 2048) == 0


def test_nested_runs():
    inner = [1] * 8 + [2]
    check_runs(([*inner * 5, 3]) * 4 + [7, 7, 7, 7, 7] + [8] * 6 + [9, 8] * 4)
    check_runs([5] * 5000)
    check_runs(list(range(1000)) * 5 + [4])


def expected(doc_id, text):
    words = WORD.findall(text or "")
    runs = brute(words)
    return doc_id, len(words), runs, collapsed(words, runs)


def test_rows(spark):
    rows = [
        (1, "a a a a a a"), (1, "a a a a a a"), (2, None), (3, ""), (4, " \t\n"), (5, "a a a a a"), (6, "x a b a b a b a b y\x0ba b\xa0a b"), (None, "é é é é é é é z"), (7, "a b " * 3 + "a a"),
        (8, "one two three " * 3000 + "end"), (9, "solo"), (10, "the cat sat. " * 4 + "the cat sat, " * 4),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS runs", "2 AS n_words", "3 AS g", "4 AS n")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in p.periodic_runs(frame).collect()]
    key = lambda r: (str(r[0]), r[3])
    assert sorted(got, key=key) == sorted((expected(*r) for r in rows), key=key)
    assert p.periodic_runs(frame.where("doc_id < 0")).count() == 0
    with pytest.raises(ValueError):
        p.periodic_runs(frame, times=2)


def plant(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        q = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % q] for i in range(n)]
    return words


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in p.op13_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    n_runs = 0
    for r in rows:
        words = plant(r.doc_id, r.text)
        if len(words) > 3000:  # brute force takes the square of the length; these are held by test_rows and test_nested_runs
            continue
        runs = brute(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        assert got[r.doc_id] == (r.doc_id, len(runs), *four, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(collapsed(words, runs)))
        n_runs += len(runs)
    assert n_runs > 5
