from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm.substring_dedup import op1_substring_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first, out = {}, []
    for doc_id, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first.setdefault(tuple(words[k : k + window]), doc_id) < doc_id:
                gone[k : k + window] = [True] * window
        out.append((doc_id, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return sorted(out)


def ours(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup(frame, **options).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    return sorted(tuple(r) for r in found if r.doc_id is not None)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows, 50)]
    assert sorted(tuple(r) for r in op1_substring_dedup(spark, sf_dir).collect()) == want


@pytest.mark.parametrize("hot", [0, 2, 2000])
def test_hot_buckets(spark, hot):
    shared = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"a{i} {shared} b{i} " + " ".join(f"w{j}" for j in range(i % 7, 20))) for i in range(40)] + [(100, " ".join(["x"] * 700)), (101, " ".join(["x"] * 650))]
    assert ours(spark, rows, window=8, run=3, hot_documents=hot) == brute(rows, 8)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), min_size=1, max_size=8))
def test_any_texts(spark, texts):
    rows = [(i, " \n".join(t)) for i, t in enumerate(texts)]
    assert ours(spark, rows, window=5, run=2) == brute(rows, 5)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (4, long), (5, long.upper()), (None, long), (6, long + " x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cuts", F.lit("mine")).withColumn("text_hash", F.lit(1))
    found = substring_dedup(frame, carry=("cuts", "text")).collect()
    assert len(found) == len(rows) and {r.cuts for r in found} == {"mine"}
    gone = {(r.doc_id, r.n_words): r.n_removed for r in found}
    assert gone[(4, 60)] == 0 and gone[(None, 60)] == 0 and gone[(1, 0)] == 0 and gone[(6, 60)] == 59
    assert substring_dedup(frame.where("false")).count() == 0


@pytest.mark.parametrize("hot", [1, 20, 4000])
def test_common_phrases_in_other_contexts(spark, hot):
    """Phrases shorter and longer than a window, and a passage, each in many documents; some documents repeat inside."""
    chance = random.Random(hot)
    words = lambda n: " ".join(f"w{chance.randrange(10**9)}" for _ in range(n))
    short, half, passage = words(4), words(9), words(30)
    rows = [(i, " ".join([words(chance.randrange(20)), short, words(9), half, words(12), passage if i % 3 else passage[: chance.randrange(200)], words(5), half])) for i in range(60)]
    rows += [(100, " ".join([f"{half} {words(3)}" for _ in range(40)])), (101, " ".join([half] * 40)), (102, " ".join([half] * 30))]
    assert ours(spark, rows, window=12, run=3, hot_documents=hot) == brute(rows, 12)


def test_very_long_texts(spark):
    chance = random.Random(1)
    long = " ".join(f"w{chance.randrange(10**6)}" for _ in range(300_000))
    rows = [(1, long), (2, "x " + long[1_000_000:]), (3, "y" * 3_000_000), (4, "z " * 400_000), (5, "z " * 100)]
    assert ours(spark, rows) == brute(rows, 50)
