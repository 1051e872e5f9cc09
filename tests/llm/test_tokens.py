from __future__ import annotations

import base64
import random
import string
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm.packing import best_cuts, op3_packing, pack
from ledgerline.llm.pretokens import TokenIds
from ledgerline.llm.token_counts import load_merges, op2_token_counts, surviving, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
IDS = TokenIds(PATH)
ODD = [None, "", " ", "a" * 5000, "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "don't  we'll\n\n\t é́ 你好 🙂🙂", "  lead", "tail  ", "  ", "1234567 89", "-" * 300, "aaaa aaab" * 200]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_library(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in op2_token_counts(spark, sf_dir).collect():
        n = len(ids_of(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 1024)


def test_odd_texts(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    assert {r.doc_id: r.n_tokens for r in token_counts(frame).collect()} == {i: len(ids_of(t)) for i, t in enumerate(ODD)}
    assert token_counts(frame.where("false")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abeinorst "), min_size=1, max_size=40))
def test_merging_equals_library(word):
    word = word.strip().replace(" ", "") or "a"
    merges = load_merges(public_tokenizers.path("byte_bpe_50k.json"))
    assert surviving(pa.array([word, word[::-1]]), merges).tolist() == [len(ids_of(word)), len(ids_of(word[::-1]))]


def check_packing(rows, texts):
    """rows: (doc_id, text) of the input, with different doc_ids."""
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(texts)
    for doc_id, pieces in by.items():
        whole, at = [*ids_of(texts[doc_id]), 0], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in whole[r.start : at]))
        assert at == len(whole)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024
    return len(sequences), sum(r.length for r in rows)


def test_packing(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    sequences, ids = check_packing(op3_packing(spark, sf_dir).collect(), texts)
    assert ids / (1024 * sequences) > 0.98


def test_packing_odd_texts(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").withColumn("offset", F.lit(0))
    check_packing(pack(frame).collect(), dict(enumerate(ODD)))
    assert pack(frame.where("false")).count() == 0
    twice = pack(frame.where("doc_id = 4").union(frame.where("doc_id = 4"))).collect()
    assert sum(r.length for r in twice) == 4


def test_blocks_of_a_stream(spark, monkeypatch, sf_dir):
    from ledgerline.llm import packing

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").coalesce(1)
    whole = packing.pack(docs).select(F.max("sequence_id")).first()[0]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    monkeypatch.setattr(packing, "BLOCK_IDS", 20_000)
    monkeypatch.setattr(packing.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()))
    found = pa.Table.from_batches(list(packing._pack(iter([batch]), packing.VOCABULARY, 1024, 8, 2, 8))).to_pylist()
    rows_ = [type("R", (), r)() for r in found]
    sequences, _ = check_packing(rows_, dict(rows))
    assert sequences <= whole + 1 + 10


@pytest.mark.parametrize("seed", range(5))
def test_cuts_are_cheapest(seed):
    rng = random.Random(seed)
    at, here = [], 0
    for _ in range(12):
        here += rng.randint(1, 5)
        at.append(here)
    cost = [rng.choice((0, 1, 3)) for _ in at]
    price = {0: 0}
    for j, place in enumerate(at):
        price[place] = min(price[i] + 8 - (place - i) + cost[j] for i in price if place - i <= 8)
    cuts = best_cuts(np.array(at), np.array(cost), 8)
    assert sum(8 - (b - a) + cost[at.index(b)] for a, b in zip([0, *cuts], cuts)) == price[at[-1]]  # noqa: B905


LONG = {
    "blanks": " " * 2_000_000 + "x",
    "no blanks": "".join(random.Random(5).choices("etaoin", k=10_000_000)),
    "base64": base64.b64encode(random.Random(6).randbytes(1_500_000)).decode(),
    "one letter": "a" * 2_000_000,
}


def test_very_long_texts(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(LONG.values())], "doc_id long, text string")
    want = {i: ids_of(t) for i, t in enumerate(LONG.values())}
    assert {r.doc_id: r.n_tokens for r in token_counts(frame).collect()} == {i: len(x) for i, x in want.items()}
    by = {}
    for r in pack(frame).select("doc_id", "start", "ids").orderBy("doc_id", "start").collect():
        by.setdefault(r.doc_id, []).append(r.ids)
    assert all(b"".join(by[i]) == np.array([*x, 0], "<u4").tobytes() for i, x in want.items())


def test_base64_in_seconds():
    start = time.perf_counter()
    word = "".join(random.Random(7).choices(string.ascii_letters, k=2_000_000))
    assert surviving(pa.array([word]), load_merges(PATH)).tolist() == [len(ids_of(word))]
    assert time.perf_counter() - start < 20  # the library's own time included


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("   \u00a0\u2003\u3000\n\t\x1c\x85a1!'s\u0558é\u200b\u0897<|"), max_size=30), max_size=4))
def test_pieces_are_encoded_as_in_their_text(texts):
    """Also characters that two Unicode versions class differently (U+0558) and white space beyond ASCII."""
    ids, begin = IDS.of(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == [ids_of(t) for t in texts]


def test_counts_of_any_character(spark):
    rows = [(k, "".join(f"a{chr(c)}1 {chr(c)}" for c in range(k, k + 0x800) if not 0xD800 <= c < 0xE000)) for k in range(0, 0x20000, 0x800)]
    found = token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {k: len(ids_of(t)) for k, t in rows}
