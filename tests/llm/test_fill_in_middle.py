from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import fill_in_middle as f
from ledgerline.llm.arrays import flat_bytes

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def brute(doc_id, text, rate=50, seed=42):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a = TOKEN.findall(text)
    n = len(a)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, text, n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(a[:low]), "".join(a[low:high]), "".join(a[high:])
    form = "spm" if h4 % 100 < 80 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, text, n, form, len(prefix), len(middle), output


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


texts = st.lists(st.text(st.sampled_from(" \t\n\x0b\x0c\r<>PSMaé字😀\xa0"), max_size=700), max_size=6)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(0, 1 << 32))
def test_scan_against_a_pattern(rows, number):
    import pyarrow as pa

    scan = f.Scan(*flat_bytes(pa.array(rows, pa.string())))
    states, counts = scan.rows()
    tokens = [TOKEN.findall(t) for t in rows]
    assert counts[:, f.START].tolist() == [len(t) for t in tokens]
    assert (states[:, f.START] % 4 == f.SEEN).tolist() == [any(m in t for m in ("<P>", "<S>", "<M>")) for t in rows]
    nth = np.array([number % (len(t) + 1) for t in tokens], np.int64)
    which = np.arange(len(rows))
    found = scan.chars(scan.places(which, np.zeros_like(which), nth), which)
    assert found.tolist() == [len("".join(t[:k])) for t, k in zip(tokens, nth.tolist(), strict=True)]


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from(" \n<>PSMaé"), max_size=600), st.integers(0, 600))
def test_scans_of_two_parts_compose(text, cut):
    import pyarrow as pa

    whole, left, right = (f.Scan(*flat_bytes(pa.array([t], pa.string()))).rows() for t in (text, text[:cut], text[cut:]))
    assert (right[0][0][left[0][0]] == whole[0][0]).all()
    assert (left[1][0] + right[1][0][left[0][0]] == whole[1][0]).all()


def sample():
    random.seed(5)
    rows = [(i, "".join(random.choice(["word", "é", " ", "\n\n", "<", "P>", "字", "\x0b", "a"]) for _ in range(random.randrange(900)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "a"), (1004, "<P>"), (1005, "x<S>y"), (1006, "<P<M >"), (None, "null id here"), (None, None), (7, "a second text"), (7, "a second text"), (1007, "ends in blanks \n ")]
    return rows + [(2000 + i, "<<P <S <M " * 200 + "tail" * i) for i in range(6)] + [(3000 + i, "x" * 5000) for i in range(4)] + [(4000 + i, " " * 5000) for i in range(4)]


@pytest.mark.parametrize("giant,piece", [(1 << 24, 1 << 20), (400, 97), (0, 3)])
def test_every_row_and_giants_in_pieces(spark, giant, piece):
    rows = sample() if piece > 3 else sample()[:40] + sample()[300:312]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS h1", "3 AS scan", "4 AS form", "5 AS its_key").repartition(5)
    got = f.fill_in_middle(frame, giant=giant, piece=piece)
    assert ordered(got.collect()) == ordered(brute(*r) for r in rows)
    back = got.select("text", f.restored(F.col("output"), F.col("form")).alias("back"))
    assert all(r.text == r.back for r in back.collect())
    assert f.fill_in_middle(frame.where("doc_id < 0"), giant=giant, piece=piece).count() == 0


def test_rates(spark):
    rows = [(i, f"some words of document {i}") for i in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    forms = {rate: {r.form: r["count"] for r in f.fill_in_middle(frame, rate=rate).groupBy("form").count().collect()} for rate in (0, 50, 100)}
    assert forms[0] == {"plain": 400} and "plain" not in forms[100] and 150 < forms[50]["plain"] < 250
    assert 280 < forms[100]["spm"] < 360


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in rows:
        doc_id, text, n, form, low, middle, output = brute(*r)
        want.append((doc_id, n, form, low, middle, digest(output), digest(text)))
    assert ordered(f.op11_fill_in_middle(spark, sf_dir).collect()) == ordered(want)
