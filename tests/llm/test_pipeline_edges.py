from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ledgerline.llm.shared import DOCUMENT_COLUMNS

from .test_jaccard_ids import A, B, near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], SCHEMA)


def test_only_copies_go(spark, sf_dir):
    docs = frame(spark, [(1, A, "s"), (5, A, "s"), (5, B, "s"), (7, near(B, 0), "s"), (9, B + A, "s"), (9, B + A, "s"), (None, A, "s"), (None, "own words", None), (11, None, None), (11, "", "s")])
    found = sorted((r.doc_id or 0, r.text) for r in STAGES["near_copies"](spark, docs, sf_dir).fillna("").collect())
    assert found == sorted([(1, A), (5, B), (9, B + A), (0, "own words"), (11, ""), (11, "")])


@pytest.mark.parametrize("name", list(STAGES))
def test_edges_of_every_stage(spark, sf_dir, name):
    long = " ".join(f"w{i * i}" for i in range(60_000))
    rows = [(1, None, None), (2, "", "s"), (None, "a few words of a text", "s"), (3, "same text here", "t"), (3, "same text here", "t"), (3, "another text", "t"), (4, long, "u"), (5, " " * 3000 + "x", "u")]
    docs = frame(spark, rows).withColumn("row", F.lit("clash")).withColumn("size", F.lit("clash"))
    found = STAGES[name](spark, docs, sf_dir)
    if name != "sequences":
        assert found.columns == list(DOCUMENT_COLUMNS)
        texts = {(r.doc_id, r.text) for r in found.collect()}
        known = {(d, t) for d, t, _ in rows}
        assert texts <= known or name == "mixture"  # the mix may cut a text
        if name == "near_copies":
            assert found.count() == len(rows) - 1
        if name == "repeated_windows":
            assert found.count() == len(rows)
    else:
        ends = {}
        for r in found.collect():
            ends.setdefault(r.doc_id, set()).add(r.doc_tokens)
        assert set(ends) == {d for d, *_ in rows} and ends[2] == {1}
    assert STAGES[name](spark, docs.where("false"), sf_dir).count() == 0
