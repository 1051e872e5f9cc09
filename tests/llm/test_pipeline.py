from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import quality as q
from ledgerline.llm.shared import DOCUMENT_COLUMNS

from .test_joins_and_models import brute_join
from .test_mixing import check as check_mix
from .test_substring_dedup import brute as brute_windows
from .test_tokens import check_packing


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_copies", "repeated_windows", "mixture", "sequences"]
    texts = lambda frame: {r.doc_id: r.text for r in frame.collect()}

    kept = stages["quality"](spark, docs, sf_dir).cache()
    scores = q.classify(docs, q.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    assert set(texts(kept)) == {r.doc_id for r in scores.collect() if r.predicted} and kept.columns == list(DOCUMENT_COLUMNS)

    single = stages["near_copies"](spark, kept, sf_dir).cache()
    before = texts(kept)
    assert set(texts(single)) == {d for d, (root, _) in brute_join(before.items()).items() if d == root}

    cut = stages["repeated_windows"](spark, single, sf_dir).cache()
    before = texts(single)
    want = {d: kept_text if gone else before[d] for d, _, gone, kept_text in brute_windows(before.items(), 50)}
    assert texts(cut) == want and all(r.n_chars == len(r.text) for r in cut.collect())

    mixed = stages["mixture"](spark, cut, sf_dir).cache()
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    from ledgerline.llm.mixing import mix

    taken = mix(cut).collect()
    check_mix(taken, [tuple(r) for r in cut.select("doc_id", "source", "text").collect()])
    assert words == {r.doc_id: r.taken for r in taken if r.taken}

    rows = mixed.withColumn("doc_id", F.monotonically_increasing_id()).cache()  # a document taken twice is two rows
    packed = stages["sequences"](spark, rows, sf_dir).collect()
    check_packing(packed, texts(rows))
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == set(words)
