from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import nearest as nn
from ledgerline.llm import quality as q
from ledgerline.llm.components import components
from ledgerline.llm.jaccard_join import jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_join(rows, threshold=0.8, n=5):
    sets = {}
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        sets[doc_id] = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    inverted = defaultdict(list)
    for doc_id, grams in sets.items():
        for g in grams:
            inverted[g].append(doc_id)
    root, degree = {d: d for d in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, grams in sets.items():
        for j, common in Counter(j for g in grams for j in inverted[g] if j < i).items():
            if common / (len(grams) + len(sets[j]) - common) >= threshold - 1e-12:
                degree[i] += 1
                degree[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {d: (find(d), degree[d]) for d in sets}


@pytest.mark.parametrize("options", [{}, {"small": 3, "most": 3}])
def test_join_equals_brute_force(spark, sf_dir, options):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = [tuple(r) for r in docs.collect()]
    extra = [(10_000 + i, " ".join(w for k, w in enumerate(base[0][1].split()) if k % 60 != i % 60)) for i in range(12)]
    extra += [(20_000 + i, base[1][1]) for i in range(5)] + [(30_000, "one two"), (30_001, "one  two"), (30_002, "one two three")]
    rows = base + extra
    found = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == brute_join(rows) and len(found) == len(rows)


def test_join_edges(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("bucket", F.lit("x"))
    found = sorted(((r.doc_id or 0), r.class_id, r.n_links) for r in jaccard_join(frame).collect())
    assert found == [(0, None, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 2), (4, 4, 2), (5, 4, 2)]
    assert jaccard_join(frame.where("false")).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.id: r.root for r in found.collect()} == {i: 0 for i in range(1, 41)} | {101: 100, 200: 100}


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = q.classify(docs, q.train(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert sum(r.predicted == 1 for r in held if r.quality == 1) / sum(r.quality == 1 for r in held) > 0.98


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "w " * 50_000), (3, "ok words here")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = q.train(docs, none)
    found = q.classify(docs, model).collect()
    assert len(found) == 5 and all(r.score == 0.5 and r.predicted == 0 for r in found)
    assert q.classify(docs.where("false"), model).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 7)], "doc_id long, quality int")
    assert q.train(docs, odd).shift == 0.0


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    y = np.where(np.arange(60) % 2 == 0, 1.0, -1.0)
    rows = [np.unique(np.append(rng.integers(10, 50, 6), 1 if c > 0 else 2)) for c in y]
    w = q.dual_descent(rows, y, np.ones(64), 10.0, 200, 0)
    assert all(np.sign(w[r].sum()) == c for r, c in zip(rows, y, strict=True))


def test_nearest_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = defaultdict(dict)
    for r in nn.op10_nearest(spark, sf_dir).collect():
        found[r.query_id][r.rank] = (r.vec_id, r.score)
    hits = total = 0
    for query in ids[ids % 20 == 0]:
        scores = x @ x[ids == query][0]
        scores[ids == query] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        got = found[int(query)]
        assert sorted(got) == list(range(1, 21)) and int(query) not in {v for v, _ in got.values()}
        assert all(got[k][1] >= got[k + 1][1] for k in range(1, 20))
        assert all(abs(scores[ids == v][0] - s) < 1e-12 for v, s in got.values())
        hits += len(best & {v for v, _ in got.values()})
        total += 20
    assert hits / total >= 0.9


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 3)]) for i in range(20)] + [(20, None), (21, [nan, 1.0]), (22, [inf, 1.0]), (23, [0.0, 0.0]), (24, [1.0, None]), (None, [1.0, 1.0]), (5, [1.0, 2.0])]
    rows += [(1000 + i, [3.0, 3.0]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit("clash"))
    found = nn.nearest(frame, F.col("vec_id") % 20 == 0, top=5).orderBy("query_id", "rank").collect()
    of = {qid: [(r.vec_id, r.score) for r in found if r.query_id == qid] for qid in (0, 1000)}
    assert of[0] == [(1000 + i, 3.0) for i in range(5)]
    assert of[1000] == [(1001 + i, 18.0) for i in range(5)]
    assert nn.nearest(frame.where("false"), F.lit(True)).count() == 0
    assert nn.nearest(frame.where("vec_id = 0"), F.lit(True)).count() == 0
