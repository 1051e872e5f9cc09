from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import nearest as nn

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, is_query, top):
    out = {}
    for q, x in rows:
        if is_query(q):
            found = sorted((-float((np.array(x) * np.array(y)).sum()), v) for v, y in rows if v != q)
            out[q] = [(v, -s) for s, v in found[:top]]
    return out


def found(frame, top, **options):
    out = {}
    for r in nn.nearest(frame, F.col("vec_id") % 10 == 0, top=top, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_two_lengths(spark):
    rows = [(i, [float(i % 7), 1.0, -2.0]) for i in range(40)]
    frame = spark.createDataFrame(rows + [(100 + i, [1.0, 9.0]) for i in range(20)] + [(200, [])], SCHEMA)
    assert found(frame, 3) == brute(rows, lambda q: q % 10 == 0, 3)


@pytest.mark.parametrize("size", [1e-170, 1e-3, 1e6, 1e150])
def test_ties_and_large_norms(spark, size):
    rng = np.random.default_rng(4)
    base = [(i, (rng.integers(-3, 4, 5) * size).tolist()) for i in range(60)]
    rows = [(i, x) for i, x in base if any(x)]
    got, want = found(spark.createDataFrame(rows, SCHEMA), 8), brute(rows, lambda q: q % 10 == 0, 8)
    assert {q: [v for v, _ in x] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}


def test_cells_of_many_queries(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = found(frame, 5)
    monkeypatch.setattr(nn, "HELD_QUERIES", 2)
    monkeypatch.setattr(nn, "CELL_ROWS", 1)
    assert found(frame, 5) == whole


def test_leaves_of_fixed_rows(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16)) * 5
    rows = [(i, (centres[i % 40] + rng.normal(size=16)).tolist()) for i in range(4000)]
    got, want = found(spark.createDataFrame(rows, SCHEMA), 10, leaf_rows=100, leaves=30), brute(rows, lambda q: q % 10 == 0, 10)
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9
