from __future__ import annotations

import random

import pytest

from ledgerline.llm.jaccard_join import jaccard_join

from .test_joins_and_models import brute_join


@pytest.mark.parametrize("depth", [1, 2])
def test_short_pairs_under_passages_that_many_longer_documents_share(spark, depth):
    chance = random.Random(7)

    def own(n):
        return " ".join(f"w{chance.getrandbits(48):x}" for _ in range(n))

    rows, pairs = [], []
    for group in range(8):
        passage = own(200)
        longer = [(1000 * group + i, f"{passage} {own(430)}") for i in range(120)]
        pairs += [(1000 * group + 500 + i, f"{passage} {own(20)}") for i in range(2)]
        rows += longer + pairs[-2:]
    found = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), runs=4, depth=depth, small=2).collect()
    want = {d: (d, 0) for d, _ in rows} | brute_join(pairs)
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == want
    assert all(n == 1 for _, n in brute_join(pairs).values())
