from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from ledgerline.llm import quality as q
from ledgerline.llm.arrays import multipliers

MASK = (1 << 64) - 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def shape(word):
    out = ""
    for c in word.decode("utf-8", "replace"):
        kind = "A" if "A" <= c <= "Z" else "0" if c.isdecimal() else "a" if c.isalnum() and c != "_" else c
        out += "" if out.endswith(kind) else kind
    return out


def grams(values, n):
    factors = [int(c) for c in multipliers(n, n)]
    return [mix(sum(v * c for v, c in zip(values[i : i + n], factors, strict=True)) & MASK) for i in range(len(values) - n + 1)]


def plain_features(text):
    words = WORD.findall((text or "").encode())
    hashed = [xxhash.xxh3_64_intdigest(w + b" ") for w in words]
    shapes = [1 if i and w == words[i - 1] else xxhash.xxh3_64_intdigest(shape(w).encode()) for i, w in enumerate(words)]
    found = {0}
    for n in (1, 2):
        found.update(grams(hashed, n))
        for gram, times in Counter(grams(shapes, n)).items():
            level = sum(times / len(words) >= step for step in (0.02, 0.1, 0.3, 0.6))
            found.update(mix((gram + 1000 + 10 * n + k) & MASK) for k in range(level + 1))
    return {x >> (64 - q.BITS) for x in found}


TEXTS = [None, "", "one", "A plain text, 12 words", "x x x x y", "é_ü 3Ab " * 40, "---" * 30 + " aB1-" * 50, "w" * 500 + "-1-2-3-4-5-6-7-8-9-0-a-b-c"]


def test_features_of_whole_texts():
    row, feature = q.features(pa.array(TEXTS, pa.string()))
    for i, text in enumerate(TEXTS):
        assert set(feature[row == i].tolist()) == plain_features(text)


def test_scores_of_a_plain_model(spark):
    """Log-count ratios, the hinge model by its dual, and the scores, held against plain Python at sf 0.001."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").orderBy("doc_id").collect()[:60]
    found = [plain_features(r.text) for r in rows]
    y = [1.0 if r.quality == 1 else -1.0 for r in rows]
    seen = [Counter(f for fs, c in zip(found, y, strict=True) if c == side for f in fs) for side in (1.0, -1.0)]
    sizes = [y.count(1.0), y.count(-1.0)]
    ratio = {f: math.log((seen[0][f] + 1) / (sizes[0] + 2)) - math.log((seen[1][f] + 1) / (sizes[1] + 2)) for f in seen[0] | seen[1] if seen[0][f] + seen[1][f] >= 3}
    upper = [0.1 * len(y) / (2 * sizes[0 if c > 0 else 1]) for c in y]
    # the primal optimum by the same dual, swept in order until nothing moves
    w, dual = Counter(), [0.0] * len(y)
    vectors = [{f: ratio[f] for f in fs if ratio.get(f)} for fs in found]
    for _ in range(400):
        moved = 0.0
        for i, v in enumerate(vectors):
            slope = y[i] * sum(w[f] * x for f, x in v.items()) - 1
            new = min(max(dual[i] - slope / (sum(x * x for x in v.values()) + 1e-12), 0.0), upper[i])
            for f, x in v.items():
                w[f] += (new - dual[i]) * y[i] * x
            moved, dual[i] = max(moved, abs(new - dual[i])), new
        if moved < 1e-7:
            break
    ours = q.fit([np.array(sorted(fs)) for fs in found], np.array([r.quality for r in rows]), rounds=400)
    margins = [sum(w[f] * x for f, x in v.items()) for v in vectors]
    assert max(abs(ours.weights[np.array(sorted(fs))].sum() - m) for fs, m in zip(found, margins, strict=True)) < 0.02 * max(map(abs, margins))
