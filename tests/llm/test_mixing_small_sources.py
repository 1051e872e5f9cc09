from __future__ import annotations

from hashlib import md5

from pyspark.sql import functions as F

from ledgerline.llm.mixing import GOLDEN, mix, mixed_corpus, schedule, shares, sized, targets

from .test_mixing import WORD, brute_targets


def test_small_sources_come_near_their_targets(spark):
    sizes = {"a": 1_200_000, "b": 700_000, "c": 90_000, "d": 400, "e": 60, "f": 30, "g": 10, "h": 3, None: 1}
    rows = []
    for source, words in sizes.items():
        each = max(1, min(1000, words // 3))
        rows += [(len(rows) + k, source, "w " * min(each, words - begin)) for k, begin in enumerate(range(0, words, each))]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    target, taken = {}, {}
    for r in mix(frame).collect():
        assert 0 <= r.taken <= 2 * r["size"]
        target[r.source] = r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert set(taken) == set(sizes)
    for source, words in taken.items():
        assert abs(words - target[source]) <= max(0.5, 0.01 * target[source]), source
    assert {r.source for r in mixed_corpus(frame).select("source").distinct().collect()} == set(sizes)


def brute_taken(rows):
    """taken of each row: its source's documents by their hash, one after the other, then again, up to the target."""
    sizes, by = {}, {}
    for doc_id, source, text in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
        by.setdefault(source, []).append((md5(f"0:{doc_id}:{md5((text or '').encode()).hexdigest()}".encode()).hexdigest(), doc_id, len(WORD.findall(text or ""))))
    want, out = brute_targets(sizes), {}
    for source, docs in by.items():
        left = int(want[source] + 0.5)
        for _, doc_id, size in sorted(docs) * 2:
            out[doc_id] = out.get(doc_id, 0) + min(left, size)
            left -= min(left, size)
    return out, want


def test_taken_by_brute_force(spark):
    rows = [(0, "large", "w " * 1_000_000), (1, "large", "v " * 1_000_000)] + [(2 + i, f"small{i // 2}", "w " * (i % 2 * 6 + 2)) for i in range(24)]
    found = mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    taken, want = brute_taken(rows)
    assert {r.doc_id: r.taken for r in found} == taken
    assert all(r.target == want[r.source] for r in found) and len(want) == 13


def test_many_sources(spark):
    n = 100_000
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % n).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"))
    sources = mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"))
    r = sources.agg(F.count("*").alias("n"), F.max(F.abs(F.col("taken") - F.col("target"))).alias("off")).first()
    assert r.n == n and r.off <= 0.5


def test_slots_follow_the_points(spark):
    """Each slot's source is the one whose share the slot's point falls in, and sources alternate as their shares say."""
    rows = [(i, "abc"[min(i % 6, 2)], "w " * 50) for i in range(600)]
    goal = targets(sized(spark.createDataFrame(rows, "doc_id long, source string, text string")))
    plan = schedule(goal, slots=5000).orderBy("slot").collect()
    parts = {r.key: r for r in shares(goal, slots=5000).collect()}
    assert [r.slot for r in plan] == list(range(int(next(iter(parts.values())).n_points)))
    ranks = {}
    for r in plan:
        assert parts[r.key].low <= r.slot * GOLDEN % 1.0 < parts[r.key].high
        assert r["rank"] == ranks.get(r.key, 0)
        ranks[r.key] = r["rank"] + 1
        share = parts[r.key].high - parts[r.key].low
        assert abs(ranks[r.key] - (r.slot + 1) * share) < 3
    assert all(r.n_slots == ranks[r.key] for r in plan)
