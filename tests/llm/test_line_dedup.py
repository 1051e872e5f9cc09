from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm.line_dedup import BLANKS, hot_lines, line_dedup, line_hashes, op12_line_dedup, repeated_lines

SCHEMA = "doc_id long, text string"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows):
    """By a plain dictionary of each key's smallest document; a null id comes last."""
    rank = lambda d: (d is None, d or 0)
    first = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), rank(d)), rank(d))
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == rank(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(frame):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in frame.collect()), key=repr)


def test_edges(spark):
    rows = [
        (3, "The same line here\nown line of three\nThe same line here"), (2, "\t THE SAME line here \x0b\n\nshort\nshort\n"), (9, "short\nthe same line here"),
        (None, "the same line here\nonly null has this\nonly null has this"), (None, "only null has this"), (4, None), (5, ""), (6, "\n\n"), (7, "ÀÉÎ line of capitals"), (8, "àéî line of capitals"),
        (3, "another text of three\nown line of three"), (1, "ten chars!\nnine char"), (10, "TEN CHARS!\nNINE CHAR"), (2, "\t THE SAME line here \x0b\n\nshort\nshort\n"), (11, "\xa0the same line here"),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "2 AS dropped", "3 AS lines", "'x' AS text_hash", "4 AS first")
    assert found(line_dedup(frame)) == brute(rows)
    assert found(line_dedup(frame.where("doc_id < 0"))) == []


@pytest.mark.parametrize("hot", [1, 4, 1 << 30])
def test_random_texts(spark, hot):
    random.seed(hot)
    pool = [f"line number {i} of the pool" for i in range(40)] + ["", "x", " a line with blanks ", "A LINE WITH BLANKS"]
    rows = [(i, "\n".join(random.choice(pool) if random.random() < 0.6 else f"the own line {random.random()}" for _ in range(random.randrange(30)))) for i in range(300)]
    rows += [(1000, "\n".join(["one very long document"] * 20000 + pool)), (1001, "the hottest line of all\n" * 5000)] + [(2000 + i, "the hottest line of all") for i in range(500)]
    random.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert found(line_dedup(frame, hot=hot)) == brute(rows)


def test_hot_lines_have_their_first_document_and_are_few(spark):
    rows = [(i, f"a line that all have\nline of {i} alone") for i in range(400)]
    lines = line_hashes(spark.createDataFrame(rows, SCHEMA))
    assert [r["first"] for r in hot_lines(lines).collect()] == [0]
    assert hot_lines(lines, hot=1000).count() <= 1000 * 4


def test_ranges_are_not_dealt_out_again(spark):
    plan = repeated_lines(spark.createDataFrame([(1, "a line of words"), (2, "a line of words")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "rangepartitioning" in window and "hashpartitioning" not in window


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, n, gone, hashlib.sha256(text.encode()).hexdigest()) for d, n, gone, text in brute(rows))
    query = op12_line_dedup(spark, sf_dir)
    assert sorted(map(tuple, query.collect())) == want and sum(r[2] for r in want) > 0
    assert "Python" not in query._jdf.queryExecution().toString()
    assert query.schema == query.select(F.col("doc_id").cast("long"), F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"), "kept_sha256").schema
