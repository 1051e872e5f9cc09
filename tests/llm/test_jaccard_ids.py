from __future__ import annotations

from ledgerline.llm.jaccard_join import jaccard_join

A = " ".join(f"a{i}" for i in range(100))
B = " ".join(f"b{i}" for i in range(100))


def near(text, k):
    return text.replace(f"{text[0]}{k} ", "")


def joined(spark, rows):
    return sorted((r.doc_id, r.class_id, r.n_links, r.n_texts, r.class_key) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_one_doc_id_with_two_texts(spark):
    found = joined(spark, [(1, A), (1, B), (2, near(A, 0)), (3, near(B, 0))])
    assert [r[:4] for r in found] == [(1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 1), (3, 1, 1, 1)]
    keys = {k for *_, k in found}
    assert len(keys) == 2 and found[2][4] != found[3][4]


def test_a_text_keeps_its_own_class(spark):
    found = joined(spark, [(1, A), (5, A), (5, B), (7, near(B, 0))])
    assert [r[:3] for r in found] == [(1, 1, 1), (5, 1, 1), (5, 5, 1), (7, 5, 1)]


def test_repeated_rows_of_two_texts(spark):
    found = joined(spark, [(1, A), (1, A), (1, B), (4, near(A, 0))])
    assert sorted(r[:4] for r in found) == [(1, 1, 0, 0), (1, 1, 2, 1), (1, 1, 2, 1), (4, 1, 2, 1)]


def test_very_long_texts(spark):
    long = " ".join(f"w{i * i}" for i in range(200_000))
    found = joined(spark, [(1, long), (2, long + " end"), (3, "x" * 3_000_000)])
    assert [r[:3] for r in found] == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]
