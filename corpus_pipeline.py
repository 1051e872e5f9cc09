"""The corpus pipeline: five stages over documents, each on all that the one before kept.

1. The quality classifier's rejects go.
2. Of each group of near copies one row stays, that of the smallest doc_id.
3. Word windows that a smaller document also has are taken out of the texts.
4. Sources are mixed to their target weights: documents are left out, cut or repeated.
5. What is left is packed into sequences.

Rows are documents: repeated rows and rows of one doc_id with several texts are each judged and packed for themselves.
Null texts count as empty, null doc_ids stay null, and an empty table gives an empty result in every stage. Columns
beside those of documents are dropped by the first stage that meets them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import quality as quality_model
from ledgerline.llm.jaccard_join import jaccard_join
from ledgerline.llm.mixing import mixed_corpus
from ledgerline.llm.packing import pack
from ledgerline.llm.shared import DOCUMENT_COLUMNS, materialise
from ledgerline.llm.substring_dedup import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score is 0.7 or more; empty texts are scored as others are."""
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.classify(docs, model, 0.7, *DOCUMENT_COLUMNS[1:]).where("predicted = 1").select(*DOCUMENT_COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class: the smallest doc_id's (null last), of a repeated one the first as written. Each row is
    a document of its own, so that of a doc_id with two texts one may go without the other, and of a row that is
    repeated exactly one stays. Texts without words have no copies and stay."""
    rows = materialise(docs.select(*DOCUMENT_COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    classes = jaccard_join(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "class_id")
    first = F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row")
    kept = rows.select("row", "doc_id").join(classes, "row").groupBy("class_id").agg(first)
    return rows.join(kept, "row", "left_semi").drop("row")


def repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated windows out of the texts (the kept words then have one space between); other texts and all rows stay."""
    found = substring_dedup(docs, carry=("text", "lang", "source"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does; a last part of one is its first words. A document taken twice is two
    rows, which the next stage packs apart."""
    return mixed_corpus(docs.select(*DOCUMENT_COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 ids."""
    return pack(docs).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_windows", repeated_windows),
    ("mixture", mixture),
    ("sequences", sequences),
]
ORACLE_SQL = None  # a fitted model decides in the first stage; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
