"""Line dedup by ranges of hashes, in DataFrame operations only.

Lines become hashes with a document and a position; text stays where it is. The hashes are dealt out by ranges and
sorted by hash, document and position, so that each range streams a hash's first occurrence before all others. Hashes
that hold a large share of all lines are aggregated before any shuffle and meet their first document as a broadcast row.
What comes back is a run-length bitmap for each document that loses lines.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

BLANKS = " \t\n\x0b\x0c\r"
LEAST_CHARS = 10
SAMPLE = 1 << 20  # lines, about, by which a hash's share is estimated; it decides where a line is compared, never whether
HOT = 4  # a hash is hot that has over one line in HOT * spark.sql.shuffle.partitions, so at most that many are


def key_of(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def lines_of(text: Column) -> Column:
    """A text's lines; a null text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text_hash, pos, and high and low (128 bits of the key) of every line whose key has ``least_chars``."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = rows.select("doc_id", "text_hash", "pos", key_of(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    return keys.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("high"), F.xxhash64(F.lit(1), F.col("key")).alias("low"))


def later(doc_id: Column, first: Column) -> Column:
    """Whether a document comes after the first that has the line; null ids come last and are one document."""
    return F.coalesce(doc_id > first, doc_id.isNull() & first.isNotNull())


def hot_lines(lines: DataFrame, hot: int = HOT) -> DataFrame:
    """high, low and first (smallest doc_id) of the hashes with a large share of all lines: at most some
    ``hot * spark.sql.shuffle.partitions`` rows, of whatever input."""
    total = lines.count()
    each = max(1, -(-total // SAMPLE))
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = lines.where(F.pmod(F.xxhash64(F.lit(2), "doc_id", "text_hash", "pos"), F.lit(each)) == 0)
    hot_keys = sample.groupBy("high", "low").count().where(F.col("count") > total / each / (hot * tasks)).select("high", "low")
    found = lines.join(F.broadcast(materialise(hot_keys, "hot_keys")), ["high", "low"])
    return materialise(found.groupBy("high", "low").agg(F.min("doc_id").alias("first")), "hot_lines")


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, hot: int = HOT) -> DataFrame:
    """doc_id, text_hash and pos of every line whose key is also in a document with a smaller doc_id."""
    lines = materialise(line_hashes(docs, least_chars), "line_hashes")
    firsts = hot_lines(lines, hot)
    of_hot = lines.join(F.broadcast(firsts), ["high", "low"])
    others = lines.join(F.broadcast(firsts.select("high", "low")), ["high", "low"], "left_anti").repartitionByRange("high", "low")
    stream = Window.partitionBy("high", "low").orderBy(F.asc_nulls_last("doc_id"), "text_hash", "pos")
    others = others.withColumn("first", F.first("doc_id").over(stream))
    found = of_hot.select(*others.columns).unionByName(others)
    return found.where(later(F.col("doc_id"), F.col("first"))).select("doc_id", "text_hash", "pos")


def drop_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, hot: int = HOT) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text, which tells rows of one doc_id apart) and dropped: the runs of lines,
    from 0, that go, as structs of start and end in order. One row for each document that loses lines; all others keep
    theirs whole."""
    found = repeated_lines(docs, least_chars, hot)
    # repeated rows give each place twice, which a dense rank takes as one
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "text_hash").orderBy("pos"))
    runs = found.withColumn("run", F.col("pos") - rank).groupBy("doc_id", "text_hash", "run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    return runs.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("dropped"))


def line_dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, hot: int = HOT) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (as in drop_bitmaps; null where none) and kept_text of every row.

    Lines are what \\n separates; a null or empty text is one empty line. A key of ``least_chars`` code points or more
    that is in several documents stays, with all its lines there, in the one with the smallest doc_id and goes from
    the others. Rows of one doc_id are one document; a null doc_id comes after all others. Repeated rows repeat. Other
    columns aren't read. An empty table gives an empty result. Keys are compared by 128 bits of hashes.
    """
    bitmaps = materialise(drop_bitmaps(docs, least_chars, hot), "drop_bitmaps")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    of_row = bitmaps.select(F.col("doc_id").alias("its_id"), F.col("text_hash").alias("its_hash"), "dropped").hint("shuffle_hash")
    rows = rows.join(of_row, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_hash") == F.col("its_hash")), "left")
    rows = rows.select("doc_id", "text", "dropped", lines_of(F.col("text")).alias("lines")).withColumn("n_lines", F.size("lines"))
    begins, ends = F.concat(F.array(F.lit(0)), F.col("dropped.end")), F.concat(F.col("dropped.start"), F.array("n_lines"))
    kept = F.flatten(F.zip_with(begins, ends, lambda begin, end: F.slice(F.col("lines"), begin + 1, end - begin)))
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    gone = F.coalesce(F.aggregate("dropped", F.lit(0).cast("long"), lambda n, run: n + run["end"] - run["start"]), F.lit(0)).cast("long")
    return rows.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), gone.alias("n_dropped"), "dropped", text.alias("kept_text"))


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
