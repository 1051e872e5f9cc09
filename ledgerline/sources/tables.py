"""Readers of tables that come as text: watchlists, corp codes, health files, reports, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import trimmed
from ..functions.text import lines, split_lines


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def watchlist(docs: DataFrame, key: str = "path") -> DataFrame:
    """The rows of the tables that begin with a line "| #": key, ord, name, ticker, corp_code (TBD is null), sector,
    note. Rows have six cells or more, the first a number; a line without a bar ends the table."""
    row = lines(docs, key).withColumn("line", trimmed(F.col("line")))
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.when(F.startswith("line", F.lit("| #")), 1).when(~F.startswith("line", F.lit("|")), 0)
    row = row.withColumn("kind", kind).withColumn("inside", F.last("kind", ignorenulls=True).over(order) == 1).where("inside and kind is null")
    cells = F.transform(F.split("line", "\\|", -1), lambda c: trimmed(c))
    row = row.withColumn("cells", F.slice(cells, 2, F.greatest(F.size(cells) - 2, F.lit(0)))).where((F.size("cells") >= 6) & F.get("cells", 0).rlike("^[0-9]+$"))
    at = lambda i: F.get("cells", i)
    return row.select(
        key, (F.row_number().over(Window.partitionBy(key).orderBy("line_no")) - 1).alias("ord"), at(1).alias("name"), at(2).alias("ticker"),
        F.when(F.upper(at(3)) != "TBD", at(3)).alias("corp_code"), at(4).alias("sector"), at(5).alias("note"),
    )


def corp_codes(spark: SparkSession, path: str) -> DataFrame:
    """stock_code and corp_code of listed companies from XML with a ``list`` element for each; the last one wins."""
    schema = "corp_code string, corp_name string, stock_code string, modify_date string"
    rows = spark.read.schema(schema).option("rowTag", "list").format("xml").load(path)
    return last_codes(rows.withColumn("ord", F.monotonically_increasing_id()))


def last_codes(rows: DataFrame) -> DataFrame:
    found = rows.select(trimmed(F.col("stock_code")).alias("stock_code"), trimmed(F.col("corp_code")).alias("corp_code"), "ord").where("stock_code != '' and corp_code != ''")
    last = Window.partitionBy("stock_code").orderBy(F.desc("ord"))
    return found.withColumn("nth", F.row_number().over(last)).where("nth = 1").select("stock_code", "corp_code")


HEALTH = "timer string, last_run timestamp, status string, details map<string,string>"


def health(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Health files, one object each (or one on each line); what doesn't parse is left out."""
    rows = spark.read.schema(HEALTH + ", _corrupt_record string").json(path, multiLine=multi_line, mode="PERMISSIVE")
    return rows.where("_corrupt_record is null and timer is not null").drop("_corrupt_record")


def reports(files: DataFrame) -> DataFrame:
    """The report of each company and period among files (path, modified): the assembled one, else the first section;
    warnings never. Paths are .../companies/company/period/name."""
    part = lambda i: F.element_at(F.split("path", "/"), i)
    out = files.select("path", "modified", part(-3).alias("company"), part(-2).alias("period"), part(-1).alias("name"))
    rank = F.when(F.startswith("name", F.lit("00_")), 0).when(F.startswith("name", F.lit("01_")), 1)
    out = out.withColumn("rank", rank).where((F.col("rank") >= 0) & F.endswith("name", F.lit(".md")) & ~F.contains("name", F.lit("warnings")))
    first = Window.partitionBy("company", "period").orderBy("rank", "name")
    return out.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("company", "period", "name", "path", "modified", (F.col("rank") == 1).alias("partial"))


def warnings(files: DataFrame, most: int = 30) -> DataFrame:
    """The first warning files by path: company, period, section."""
    part = lambda i: F.element_at(F.split("path", "/"), i)
    found = files.where(F.endswith("path", F.lit("_warnings.md")))
    return found.orderBy("path").limit(most).select("path", part(-3).alias("company"), part(-2).alias("period"), F.substring_index(part(-1), ".", 1).alias("section"))


def note_headers(notes: DataFrame, key: str = "path") -> DataFrame:
    """Per daily note: headline, trigger line and number of cards."""
    row = lines(notes.where(~F.endswith(F.col(key), F.lit("_index.md"))), key)
    first = lambda cond: F.min(F.when(cond, F.struct("line_no", "line")))["line"]
    return row.groupBy(key).agg(
        trimmed(F.regexp_replace(first(F.startswith("line", F.lit("# "))), "^# ", "")).alias("headline"), first(F.startswith("line", F.lit("> **트리거**:"))).alias("trigger_line"),
        F.count_if(F.startswith("line", F.lit("### "))).alias("cards"),
    )


def sector_history(file_names: DataFrame) -> DataFrame:
    """sector and iso_week of notes named YYYY-Wnn-sector."""
    pattern = "^([0-9]{4}-W[0-9]{2})-(.+)$"
    stem = F.regexp_replace("name", "\\.md$", "")
    return file_names.where(stem.rlike(pattern)).select(F.regexp_extract(stem, pattern, 2).alias("sector"), F.regexp_extract(stem, pattern, 1).alias("iso_week"))


def last_line(text: Column) -> Column:
    return F.element_at(split_lines(text), -1)
