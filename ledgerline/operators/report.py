"""Text and JSON artefacts, one row each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_paragraph, slug

# The sections of a report in order.
SECTIONS = ("01_사업구조진단", "02_재무건강진단", "03_이익의질진단", "04_자본활용진단", "05_거버넌스진단", "06_경쟁포지션진단", "07_매크로민감도진단", "08_이번분기변화", "09_추적사항", "10_용어사전")
MISSING = "_(섹션 없음)_"


def joined(value: Column, order: Sequence[Column], separator: str = "\n") -> Column:
    """An aggregate: the values in order, as one text."""
    ordered = F.sort_array(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), value.alias("v"))))  # compiled, unlike array_sort
    return F.array_join(F.transform(ordered, lambda x: x.v), separator)


# What stands between the pieces of a section and after a section that was cut.
NEXT_PIECE, CUT = "\n\n--- 다음 본문 조각 ---\n\n", "\n... [잘림]"


def joined_sections(pieces: DataFrame, key: str = "doc_id", order: str = "path", most: int = 8000) -> DataFrame:
    """Each key's sections (key, section_key, order, text) from all files: key, section_key and text, the pieces in order,
    cut at ``most`` characters with a mark. Empty and null pieces are left out; those that begin after the cut never
    meet the others, so that a text is no longer than it may be, but for its last piece."""
    held = pieces.where(F.coalesce("text", F.lit("")) != "")
    before = Window.partitionBy(key, "section_key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.char_length("text") + len(NEXT_PIECE)).over(before), F.lit(0))
    near = held.withColumn("begin", begin).where(F.col("begin") <= most + len(NEXT_PIECE)).withColumn("text", F.left("text", F.lit(most + 1)))
    whole = near.groupBy(key, "section_key").agg(joined(F.col("text"), [F.col("begin")], NEXT_PIECE).alias("text"))
    return whole.withColumn("text", F.when(F.char_length("text") > most, F.concat(F.left("text", F.lit(most)), F.lit(CUT))).otherwise(F.col("text")))


# How a text begins that stands for a failed answer.
NOTE_FAILED, INDUSTRY_FAILED = "(LLM 호출 실패", "(LLM"


def valid_note(observation: Column) -> Column:
    """Whether a daily note has an observation to publish."""
    text = F.coalesce(observation, F.lit(""))
    return (text != "") & ~F.startswith(text, F.lit(NOTE_FAILED))


def valid_industry_note(summary: Column, factors: Column) -> Column:
    """Whether an industry note has a summary and two factors that tell the companies apart."""
    text = F.coalesce(summary, F.lit(""))
    return (text != "") & ~F.startswith(text, F.lit(INDUSTRY_FAILED)) & (F.coalesce(F.size(factors), F.lit(0)) >= 2)


def assembled(reports: DataFrame, texts: DataFrame, key: str = "doc_id", sections: Sequence[str] = SECTIONS) -> DataFrame:
    """Each report (key) with its sections (key, section_id, text) in fixed order: contents with each one's first
    paragraph, then the bodies; a placeholder stands for a missing one. key, report, present."""
    wanted = reports.select(key, F.posexplode(F.array(*map(F.lit, sections))).alias("ord", "section_id"))
    parts = wanted.join(texts, [key, "section_id"], "left")
    entry = F.concat(F.lit("- ["), "section_id", F.lit("](#"), slug(F.col("section_id")), F.lit(") "), first_paragraph(F.coalesce(F.col("text"), F.lit(""))))
    body = F.concat(F.lit("## "), "section_id", F.lit("\n\n"), F.coalesce(F.col("text"), F.lit(MISSING)))
    out = parts.groupBy(key).agg(joined(entry, [F.col("ord")]).alias("contents"), joined(body, [F.col("ord")], "\n\n").alias("bodies"), F.count("text").alias("present"))
    return out.select(key, F.concat("contents", F.lit("\n\n"), "bodies").alias("report"), "present")


def incomplete(reports: DataFrame, usable: DataFrame, key: str = "doc_id", sections: Sequence[str] = SECTIONS) -> DataFrame:
    """The sections without which a report can't be assembled: key, section_id."""
    wanted = reports.select(key, F.explode(F.array(*map(F.lit, sections))).alias("section_id"))
    return wanted.join(usable.select(key, "section_id"), [key, "section_id"], "left_anti")


def markdown_table(df: DataFrame, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row: the rows as a Markdown table; nulls are dashes. For tables of report size."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns)), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    return df.agg(F.concat(F.lit(head), joined(row, order)).alias("table"))


def daily_note(day: str, hits: DataFrame, counts: DataFrame, top: DataFrame) -> DataFrame:
    """One row: the day's note, with hits by kind, the top tickers and the hits of each."""
    summary = counts.agg(joined(F.concat_ws(" ", "trigger_type", F.col("n").cast("string")), [F.col("display_ord")], ", ").alias("summary"))
    lines = hits.join(top.select("ticker", "total_score"), "ticker").groupBy("ticker", "total_score").agg(
        joined(F.concat(F.lit("- "), "trigger_type", F.lit(" "), F.format_string("%.2f", "severity")), [F.col("rank")]).alias("body"), F.min("rank").alias("first"),
    )
    card = F.concat(F.lit("### "), F.col("ticker").cast("string"), F.lit("\n"), "body")
    cards = lines.agg(joined(card, [-F.col("total_score"), F.col("first")], "\n\n").alias("cards"))
    return summary.crossJoin(cards).select(F.concat(F.lit(f"# {day}\n\n> **트리거**: "), "summary", F.lit("\n\n"), "cards").alias("note"))


def trigger_report(day: str, hits: DataFrame, top: DataFrame) -> DataFrame:
    """One row: the day's report as JSON. Hits and top tickers are of report size."""
    rows = hits.agg(F.array_sort(F.collect_list(F.struct("rank", "ticker", "trigger_type", "severity", "score"))).alias("hits"), F.countDistinct("ticker").alias("tickers"))
    best = top.agg(F.collect_list(F.struct("ticker", "total_score")).alias("top"))
    return rows.crossJoin(best).select(F.to_json(F.struct(F.lit(day).alias("fetch_date"), (F.size("hits") > 0).alias("should_publish"), "tickers", "top", "hits")).alias("report"))


def trigger_report_lines(day: str, hits: DataFrame, top: DataFrame) -> DataFrame:
    """The same report as JSON lines, for any number of hits: ord 0 holds the day, whether to publish, the number of tickers
    and the top ones, each other line the hit whose rank is its ord. Written in ranges of ord, it is a file in order."""
    best = top.agg(F.collect_list(F.struct("ticker", "total_score")).alias("top"))
    head = hits.agg(F.count_distinct("ticker").alias("tickers"), (F.count("*") > 0).alias("should_publish")).crossJoin(best)
    first = head.select(F.lit(0).cast("long").alias("ord"), F.to_json(F.struct(F.lit(day).alias("fetch_date"), "should_publish", "tickers", "top")).alias("line"))
    return first.unionByName(hits.select(F.col("rank").cast("long").alias("ord"), F.to_json(F.struct("rank", "ticker", "trigger_type", "severity", "score")).alias("line")))


def provenance(*stamps: Column) -> Column:
    return F.concat_ws("\n", F.lit("> **데이터 기준시점**"), *(F.concat(F.lit("> - "), s) for s in stamps))


def envelope(**parts: Column) -> Column:
    """JSON of what is known; missing parts are left out."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in parts.items())), {"ignoreNullFields": "true"})


def redacted(text: Column, secret: Column) -> Column:
    return F.when(F.coalesce(secret, F.lit("")) == "", text).otherwise(F.replace(text, secret, F.lit("***")))
