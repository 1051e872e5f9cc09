"""Lines, markup and patterns of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbers import trimmed

LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"
BOX = "> **데이터 기준시점**"


def split_lines(text: Column) -> Column:
    """The lines of a text; a line end at its end begins no further line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (from 1) and line."""
    out = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    return out.select(key, (F.col("pos") + 1).alias("line_no"), "line")


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """The place of the first pattern found in the text, null if none is. Patterns are literals: they compile once."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(i)) for i, p in enumerate(patterns)))


def strip_tags(text: Column) -> Column:
    """Tags go without a space in their place; blanks become one; three line ends or more become two."""
    out = F.regexp_replace(text, "<[^>]+>", "")
    out = F.regexp_replace(out, "[ \\t\\u00A0\\u3000]+", " ")
    return trimmed(F.regexp_replace(out, "\\n{3,}", "\n\n"))


def excerpt(text: Column, most: int = 4000) -> Column:
    """Tags go, white space becomes one space, the first characters stay."""
    return F.left(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), "(?U)\\s+", " "), F.lit(most))


def section_slice(text: Column, header: Column, window: int = 12000) -> Column:
    """From the header's first place on, up to the next line of a Roman number and a title, ``window`` characters at most."""
    at = F.position(header, text)
    body = F.substr(text, at, F.lit(window))
    after = F.substr(text, at + F.char_length(header))
    cut = F.regexp_instr(after, F.lit("\\n\\s*([IVX]+)\\.\\s+[^\\n]+\\n"))
    size = F.when(cut > 0, F.least(F.lit(window), F.char_length(header) + cut - 1)).otherwise(F.lit(window))
    return F.when(at > 0, F.left(body, size))


def table_of_contents(doc_lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Headers of two or three marks outside fenced code: key, line_no, level, title."""
    fence = F.ltrim("line").startswith("```").cast("int")
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    outside = doc_lines.withColumn("fence", fence).withColumn("open", F.sum("fence").over(upto) % 2).where("open = 0 and fence = 0")
    header = "^(#{2,3})\\s+(.+)$"
    found = outside.where(F.col("line").rlike(header))
    title = trimmed(F.regexp_replace(trimmed(F.regexp_extract("line", header, 2)), "#+$", ""))
    return found.select(key, "line_no", F.char_length(F.regexp_extract("line", header, 1)).alias("level"), title.alias("title"))


def json_block(text: Column) -> Column:
    """The JSON object of an answer: inside a fence, or else from the first brace to the last; null if there is none."""
    fenced = F.regexp_extract(text, "(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```", 1)
    braced = F.regexp_extract(text, "(?s)(\\{.*\\})", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(braced), F.lit(""))


def markdown_cells(line: Column) -> Column:
    """The cells of a table line, without stars."""
    parts = F.split(line, "\\|", -1)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda c: F.regexp_replace(trimmed(c), "[*]", ""))


def first_paragraph(text: Column) -> Column:
    """The first paragraph of 50 characters or more outside headers and the data box, else the first one's first line."""
    kept = F.filter(split_lines(text), lambda s: ~trimmed(s).startswith("---") & ~trimmed(s).startswith(">"))
    marked = F.transform(kept, lambda s: F.when(trimmed(s).startswith("#") | (trimmed(s) == ""), F.lit("\n\n")).otherwise(F.concat(trimmed(s), F.lit("\n"))))
    paragraphs = F.filter(F.split(F.array_join(marked, ""), "\\n\\n+"), lambda p: trimmed(p) != "")
    whole = F.transform(paragraphs, lambda p: F.replace(trimmed(p), F.lit("\n"), F.lit(" ")))
    long = F.get(F.filter(whole, lambda p: F.char_length(p) >= 50), 0)
    return F.coalesce(long, F.substring_index(trimmed(F.get(paragraphs, 0)), "\n", 1), F.lit(""))


def slug(title: Column) -> Column:
    """Lower case, letters and digits of any script, one hyphen between words."""
    words = F.regexp_replace(F.lower(trimmed(title)), "(?U)[^\\w\\s-]", "")
    return F.regexp_replace(trimmed(words), "(?U)[-\\s]+", "-")
