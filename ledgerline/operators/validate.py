"""Validators of texts: style, numbers, tables, consistency, markers, secrets; and the choice among attempts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.numbers import absolute_amount, cell_number, signed_amount, trimmed
from ..functions.text import first_match, markdown_cells, split_lines

AMOUNT_AHEAD = "^(.{0,60}?)(?<![A-Za-z\\d.])([+-]?[△▲▼]?\\s*\\d{1,4}(?:,\\d{3})*(?:\\.\\d+)?)\\s*(조|억)"


def _array_of(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))


def style_hits(doc_lines: DataFrame, patterns: Sequence[str] = rules.VAGUE_SOURCE, category: str = "vague_source", key: str = "doc_id") -> DataFrame:
    """Lines that a rule finds, with the first such rule: key, line_no, category, rule_ord, snippet."""
    found = doc_lines.withColumn("rule_ord", first_match(F.col("line"), patterns)).where("rule_ord is not null")
    return found.select(key, "line_no", F.lit("fail").alias("severity"), F.lit(category).alias("category"), "rule_ord", F.left(trimmed(F.col("line")), F.lit(140)).alias("snippet"))


def unmarked_speculation(doc_lines: DataFrame, patterns: Sequence[str] = rules.SPECULATIVE, marker: str = rules.INFERENCE, key: str = "doc_id") -> DataFrame:
    """Speculative lines that have no marker on them or on the lines next to them."""
    order = Window.partitionBy(key).orderBy("line_no")
    near = F.concat_ws(" ", "line", F.lag("line").over(order), F.lead("line").over(order))
    out = doc_lines.withColumn("near", near).withColumn("rule_ord", first_match(F.col("line"), patterns))
    out = out.where(F.col("rule_ord").isNotNull() & ~F.contains("near", F.lit(marker)))
    return out.select(key, "line_no", F.lit("fail").alias("severity"), F.lit("missing_inference_marker").alias("category"), "rule_ord", F.left(trimmed(F.col("line")), F.lit(140)).alias("snippet"))


def document_checks(docs: DataFrame, assembled: bool, key: str = "doc_id") -> DataFrame:
    """What a whole text lacks: assembled ones the data box (fail), sections the glossary and an analogy (warn)."""
    wanted = (("fail", "missing_timestamp_box", rules.TIMESTAMP_BOX),) if assembled else (("warn", "missing_glossary_meta", rules.GLOSSARY), ("warn", "missing_analogy", rules.ANALOGY))
    lacks = F.array_compact(F.array(*(F.when(~F.coalesce(F.col("text"), F.lit("")).rlike(p), F.struct(F.lit(s).alias("severity"), F.lit(c).alias("category"))) for s, c, p in wanted)))
    return docs.select(key, F.explode(lacks).alias("v")).select(key, F.lit(0).alias("line_no"), "v.severity", "v.category")


def failure_markers(docs: DataFrame, markers: Sequence[tuple[str, str]] = rules.FAILURE_MARKERS, key: str = "doc_id") -> DataFrame:
    """Every marker that a text holds: key, rule_ord, message."""
    hits = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.struct(F.lit(i).alias("rule_ord"), F.lit(m).alias("message"))) for i, (p, m) in enumerate(markers))))
    return docs.select(key, F.explode(hits).alias("hit")).select(key, "hit.rule_ord", "hit.message")


def usable(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts that are there and hold no failure marker."""
    return docs.where("text is not null").join(failure_markers(docs, key=key), key, "left_anti")


def numeric_claims(doc_lines: DataFrame, key: str = "doc_id", least: float = rules.LEAST_CLAIM) -> DataFrame:
    """Amounts of ``least`` or more on lines that cite no outside data: key, line_no, nth, claim, is_in_inference."""
    outside = F.lit(False)
    for word in rules.EXTERNAL_KEYWORDS:
        outside = outside | F.contains("line", F.lit(word))
    # splitting by what comes between the amounts would lose them; extracting twice keeps number and unit together
    numbers, units = F.regexp_extract_all("line", F.lit(rules.CLAIM), F.lit(1)), F.regexp_extract_all("line", F.lit(rules.CLAIM), F.lit(2))
    out = doc_lines.where(~outside).select(key, "line_no", F.contains("line", F.lit(rules.INFERENCE)).alias("is_in_inference"), F.posexplode(F.arrays_zip(numbers.alias("number"), units.alias("unit"))).alias("nth", "found"))
    out = out.withColumn("claim", signed_amount(F.col("found.number"), F.col("found.unit")))
    return out.where(F.abs("claim") >= least).select(key, "line_no", "nth", "claim", "is_in_inference")


def markdown_tables(doc_lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cells of tables in long form: key, table_line, line_no, row_ord (0 is the header), col_ord, cell.

    A table is a stretch of lines between bars of which one is followed by a separator; that one is its header.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    bars = doc_lines.where(F.col("line").rlike("^\\s*\\|.*\\|\\s*$")).withColumn("stretch", F.col("line_no") - F.row_number().over(order))
    separator = F.col("line").rlike("^\\s*\\|[\\s:|-]+\\|\\s*$")
    inside = Window.partitionBy(key, "stretch")
    bars = bars.withColumn("next_is", F.coalesce(F.lead(separator).over(inside.orderBy("line_no")), F.lit(False)))
    bars = bars.withColumn("table_line", F.min(F.when(F.col("next_is"), F.col("line_no"))).over(inside))
    rows = bars.where("line_no = table_line or line_no >= table_line + 2")
    rows = rows.withColumn("row_ord", F.when(F.col("line_no") == F.col("table_line"), 0).otherwise(F.col("line_no") - F.col("table_line") - 1))
    return rows.select(key, "table_line", "line_no", "row_ord", F.posexplode(markdown_cells(F.col("line"))).alias("col_ord", "cell"))


BAR_LINE, SEPARATOR = "^\\s*\\|.*\\|\\s*$", "^\\s*\\|[\\s:|-]+\\|\\s*$"


def tables_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``markdown_tables`` of whole texts (key, text), each read in its own row: without a shuffle or a sort of lines."""
    held = docs.where(F.contains("text", F.lit("|"))).select(key, split_lines(F.col("text")).alias("lines"))
    letter = lambda x: F.when(x.rlike(SEPARATOR), F.lit("s")).when(x.rlike(BAR_LINE), F.lit("b")).otherwise(F.lit("n"))
    kinds = F.array_join(F.transform("lines", letter), "")
    pieces = F.regexp_extract_all(kinds, F.lit("[bs]s[bs]*|[bs]|n+"), F.lit(0))  # a table begins at a stretch's first line before a separator and takes the rest of it
    place = lambda x: F.when(x.rlike("^.s"), F.sequence(F.lit(0), F.char_length(x) - 1)).otherwise(F.array_repeat(F.lit(-1), F.char_length(x)))
    places = F.flatten(F.transform(pieces, place))
    rows = held.select(key, F.posexplode(F.arrays_zip(F.col("lines").alias("line"), places.alias("at"))).alias("pos", "row")).where("row.at = 0 or row.at >= 2")
    line_no = F.col("pos") + 1
    rows = rows.select(key, (line_no - F.col("row.at")).alias("table_line"), line_no.alias("line_no"), F.when(F.col("row.at") == 0, 0).otherwise(F.col("row.at") - 1).alias("row_ord"), F.col("row.line").alias("line"))
    return rows.select(key, "table_line", "line_no", "row_ord", F.posexplode(markdown_cells(F.col("line"))).alias("col_ord", "cell"))


def _holds(text: Column, words: Sequence[str]) -> Column:
    return F.exists(_array_of([w.lower() for w in words]), lambda w: F.contains(F.lower(text), w))


def table_arithmetic(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """Columns whose details don't add up to a total row, and share columns without one that don't add up to 100:
    key, table_line, col_ord, category, actual, expected (null for shares).

    The cells are read once: rows come together, get their table's header and counts, and fall apart into columns. Cells
    that lie by their key already aren't shuffled again.
    """
    table = [key, "table_line"]
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("col_ord", "cell"))), lambda x: x["cell"])
    rows = cells.groupBy(*table, "line_no", "row_ord").agg(in_order.alias("cells"))
    header, detail, total = F.col("row_ord") == 0, (F.col("row_ord") > 0) & ~F.col("is_total"), (F.col("row_ord") > 0) & F.col("is_total")
    whole = Window.partitionBy(*table)
    rows = rows.withColumn("is_total", _holds(F.get("cells", 0), rules.TOTAL_WORDS))
    rows = rows.select("*", F.max(F.when(header, F.col("cells"))).over(whole).alias("header"), F.count_if(detail).over(whole).alias("details"), F.count_if(total).over(whole).alias("totals"))
    body = rows.where("row_ord > 0 and details >= 2").select(*table, "line_no", "header", "details", "totals", "is_total", F.posexplode("cells").alias("col_ord", "cell"))
    body = body.withColumn("header", F.get("header", "col_ord")).where("col_ord > 0 and header is not null").withColumn("value", cell_number(F.col("cell")))
    detail, total = ~F.col("is_total"), F.col("is_total") & F.col("value").isNotNull()
    expected = F.sort_array(F.collect_list(F.when(total, F.struct("line_no", F.col("value").alias("expected")))))
    summed = body.groupBy(*table, "col_ord").agg(
        F.first("header").alias("header"), F.first("details").alias("details"), F.first("totals").alias("totals"), F.sum(F.when(detail, F.col("value"))).alias("actual"),
        F.count(F.when(detail, F.col("value"))).alias("n"), F.count_if(detail & F.contains("cell", F.lit("%"))).alias("pct_cells"), expected.alias("against"),
    ).where("n >= 2")
    not_summable = _holds(F.col("header"), rules.NOT_SUMMABLE_WORDS)
    share = ~not_summable & _holds(F.col("header"), rules.SHARE_WORDS)
    summed = summed.withColumn("is_share", share).withColumn("is_absolute", ~not_summable & ~share & (F.col("pct_cells") <= F.col("details") * 0.2))
    off = (F.col("totals") == 0) & F.col("is_share") & (F.col("n") >= 3) & ((F.col("actual") < 95) | (F.col("actual") > 105))
    tolerance = lambda x: F.when(F.col("is_share"), F.lit(3.0)).otherwise(F.greatest(F.abs(x) * 0.02, F.lit(0.5)))
    mismatch = F.filter("against", lambda x: (F.col("is_share") | F.col("is_absolute")) & (F.abs(F.col("actual") - x["expected"]) > tolerance(x["expected"])))
    told = F.transform(mismatch, lambda x: F.struct(F.lit("table_sum_mismatch").alias("category"), x["expected"].alias("expected")))
    less = F.struct(F.lit("percentage_sum_off").alias("category"), F.lit(None).cast("double").alias("expected"))
    found = summed.select(*table, "col_ord", "actual", F.explode(F.when(off, F.array(less)).otherwise(told)).alias("found"))
    return found.select(*table, "col_ord", "found.category", "actual", "found.expected")


def consistency(doc_lines: DataFrame, authority: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines that cite a fact (key, value_krw, keywords, tolerance_pct) with another amount.

    The first amount that begins within 60 characters from each place of a keyword counts; one of them within the
    tolerance clears the line, else the closest is reported: key, line_no, fact_key, expected, found, deviation_pct.
    Facts are a short list, which is broadcast: else every task of it would make the lines again.
    """
    facts = authority.select(F.col("key").alias("fact_key"), F.col("value_krw").alias("expected"), "tolerance_pct", F.posexplode("keywords").alias("word_ord", "word"))
    held = doc_lines.where(F.col("line").rlike("조|억")).join(F.broadcast(facts), F.contains(F.col("line"), F.col("word")))
    place = F.concat(F.lit("(?s)(?=(\\Q"), F.col("word"), F.lit("\\E.*))"))
    places = held.withColumn("ahead", F.explode(F.regexp_extract_all("line", place, F.lit(1))))
    number, unit = F.regexp_extract("ahead", AMOUNT_AHEAD, 2), F.regexp_extract("ahead", AMOUNT_AHEAD, 3)
    found = places.withColumn("found", F.when(unit != "", absolute_amount(number, unit))).where("found is not null")
    gap = F.abs(F.col("found") - F.col("expected"))
    found = found.withColumn("gap", gap).withColumn("passes", gap <= F.col("expected") * F.col("tolerance_pct"))
    line = Window.partitionBy(key, "line_no", "fact_key")
    closest = line.orderBy("gap", "word_ord", F.desc(F.char_length("ahead")))
    out = found.withColumn("cleared", F.max("passes").over(line)).withColumn("nth", F.row_number().over(closest)).where("not cleared and nth = 1")
    return out.select(key, "line_no", "fact_key", "expected", "found", ((F.col("found") - F.col("expected")) / F.col("expected") * 100).alias("deviation_pct"))


def _places(low: Column, word: str, near: int) -> Column:
    """The places of a word in a text without characters beyond 16 bits, in order: word, nth, window (``near`` characters on
    both sides of its begin) and breaks (line breaks since the place before). Each array is walked once."""
    quoted = f"\\Q{word}\\E"
    around = F.lit(f"(?s)(?={quoted})(?<=(.{{{near}}}|\\A.{{0,{near - 1}}}))(?=(.{{1,{near}}})){quoted}")
    windows = F.zip_with(F.regexp_extract_all(low, around, F.lit(1)), F.regexp_extract_all(low, around, F.lit(2)), lambda a, b: F.concat(a, b))
    breaks = F.transform(F.split(low, quoted, -1), lambda part: F.char_length(part) - F.char_length(F.replace(part, F.lit("\n"), F.lit(""))))
    pairs = F.zip_with(windows, breaks, lambda w, b: F.struct(w.alias("window"), b.alias("breaks")))  # after the last place there is one part more
    numbered = F.transform(pairs, lambda x, nth: F.struct(F.lit(word).alias("word"), nth.alias("nth"), x["window"].alias("window"), x["breaks"].alias("breaks")))
    return F.when(F.contains(low, F.lit(word)), F.filter(numbered, lambda x: x["window"].isNotNull()))


def unknown_and_asserted(docs: DataFrame, words: Sequence[str] = rules.CROSS_CHECK, key: str = "doc_id", near: int = 60) -> DataFrame:
    """Keywords that one place of a text calls unconfirmed and another gives an amount for: key, word.

    Places marked as inference count as neither, and an unconfirmed one about the future doesn't count. A place is told by
    its line, which is read once for all places on it, and by ``near`` characters on both sides of the keyword's begin.
    Keywords are found in any case. Time follows the text's length and the number of places; texts stay in their rows.
    """
    low = F.regexp_replace(F.lower("text"), "[\\x{10000}-\\x{10FFFF}]", "\uFFFD")
    rows = docs.where("text is not null").select(F.col(key).alias("its_key"), F.xxhash64(key, "text").alias("id"), low.alias("low"))
    lowered = {word.lower(): word for word in words}
    each = F.flatten(F.array_compact(F.array(*(_places(F.col("low"), word, near) for word in lowered))))
    places = rows.select("its_key", "id", F.explode(each).alias("place")).select("its_key", "id", "place.*")
    upto = Window.partitionBy("id", "word").orderBy("nth").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    copies = F.sum((F.col("nth") == 0).cast("int")).over(Window.partitionBy("id", "word"))  # a row that comes twice has each place twice
    places = places.withColumn("line_no", (F.sum("breaks").over(upto) / copies).cast("int"))

    holds = F.lit(False)
    for word in lowered:
        holds = holds | F.contains("line", F.lit(word))
    lines = rows.select("id", F.posexplode(F.split("low", "\n", -1)).alias("line_no", "line")).where(holds)
    flags = {"marked": F.contains("line", F.lit(rules.INFERENCE)), "unconfirmed": F.col("line").rlike(rules.NOT_CONFIRMED), "future": F.col("line").rlike(rules.FUTURE), "amount": F.col("line").rlike(rules.ANY_AMOUNT)}
    lines = lines.select("id", "line_no", *(c.alias(name) for name, c in flags.items())).distinct()

    asserted = F.col("amount") | (F.col("window").rlike(rules.ANY_AMOUNT) & ~F.col("window").rlike(rules.NOT_CONFIRMED))
    kind = (
        F.when(F.col("marked"), "none").when(F.col("unconfirmed"), F.when(F.col("future"), "none").otherwise("unknown"))
        .when(F.contains("window", F.lit(rules.INFERENCE)), "none").when(asserted, "asserted").otherwise("none")
    )
    found = places.join(lines, ["id", "line_no"]).withColumn("kind", kind)
    per = found.groupBy("its_key", "word").agg(F.bool_or(F.col("kind") == "unknown").alias("unknown"), F.bool_or(F.col("kind") == "asserted").alias("asserted"))
    as_given = F.element_at(F.create_map(*(F.lit(x) for pair in lowered.items() for x in pair)), F.col("word"))
    return per.where("unknown and asserted").select(F.col("its_key").alias(key), as_given.alias("word"))


def input_guard(filings: DataFrame, facts: DataFrame, key: str = "doc_id", least_chars: int = 5000, least_facts: int = 100) -> DataFrame:
    """Per key: files, loaded characters, facts and whether they are enough."""
    texts = filings.groupBy(key).agg(F.count("*").alias("files"), F.sum("loaded_chars").alias("loaded_chars"))
    counts = facts.groupBy(key).agg(F.count("*").alias("facts"))
    out = texts.join(counts, key, "full").na.fill(0, ["files", "loaded_chars", "facts"])
    return out.withColumn("passed", (F.col("files") > 0) & (F.col("loaded_chars") >= least_chars) & (F.col("facts") >= least_facts))


def secrets(doc_lines: DataFrame, patterns: Sequence[tuple[str, str]] = rules.SECRETS, key: str = "doc_id") -> DataFrame:
    """Every match of every rule on every line without a placeholder: key, line_no, label, nth, snippet."""
    placeholder = F.contains("line", F.lit("PUT_YOUR")) | F.contains("line", F.lit("REPLACE_WITH")) | F.contains(F.upper("line"), F.lit("EXAMPLE"))

    def matches(label: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(0)), lambda _, i: F.struct(F.lit(label).alias("label"), i.alias("nth")))

    hits = F.flatten(F.array(*(matches(label, p) for label, p in patterns)))
    held = doc_lines.where(F.col("line").rlike("|".join(f"(?:{p})" for _, p in patterns)) & ~placeholder)  # most lines hold none
    found = held.select(key, "line_no", F.left(trimmed(F.col("line")), F.lit(120)).alias("snippet"), F.explode(hits).alias("hit"))
    return found.select(key, "line_no", "hit.label", "hit.nth", "snippet")


def scanned_files(files: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """Files (path) to scan: not of a binary suffix, not ending with an allowed path."""
    keep = ~F.lower("path").rlike("(" + "|".join(s.replace(".", "\\.") for s in rules.BINARY_SUFFIXES) + ")$")
    for path in allowed:
        keep = keep & ~F.endswith("path", F.lit(path))
    return files.where(keep)


def chosen_attempt(attempts: DataFrame, key: str = "section") -> DataFrame:
    """Each key's first attempt that passed, else its last, which then is best_effort."""
    order = Window.partitionBy(key).orderBy(F.desc(F.col("passed").cast("int")), F.when(F.col("passed"), F.col("attempt")).otherwise(-F.col("attempt")))
    return attempts.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth").withColumn("best_effort", ~F.col("passed"))


def sections_of(texts: DataFrame, aliases: Sequence[tuple[str, Sequence[str]]] = rules.SECTION_ALIASES, key: str = "doc_id", window: int = 12000) -> DataFrame:
    """Each text's sections by the first of their aliases (section, aliases in order) that it holds: key, section_key,
    alias, body. Found and cut inside the text's own row."""
    from ..functions.text import section_slice

    first = {f"alias_{i}": F.coalesce(*(F.when(F.contains("text", F.lit(alias)), F.lit(alias)) for alias in names)) for i, (_, names) in enumerate(aliases)}
    held = texts.select(key, "text", *(c.alias(name) for name, c in first.items()))
    section = lambda name, at: F.when(F.col(at).isNotNull(), F.struct(F.lit(name).alias("section_key"), F.col(at).alias("alias"), section_slice(F.col("text"), F.col(at), window).alias("body")))
    found = F.array_compact(F.array(*(section(name, f"alias_{i}") for i, (name, _) in enumerate(aliases))))
    return held.select(key, F.explode(found).alias("section")).select(key, "section.*")
