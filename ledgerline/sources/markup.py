"""Parsers that Spark's expressions can't express: markup, XBRL and scraped tables, over Arrow batches of files."""

from __future__ import annotations

import html
import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import lenient_int, lenient_pct

# The tags that end a line and those that begin a cell, the namespaces of XBRL and their prefixes.
LINE_TAGS = frozenset(("br", "p", "table", "tr", "section", "title"))
CELL_TAGS = frozenset(("td", "th", "tu"))
INSTANCE, DIMENSIONS = "http://www.xbrl.org/2003/instance", "http://xbrl.org/2006/xbrldi"
LINKBASE, XLINK = "http://www.xbrl.org/2003/linkbase", "http://www.w3.org/1999/xlink"
LANGUAGE = "{http://www.w3.org/XML/1998/namespace}lang"
PREFIXES = {
    "http://xbrl.ifrs.org/taxonomy/2021-03-24/ifrs-full": "ifrs-full",
    "http://www.xbrl.org/2003/instance": "xbrli",
    "http://xbrl.org/2006/xbrldi": "xbrldi",
    "http://www.xbrl.org/2003/linkbase": "link",
    "http://www.xbrl.org/2003/iso4217": "iso4217",
    "http://www.xbrl.org/2003/XLink": "xl",
    "http://www.w3.org/1999/xlink": "xlink",
    "http://www.xbrl.org/dtr/type/numeric": "num",
    "http://www.xbrl.org/dtr/type/non-numeric": "nonnum",
}


# a comment; a raw element with its text; a tag, whose quoted attributes may hold a > (with an odd quote it ends at the
# first one); a declaration. No two ways through the same text, so that broken markup takes linear time.
MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>(?P<raw>.*?)(?:</\1\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/<>\"']*+)(?:(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+>|[^<>]*+>)|<[!?][^<>]*>",
    re.DOTALL | re.IGNORECASE,
)


def markup_text(page: str) -> str:
    """The text of markup: a bar before each cell, blocks and cells on lines of their own, white space as one space;
    comments and declarations go; the markup itself if there is no text."""
    lines: list[list[str]] = [[]]
    at = 0
    for mark in MARK.finditer(page):
        lines[-1] += html.unescape(page[at : mark.start()]).split()
        at, tag = mark.end(), (mark["tag"] or "").lower()
        if mark["raw"]:
            lines[-1] += mark["raw"].split()
        elif tag in CELL_TAGS and not mark["end"]:
            lines[-1].append("|")
        elif tag in LINE_TAGS or tag in CELL_TAGS:
            lines.append([])
    lines[-1] += html.unescape(page[at:]).split()
    return "\n".join(" ".join(words) for words in lines if words) or page


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = pa.array([None if x is None else markup_text(x) for x in batch.column(column).to_pylist()], pa.string())
        yield batch.append_column("markup_text", out)


def with_markup_text(docs: DataFrame, column: str) -> DataFrame:
    """Adds markup_text; a null stays null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lambda it: _texts(it, column), f"{schema}, markup_text string")


MARKUP_SUFFIX = "(?i)\\.(html|htm|xhtml|xml)$"
TEXT_SUFFIX = "(?i)\\.(txt|md)$"


def filing_texts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, content) as texts by their suffix, and those that are skipped, with the reason: pdf (which needs an
    outside converter) or unknown suffix. Bytes that aren't UTF-8 are replaced."""
    decoded = files.withColumn("text", F.decode("content", "UTF-8"))
    plain = decoded.where(F.col("path").rlike(TEXT_SUFFIX)).select("path", "text")
    marked = with_markup_text(decoded.where(F.col("path").rlike(MARKUP_SUFFIX)).select("path", "text"), "text").select("path", F.col("markup_text").alias("text"))
    known = F.col("path").rlike(MARKUP_SUFFIX) | F.col("path").rlike(TEXT_SUFFIX)
    return plain.unionByName(marked).withColumn("n_chars", F.char_length("text")), files.where(~known).select("path", F.when(F.lower("path").endswith(".pdf"), "pdf").otherwise("unknown suffix").alias("reason"))


def prefix_of(namespace: str) -> str:
    if namespace in PREFIXES:
        return PREFIXES[namespace]
    if namespace.startswith("http://dart.fss.or.kr/taxonomy/"):
        for part, prefix in (("/ifrs/dart-gcd", "dart-gcd"), ("/ifrs/dart", "dart"), ("/entity", "entity")):
            if part in namespace:
                return prefix
    return "rol_dart" if namespace.startswith("http://dart.fss.or.kr/role/") else namespace


def _split_tag(tag: str) -> tuple[str, str]:
    m = re.fullmatch(r"(?:\{(.*)\})?(.*)", tag)
    return m[1] or "", m[2]


def _own_text(element: ET.Element | None) -> str | None:
    return None if element is None else (element.text or "").strip()


KINDS = "kind string, path string, ord long, id string, ref string, name string, value string, unit string, decimals string, period_type string, period_start string, period_end string, dimensions array<struct<axis:string,member:string>>"


def _instance_row(e: ET.Element) -> dict | None:
    """A context, unit or fact that stands right below the root."""
    namespace, local = _split_tag(e.tag)
    if namespace == INSTANCE and local == "context" and (period := e.find(f"{{{INSTANCE}}}period")) is not None:
        instant = period.find(f"{{{INSTANCE}}}instant")
        found = {"period_type": "instant", "period_end": _own_text(instant)} if instant is not None else {
            "period_type": "duration", "period_start": _own_text(period.find(f"{{{INSTANCE}}}startDate")), "period_end": _own_text(period.find(f"{{{INSTANCE}}}endDate")),
        }
        members = e.findall(f"{{{INSTANCE}}}entity/{{{INSTANCE}}}segment/{{{DIMENSIONS}}}explicitMember")
        dims = [{"axis": m.get("dimension"), "member": _own_text(m)} for m in members if m.get("dimension")]
        return found | {"kind": "context", "id": e.get("id") or "", "dimensions": dims}
    if namespace == INSTANCE and local == "unit":
        return {"kind": "unit", "id": e.get("id") or "", "value": _own_text(e.find(f"{{{INSTANCE}}}measure"))}
    if namespace not in (INSTANCE, LINKBASE) and e.get("contextRef") and (text := _own_text(e)):
        prefix = prefix_of(namespace)
        return {"kind": "fact", "ref": e.get("contextRef"), "name": f"{prefix}:{local}" if prefix else local, "value": text, "unit": e.get("unitRef"), "decimals": e.get("decimals")}
    return None


def _linkbase_row(e: ET.Element) -> dict | None:
    """A locator, arc or label, wherever it stands."""
    namespace, local = _split_tag(e.tag)
    if namespace != LINKBASE or local not in ("loc", "label", "labelArc"):
        return None
    at = lambda name: e.get(f"{{{XLINK}}}{name}") or ""
    if local == "loc":
        return {"kind": local, "id": at("label"), "name": at("href").partition("#")[2]}
    if local == "labelArc":
        return {"kind": local, "id": at("from"), "ref": at("to")}
    text = _own_text(e)
    return {"kind": local, "id": at("label"), "name": at("role"), "unit": e.get(LANGUAGE) or "", "value": text} if text else None


def _xbrl_rows(path: str, content: bytes) -> Iterator[dict]:
    """Elements as they end; what has been read is let go: below the root at its end, inside a linkbase at once. ord is
    an instance element's place below the root and a linkbase element's place in the whole file."""
    parents: list[tuple[ET.Element, int]] = []  # with their places in the file
    seen = below_root = 0
    for event, e in ET.iterparse(io.BytesIO(content), ("start", "end")):
        if event == "start":
            parents.append((e, seen))
            seen += 1
            continue
        _, place = parents.pop()
        if len(parents) == 1:
            if row := _instance_row(e):
                yield {"path": path, "ord": below_root} | row
            below_root += 1
        row = _linkbase_row(e)
        if row:
            yield {"path": path, "ord": place} | row
        if len(parents) == 1 or (parents and _split_tag(e.tag)[0] == LINKBASE):
            e.clear()
            parents[-1][0].remove(e)


BATCH_ROWS = 10_000


def _xbrl(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    members = pa.list_(pa.struct([("axis", pa.string()), ("member", pa.string())]))
    fields = [(c.split(" ")[0], pa.int64() if c.endswith("long") else members if c.startswith("dimensions") else pa.string()) for c in re.split(r", (?![^<]*>)", KINDS)]
    files = ((p.as_py(), c.as_py()) for batch in batches for p, c in zip(batch.column("path"), batch.column("content"), strict=True))
    rows = (row for path, content in files for row in _xbrl_rows(path, content))
    while some := list(islice(rows, BATCH_ROWS)):  # of many small files or a part of a large one
        yield pa.RecordBatch.from_pylist(some, pa.schema(fields))


def xbrl_elements(files: DataFrame) -> DataFrame:
    """Contexts, units, facts, locators, arcs and labels of XBRL files (path, content), one row each."""
    return files.select("path", "content").mapInArrow(_xbrl, KINDS)


def xbrl_facts(elements: DataFrame) -> DataFrame:
    """Numeric facts with their contexts; other texts are left out. A fact's context is its file's first one of that id by
    the period's end; files are parsed once, facts and contexts meet in one shuffle."""
    from ..functions.numbers import fact_decimals

    held = elements.where("kind in ('context', 'fact')").withColumn("context_id", F.when(F.col("kind") == "context", F.col("id")).otherwise(F.col("ref")))
    context = F.when(F.col("kind") == "context", F.struct("period_type", "period_start", "period_end", "dimensions"))
    first = Window.partitionBy("path", "context_id").orderBy(F.col("kind") != "context", "period_end").rowsBetween(Window.unboundedPreceding, 0)
    facts = held.withColumn("context", F.first(context).over(first)).where("kind = 'fact' and value is not null")
    number = F.when(F.col("value").rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.col("value").try_cast("double"))
    none = F.array().cast("array<struct<axis:string,member:string>>")
    out = facts.select(
        "context_id", "path", "ord", F.col("name").alias("concept"), number.alias("value"), F.col("value").alias("raw_value"), F.col("unit").alias("unit_id"), fact_decimals(F.col("decimals")).alias("decimals"),
        F.coalesce("context.period_type", F.lit("?")).alias("period_type"), "context.period_start", "context.period_end", F.coalesce("context.dimensions", none).alias("dimensions"),
    )
    return out.where("value is not null")


def xbrl_labels(elements: DataFrame) -> DataFrame:
    """concept_id and Korean label; later files and arcs win."""
    from ..operators.facts import labels_of

    key = lambda c: F.concat_ws("\n", "path", c)
    found = elements.withColumn("ord", F.struct("path", "ord"))
    locators = found.where("kind = 'loc' and name != '' and id != ''").select(key("id").alias("loc"), F.col("name").alias("concept_id"))
    arcs = found.where("kind = 'labelArc' and id != '' and ref != ''").select("ord", key("id").alias("loc"), key("ref").alias("res"))
    labels = found.where("kind = 'label' and id != ''").select("ord", key("id").alias("res"), F.col("unit").alias("lang"), F.col("name").alias("role"), F.col("value").alias("text"))
    return labels_of(locators, arcs, labels)


ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")


@lru_cache(4096)
def _of_type2(tag: str) -> bool:
    """Whether a tag's text has the class type2."""
    classes = [next((v for v in m.groups()[1:] if v is not None), "") for m in islice(ATTRIBUTE.finditer(tag[1:]), 1, None) if m[1].lower() == "class"]
    return bool(classes) and "type2" in html.unescape(classes[-1]).split()


def _cells(page: str) -> list[list[str]]:
    """The cells of the rows of tables of class type2: the pieces of text between a cell's marks, each without white space at
    its ends."""
    rows: list[list[str]] = []
    depth, cell, at = 0, False, 0
    for mark in chain(MARK.finditer(page), (None,)):
        if depth and cell and rows and rows[-1]:
            rows[-1][-1] += html.unescape(page[at : mark.start() if mark else len(page)]).strip()
            if mark and mark["raw"]:
                rows[-1][-1] += mark["raw"].strip()
        if not mark:
            return rows
        at, tag = mark.end(), (mark["tag"] or "").lower()
        closed = mark["end"] or page[at - 2] == "/"
        if tag == "table":
            if not mark["end"]:
                depth = depth + 1 if depth or _of_type2(mark[0]) else 0
            if closed:
                depth = max(0, depth - 1)
        elif tag == "tr" and depth and not mark["end"]:
            rows.append([])
        elif tag == "td":
            if depth and rows and not mark["end"]:
                rows[-1].append("")
                cell = True
            if closed:
                cell = False
    return rows


def _scraped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(t, p, i, c) for t, p, h in zip(*(batch.column(x).to_pylist() for x in ("ticker", "page", "html")), strict=True) for i, c in enumerate(_cells(h or ""))]
        t, p, i, c = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(p, pa.int64()), pa.array(i, pa.int64()), pa.array(c, pa.list_(pa.string()))], ["ticker", "page", "pos", "cells"])


def scraped_flows(pages: DataFrame) -> DataFrame:
    """Daily flows of scraped pages (ticker, page, html): rows of nine cells or more whose first is a date with dots.
    Cells that aren't numbers are 0; the net amount is net shares times close."""
    rows = pages.select("ticker", F.col("page").cast("long").alias("page"), "html").mapInArrow(_scraped, "ticker string, page long, pos long, cells array<string>")
    at = lambda i: F.replace(F.get("cells", i), F.lit(" "), F.lit(""))
    rows = rows.where((F.size("cells") >= 9) & F.contains(F.get("cells", 0), F.lit(".")))
    close, shares = lenient_int(at(1)), lenient_int(at(6))
    return rows.select(
        "ticker", "page", "pos", F.to_date(F.replace(F.get("cells", 0), F.lit("."), F.lit("-"))).alias("dt"), close.alias("close"), lenient_pct(at(3)).alias("pct_change"), lenient_int(at(4)).alias("volume"),
        (shares * close).alias("net_krw"), F.lit("naver").alias("source"), shares.alias("foreign_net_shares"), lenient_int(at(7)).alias("holding_shares"), lenient_pct(at(8)).alias("holding_pct"),
    )


def title_of(page: Column) -> Column:
    return F.regexp_extract(page, "(?is)<title[^>]*>(.*?)</title>", 1)
