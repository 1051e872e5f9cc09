"""Data sources of filing lists as the filing service answers them, one page at a time.

``filing_pages`` reads a folder of answers: .../corp_code=X/pblntf_ty=T/bgn_de=YYYYMMDD/end_de=YYYYMMDD/page_no=N/ holds
the answer to one page of one request. A read is planned as pages; filters on corp_code and pblntf_ty choose the
folders that are listed at all, filters on rcept_dt those whose days they meet. ``filing_polls`` streams a folder of
answers in the order of their polls: .../poll=N/. Answers that hold no filings come as a row with the reason.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import sinks
from .answers import DONE, FILING
from .folders import as_uri

ITEM = [field.split(" ")[0] for field in FILING.split(", ")]
PAGE = "corp_code string, pblntf_ty string, page_no int, nth int, corp_name string, stock_code string, report_nm string, rcept_no string, flr_nm string, rcept_dt string, rm string, reason string"
POLL = "poll long, polled_at timestamp, nth int, " + FILING + ", reason string"
FILTER_CONF = "spark.sql.python.filterPushdown.enabled"
ATTEMPTS = 3
NULL = "__HIVE_DEFAULT_PARTITION__"
REQUEST = ("corp_code", "pblntf_ty", "bgn_de", "end_de", "page_no")  # the levels of folders


def _value(name: str) -> str | None:
    value = unquote(name.partition("=")[2])
    return None if value == NULL else value


def _read(files: fs.FileSystem, folder: str) -> str:
    """The text of the files in a folder, end to end; read again when the store fails."""
    for attempt in range(ATTEMPTS):
        try:
            out = []
            for info in sorted(files.get_file_info(fs.FileSelector(folder)), key=lambda x: x.base_name):
                if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
                    with files.open_input_file(info.path) as file:
                        out.append(file.read().decode("utf-8", "replace"))
            return "".join(out)
        except OSError:
            if attempt == ATTEMPTS - 1:
                raise
            time.sleep(0.2 * 4**attempt)
    raise AssertionError


def parsed(text: str) -> tuple[list[dict], int | None, str | None]:
    """The items of an answer, how many pages its request has, and why there are no items. A missing status is done."""
    try:
        answer = json.loads(text)
    except ValueError:
        return [], None, "no JSON"
    if not isinstance(answer, dict):
        return [], None, "no JSON"
    if answer.get("status") not in (DONE, None):
        return [], None, f"{answer['status']} {answer.get('message') or ''}".strip()
    total = answer.get("total_page")
    return [x for x in answer.get("list") or [] if isinstance(x, dict)], int(total) if str(total).isdigit() else None, None


def _text(value) -> str | None:
    return None if value is None else str(value)


@dataclass
class Page:
    folder: str
    corp_code: str | None
    kind: str | None
    number: int
    before: int  #: the listed page before this one, 0 for the first
    last: bool  #: no page after this one is listed


@dataclass
class Pages(InputPartition):
    pages: tuple[Page, ...]


class PageReader(DataSourceReader):
    def __init__(self, path: str, pages: int):
        self.path, self.pages = path, pages
        self.allowed: dict[str, set] = {}
        self.begin, self.end = "", "99999999"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in ("corp_code", "pblntf_ty") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.allowed[name] = self.allowed.get(name, values) & values
                continue  # whole folders: nothing is left to check
            if name == "rcept_dt":
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.begin = max(self.begin, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.end = min(self.end, f.value)
            yield f

    def _wanted(self, level: str, value: str | None) -> bool:
        if level in self.allowed:
            return value is not None and value in self.allowed[level]
        if level == "bgn_de":
            return value is None or value <= self.end
        if level == "end_de":
            return value is None or value >= self.begin
        return True

    def listed(self) -> list[Page]:
        """The pages of all requests that the filters let through, level by level: folders beside them aren't listed."""
        files, root = fs.FileSystem.from_uri(self.path)
        found = [(root, ())]
        for level in REQUEST:
            deeper = []
            for folder, values in found:
                names = [x for x in files.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.Directory and x.base_name.startswith(level + "=")]
                deeper += [(x.path, (*values, _value(x.base_name))) for x in names if self._wanted(level, _value(x.base_name))]
            found = deeper
        out, by_request = [], {}
        for folder, (*request, number) in found:
            by_request.setdefault(tuple(request), []).append((int(number), folder))
        for (corp, kind, *_), pages in sorted(by_request.items(), key=repr):
            before = 0
            for k, (number, folder) in enumerate(sorted(pages)):
                out.append(Page(folder, corp, kind, number, before, k == len(pages) - 1))
                before = number
        return out

    def partitions(self) -> Sequence[Pages]:
        pages = self.listed()
        return [Pages(tuple(pages[i : i + self.pages])) for i in range(0, len(pages), self.pages)] or [Pages(())]

    def read(self, partition: Pages) -> Iterator[tuple]:
        files, _ = fs.FileSystem.from_uri(self.path)
        for page in partition.pages:
            head = page.corp_code, page.kind, page.number
            nothing = [None] * (len(ITEM) - 1)
            if page.number > page.before + 1:
                yield (*head, None, *nothing, f"pages {page.before + 1} to {page.number - 1} are missing")
            items, total, reason = parsed(_read(files, page.folder))
            for nth, item in enumerate(items):
                yield (*head, nth, *(_text(item.get(name)) for name in ITEM if name != "corp_code"), None)
            if reason:
                yield (*head, None, *nothing, reason)
            elif page.last and total is not None and total > page.number:
                yield (*head, None, *nothing, f"pages {page.number + 1} to {total} are missing")


class FilingPages(DataSource):
    """Options: path (a folder, as a URI), pages (of a partition, 1 by default)."""

    @classmethod
    def name(cls) -> str:
        return "filing_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"], int(self.options.get("pages", 1)))


def filing_pages(spark: SparkSession, path: str, pages: int = 1) -> DataFrame:
    """The filings of all stored answers under ``path``: PAGE's columns, the corp of a row being that of its request.
    Rows with a reason stand for answers without filings (refused, no JSON) and for pages that a request has and
    the folder hasn't. ``pages`` are read by one task. Lets Spark push filters into Python data sources."""
    spark.conf.set(FILTER_CONF, "true")
    spark.dataSource.register(FilingPages)
    return spark.read.format("filing_pages").option("path", as_uri(path)).option("pages", pages).load()


def store_pages(filings: DataFrame, path: str, page_count: int = 100) -> None:
    """Writes filings (FILING's columns and pblntf_ty, bgn_de, end_de) as the answers that the service would give: newest
    first, ``page_count`` on a page."""
    request = ["corp_code", "pblntf_ty", "bgn_de", "end_de"]
    newest = Window.partitionBy(*request).orderBy(F.desc("rcept_dt"), F.desc("rcept_no"))
    size = F.count("*").over(Window.partitionBy(*request))
    rows = filings.withColumn("nth", F.row_number().over(newest) - 1).withColumn("total_count", size)
    rows = rows.withColumn("page_no", (F.floor(F.col("nth") / page_count) + 1).cast("int")).withColumn("total_page", F.ceil(F.col("total_count") / page_count).cast("int"))
    item = F.struct("nth", F.struct(*ITEM).alias("item"))
    answers = rows.groupBy(*request, "page_no", "total_page").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"]).alias("list"))
    text = F.to_json(F.struct(F.lit(DONE).alias("status"), "page_no", F.lit(page_count).alias("page_count"), "total_page", "list"))
    levels = (F.concat(F.lit(f"{level}="), F.coalesce(F.nullif(F.url_encode(F.col(level).cast("string")), F.lit("")), F.lit(NULL))) for level in REQUEST)
    sinks.write_files(answers.select(F.concat_ws("/", *levels, F.lit("answer.json")).alias("name"), text.alias("text")), path)


@dataclass
class Poll(InputPartition):
    number: int
    folder: str


class PollReader(DataSourceStreamReader):
    """Offsets are poll numbers; each poll is one partition, read by its task and read again when a batch is replayed."""

    def __init__(self, path: str):
        self.path = path

    def _polls(self) -> dict[int, fs.FileInfo]:
        files, root = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return {int(x.base_name[5:]): x for x in found if x.type == fs.FileType.Directory and x.base_name.startswith("poll=") and x.base_name[5:].isdigit()}

    def initialOffset(self) -> dict:
        return {"poll": -1}

    def latestOffset(self) -> dict:
        return {"poll": max(self._polls(), default=-1)}

    def partitions(self, start: dict, end: dict) -> Sequence[Poll]:
        return [Poll(n, x.path) for n, x in sorted(self._polls().items()) if start["poll"] < n <= end["poll"]]

    def read(self, partition: Poll) -> Iterator[tuple]:
        files, _ = fs.FileSystem.from_uri(self.path)
        polled_at = files.get_file_info(partition.folder).mtime
        items, _, reason = parsed(_read(files, partition.folder))
        for nth, item in enumerate(items):
            yield (partition.number, polled_at, nth, *(_text(item.get(name)) for name in ITEM), None)
        if reason:
            yield (partition.number, polled_at, None, *[None] * len(ITEM), reason)


class FilingPolls(DataSource):
    """Options: path (a folder, as a URI)."""

    @classmethod
    def name(cls) -> str:
        return "filing_polls"

    def schema(self) -> str:
        return POLL

    def streamReader(self, schema) -> PollReader:
        return PollReader(self.options["path"])


def filing_polls(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the filings of all polls under ``path``, in the order of the polls' numbers. The same filing comes
    with each poll that lists it (``streaming.feeds.new_filings`` keeps one); refused answers come as a reason."""
    spark.dataSource.register(FilingPolls)
    return spark.readStream.format("filing_polls").option("path", as_uri(path)).load()
