"""Archives of filings: the members of ZIP files, one row each."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folders import as_uri

SIGNATURE = b"PK"
BATCH_BYTES = 4 << 20
MOST_BYTES = 1 << 30  # of a member: a row holds no more
MEMBER = "path string, member string, nth int, n_bytes long, content binary, reason string"
_MEMBER = pa.schema([("path", pa.string()), ("member", pa.string()), ("nth", pa.int32()), ("n_bytes", pa.int64()), ("content", pa.binary()), ("reason", pa.string())])


def member_name(name: str) -> str:
    """Names of Korean archives come as code page 437 of EUC-KR bytes; others are right as they are."""
    try:
        return name.encode("cp437").decode("euc-kr")
    except UnicodeError:
        return name


def _members(path: str, content: bytes | None, no_archive: str) -> Iterator[tuple]:
    if content is None or not content.startswith(SIGNATURE):
        yield path, None, None, None, None, no_archive
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError) as e:
        yield path, None, None, None, None, f"broken ZIP: {e}"
        return
    nth = 0
    for info in archive.infolist():
        if info.is_dir():
            continue
        row = path, member_name(info.filename), nth, info.file_size
        nth += 1
        if info.file_size > MOST_BYTES:
            yield *row, None, f"over {MOST_BYTES} bytes"
            continue
        try:
            yield *row, archive.read(info), None
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, ValueError) as e:  # this member only
            yield *row, None, f"broken member: {e}"


def _batches(batches: Iterator[pa.RecordBatch], no_archive: str) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            for row in _members(batch.column("path")[k].as_py(), batch.column("content")[k].as_py(), no_archive):
                rows.append(row)
                size += len(row[4] or b"")
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MEMBER, strict=True)], schema=_MEMBER)
                    rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MEMBER, strict=True)], schema=_MEMBER)


def members(files: DataFrame, no_archive: str = "not ZIP") -> DataFrame:
    """The members of archives (path and content, as the binaryFile reader gives them): path, member (its name), nth
    (from 0), n_bytes, content and reason. What is no archive, or a broken one, is one row with the reason; a member that
    can't be read has its reason and no content, and the others come all the same. Folders are left out, an archive
    without members gives no row. One member is unpacked at a time."""
    return files.select("path", "content").mapInArrow(partial(_batches, no_archive=no_archive), MEMBER)


def _readable(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    files = found.where("reason is null").select(F.concat_ws("!", "path", "member").alias("path"), "content")
    return files, found.where("reason is not null").select("path", "member", "reason")


def document_files(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files in archives of filings as ``markup.filing_texts`` takes them (path!member, content), and what couldn't be read."""
    return _readable(members(archives))


def xbrl_files(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for XBRL packages, as ``markup.xbrl_elements`` takes them: schemas are left out, and an answer that is no
    archive says that the filing has no XBRL."""
    files, lost = _readable(members(archives, "no XBRL"))
    return files.where(F.col("path").rlike("(?i)\\.(xbrl|xml)$")), lost


CORP_CODES = "CORPCODE.xml"


def corp_code_rows(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """corp_code, corp_name, stock_code, modify_date and ord of the list in each archive of corp codes (for
    ``tables.last_codes``), and the archives without it."""
    found = members(archives)
    one = found.where((F.col("member") == CORP_CODES) & F.col("reason").isNull())
    company = "corp_code string, corp_name string, stock_code string, modify_date string"
    parsed = F.from_xml(F.decode("content", "UTF-8"), f"list array<struct<{company.replace(' ', ': ').replace(',: ', ', ')}>>")
    rows = one.select("path", F.posexplode(parsed["list"]).alias("ord", "company")).select("path", "ord", "company.*")
    status = found.groupBy("path").agg(F.count_if((F.col("member") == CORP_CODES) & F.col("reason").isNull()).alias("n"), F.min("reason").alias("reason"))
    return rows, status.where("n = 0").select("path", F.coalesce("reason", F.lit(f"no {CORP_CODES}")).alias("reason"))


def _pack(key: tuple, table: pa.Table, folder: str) -> pa.Table:
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    out = io.BytesIO()
    table = table.sort_by("name")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in zip(table.column("name").to_pylist(), table.column("content").to_pylist(), strict=True):
            archive.writestr(zipfile.ZipInfo(name), content or b"", zipfile.ZIP_DEFLATED)
    place = f"{root}/{key[0].as_py()}.zip"
    with files.open_output_stream(place) as sink:  # a task that runs twice writes the same bytes
        sink.write(out.getvalue())
    return pa.table({"path": [place], "n_bytes": [len(out.getvalue())]})


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes one ZIP for each value of archive (rows: archive, name, content) into ``folder``, whole members in one task:
    archives are to be of some megabytes. path and n_bytes of each; nothing is written before an action on that."""
    place = as_uri(folder)

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _pack(key, table, place)

    return rows.withColumn("archive", F.col("archive").cast("string")).groupBy("archive").applyInArrow(pack, "path string, n_bytes long")
