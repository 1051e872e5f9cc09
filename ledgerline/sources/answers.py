"""Readers of the filing service's JSON answers: a status, a page number and a list of items, whose values are texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The items' fields, and the status of an answer that holds what was asked for.
FILING = "corp_code string, corp_name string, stock_code string, report_nm string, rcept_no string, flr_nm string, rcept_dt string, rm string"
SHARES = "rcept_no string, corp_code string, se string, istc_totqy string, tesstk_co string, distb_stock_co string"
HOLDER = "rcept_no string, rcept_dt string, corp_code string, repror string, repror_nm_cd_nm string, stkrt string"
STATEMENT = "rcept_no string, bsns_year string, corp_code string, sj_div string, account_id string, account_nm string, thstrm_amount string, frmtrm_amount string, currency string"
DONE = "000"


def answers(docs: DataFrame, item: str, column: str = "text") -> DataFrame:
    """docs with the parsed answer in place of its text: status, message, page_no, list and, where the text is no JSON,
    the reason "no JSON"; else the reason is null for an answer with items and the status for a refused one. A missing
    status counts as done, a null text as no JSON. item: the fields of the list's items, as DDL."""
    schema = f"status string, message string, page_no string, list array<struct<{item}>>, _broken string"
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    out = docs.withColumn("_answer", parsed).drop(column)
    status = F.col("_answer.status")
    reason = F.when(F.col("_answer").isNull() | F.col("_answer._broken").isNotNull(), "no JSON").when(status != DONE, F.concat_ws(" ", status, "_answer.message"))
    keep = [F.col(f"`{c}`") for c in docs.columns if c != column]
    return out.select(*keep, reason.alias("reason"), status.alias("status"), "_answer.message", F.col("_answer.page_no").try_cast("int").alias("page_no"), "_answer.list")


def items(found: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """The items of all good answers (the columns keep, page_no, nth from 0 and the item's fields), and the answers
    without (keep, reason). A union of pages is this over the pages' answers: page_no and nth give the listed order."""
    good = found.where("reason is null").select(*keep, "page_no", F.posexplode("list").alias("nth", "_item"))
    fields = [F.col(f"_item.`{f.name}`").alias(f.name) for f in found.schema["list"].dataType.elementType.fields if f.name not in keep]
    return good.select(*keep, "page_no", "nth", *fields), found.where("reason is not null").select(*keep, "reason")


CONSOLIDATED, SEPARATE = "CFS", "OFS"


def statements(docs: DataFrame, fs_div: str = CONSOLIDATED, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """The accounts of the answers about consolidated (CFS) or separate (OFS) statements, of requests with their fs_div: the
    other columns of docs, page_no, nth and the items' fields; and the requests that have none, with the reason. A
    refused request has no accounts; it isn't made up for by the other kind."""
    if fs_div not in (CONSOLIDATED, SEPARATE):
        raise ValueError(f"fs_div is {CONSOLIDATED} or {SEPARATE}, not {fs_div}")
    keep = [c for c in docs.columns if c not in (column, "fs_div")]
    return items(answers(docs.where(F.col("fs_div") == fs_div).drop("fs_div"), STATEMENT, column), *keep)


def holder_columns() -> list[Column]:
    """An item of HOLDER as ``operators.holdings`` takes it: holder and holding_pct (null if it isn't a number)."""
    return [F.col("repror").alias("holder"), F.col("stkrt").try_cast("double").alias("holding_pct"), "rcept_dt"]
