"""Filings: interim and periodic reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.dates import compact_date, days_after, holds_any, period_end


def interim_filings(filings: DataFrame, annual: str, window_days: int = 400) -> DataFrame:
    """Interim filings (rcept_dt as yyyyMMdd) from the day after the annual report (yyyyMMdd) on, newest first in nth,
    with the period they are about and the days since the annual report."""
    day, start = compact_date(F.col("rcept_dt")), compact_date(F.lit(annual))
    found = filings.where(holds_any(F.col("report_nm"), rules.INTERIM_KEYWORDS) & (day > start) & (day <= F.date_add(start, window_days)))
    newest = Window.partitionBy("corp_code").orderBy(F.desc("rcept_dt"), "ord")
    return found.select("*", days_after(day, start).alias("days_after_annual"), period_end(F.col("report_nm"), day).alias("likely_period_end"), F.row_number().over(newest).alias("nth"))


def periodic_reports(filings: DataFrame, year: int, code: str) -> DataFrame:
    """Reports of a business year and code (11011 annual, 11012 half-year, 11013 and 11014 quarters): original and
    amended ones, newest first in nth. Only quarters are told by the month in their name."""
    name = F.col("report_nm")
    kinds = {
        "11011": F.contains(name, F.lit("사업보고서")),
        "11012": F.contains(name, F.lit("반기보고서")),
        "11013": F.contains(name, F.lit("분기보고서")) & F.contains(name, F.lit(f"({year}.03)")),
        "11014": F.contains(name, F.lit("분기보고서")) & F.contains(name, F.lit(f"({year}.09)")),
    }
    day = compact_date(F.col("rcept_dt"))
    found = filings.where(kinds.get(code, F.lit(False)) & day.between(F.lit(date(year, 1, 1)), F.lit(date(year + 1, 6, 30))))
    newest = Window.partitionBy("corp_code").orderBy(F.desc("rcept_dt"), "ord")
    return found.withColumn("nth", F.row_number().over(newest))


def filing_list(filings: DataFrame, corp_code=None, begin: str | None = None, end: str | None = None, page_no: int = 1, page_count: int = 100) -> DataFrame:
    """One page of a corp's filings (all corps' without one) between two days (yyyyMMdd, both included), newest first,
    the greater rcept_no first on a day. A page is a limit by its nature; whoever wants all rows filters without it."""
    day = compact_date(F.col("rcept_dt"))
    found = filings if corp_code is None else filings.where(F.col("corp_code") == corp_code)
    if begin is not None:
        found = found.where(day >= compact_date(F.lit(begin)))
    if end is not None:
        found = found.where(day <= compact_date(F.lit(end)))
    return found.orderBy(F.desc("rcept_dt"), F.desc("rcept_no")).offset((page_no - 1) * page_count).limit(page_count)


def first_usable(candidates: DataFrame, ok: str = "ok") -> DataFrame:
    """Each corp's newest candidate that could be read."""
    newest = Window.partitionBy("corp_code").orderBy(F.desc("rcept_dt"), "ord")
    return candidates.where(F.col(ok)).withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth")


def fill_corp_codes(watchlist: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The watchlist with missing corp codes filled from mapping (stock_code, corp_code), and the rows still without."""
    found = mapping.select(F.col("stock_code").alias("ticker"), F.col("corp_code").alias("mapped"))
    out = watchlist.join(found, "ticker", "left").withColumn("corp_code", F.coalesce("corp_code", "mapped")).drop("mapped")
    return out, out.where("corp_code is null")
