"""Dates of reports, as column expressions. Nothing reads the clock: ``as_of`` is a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import PROVISIONAL_KEYWORDS


def holds_any(text: Column, words: Sequence[str]) -> Column:
    """Whether the text holds one of the words, as they are written."""
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def compact_date(x: Column) -> Column:
    """yyyyMMdd; anything else is null."""
    return F.when(x.rlike("^[0-9]{8}$"), F.try_to_date(x, "yyyyMMdd"))


def period_end(report_nm: Column, rcept_dt: Column) -> Column:
    """The end of the quarter that a report is about, by its name or else by the month it came in; null if unknown."""
    name = F.coalesce(report_nm, F.lit(""))
    year, month = F.year(rcept_dt), F.month(rcept_dt)
    on = lambda m, d: F.make_date(year, F.lit(m), F.lit(d))
    by_month = (
        F.when(month <= 2, F.make_date(year - 1, F.lit(12), F.lit(31)))
        .when(month <= 5, on(3, 31))
        .when(month <= 8, on(6, 30))
        .otherwise(on(9, 30))
    )
    return (
        F.when(rcept_dt.isNull(), None)
        .when(F.contains(name, F.lit("1분기")), on(3, 31))
        .when(holds_any(name, ("반기", "2분기")), on(6, 30))
        .when(F.contains(name, F.lit("3분기")), on(9, 30))
        .when(holds_any(name, PROVISIONAL_KEYWORDS), by_month)
    )


def days_after(rcept: Column, annual: Column) -> Column:
    """Whole days between; -1 where a date is unknown."""
    return F.coalesce(F.datediff(rcept, annual), F.lit(-1))


def iso_week(day: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def iso_monday(week: Column) -> Column:
    """The Monday of a YYYY-Wnn; null if it isn't one."""
    year, number = F.regexp_extract(week, "^([0-9]{4})-W([0-9]{2})$", 1), F.regexp_extract(week, "^([0-9]{4})-W([0-9]{2})$", 2)
    first = F.date_trunc("week", F.make_date(year.try_cast("int"), F.lit(1), F.lit(4))).cast("date")
    return F.when(week.rlike("^[0-9]{4}-W[0-9]{2}$"), F.date_add(first, 7 * (number.try_cast("int") - 1)))


def weeks_between(earlier: Column, later: Column) -> Column:
    """Whole weeks from one YYYY-Wnn to another; 0 where one can't be read."""
    return F.coalesce(F.floor(F.datediff(iso_monday(later), iso_monday(earlier)) / 7), F.lit(0))


def friendly_period(label: Column) -> Column:
    """2025-annual and the like, in words; other labels stay as they are (lower-case quarters too)."""
    year, part = F.regexp_extract(label, "^([0-9]{4})-(annual|H1|Q1|Q3)$", 1), F.regexp_extract(label, "^([0-9]{4})-(annual|H1|Q1|Q3)$", 2)
    words = F.when(part == "annual", "연간").when(part == "H1", "상반기").when(part == "Q1", "1분기").when(part == "Q3", "3분기")
    return F.when(year != "", F.concat_ws(" ", F.concat(year, F.lit("년")), words)).otherwise(label)


def next_weekday_run(at: Column, hour: int = 16) -> Column:
    """The next weekday's run at ``hour``, today's if it hasn't been yet."""
    day = F.when(F.hour(at) >= hour, F.date_add(F.to_date(at), 1)).otherwise(F.to_date(at))
    shift = F.when(F.weekday(day) == 5, 2).when(F.weekday(day) == 6, 1).otherwise(0)
    return F.date_add(day, shift)


def calendar_days(business_days: int) -> int:
    """Calendar days to ask for so that so many business days are in them."""
    return int(business_days * 1.6) + 5
