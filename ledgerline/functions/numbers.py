"""Numbers out of text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import AMOUNT_UNITS

SIGNED = "^[△▼-]"
PLUS = "^[+▲]"


def trimmed(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")


def to_int(x: Column) -> Column:
    """An integer without its thousands commas; null if it isn't one."""
    plain = trimmed(F.replace(x, F.lit(","), F.lit("")))
    return F.when(plain.rlike("^[+-]?[0-9]+$"), plain.try_cast("bigint"))


def lenient_int(x: Column) -> Column:
    """As a scraped cell: 0 where it isn't a number."""
    return F.coalesce(to_int(x), F.lit(0).cast("bigint"))


def lenient_pct(x: Column) -> Column:
    plain = trimmed(F.replace(F.replace(x, F.lit("%"), F.lit("")), F.lit(","), F.lit("")))
    return F.coalesce(F.when(plain.rlike("^[+-]?[0-9]*\\.?[0-9]+$"), plain.try_cast("double")), F.lit(0.0))


def unit_scale(unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, scale in AMOUNT_UNITS.items():
        out = F.when(unit == name, F.lit(scale)).otherwise(out)
    return out


def _unsigned(text: Column) -> Column:
    return F.when(text.rlike("^[0-9,]*\\.?[0-9]+$|^[0-9][0-9,]*\\.$"), F.replace(text, F.lit(","), F.lit("")).try_cast("double"))


def signed_amount(number: Column, unit: Column) -> Column:
    """A claim's value: one sign (△ ▼ - take away, + ▲ add), commas, and the unit. More signs: null."""
    text = trimmed(number)
    sign = F.when(text.rlike(SIGNED), -1.0).otherwise(1.0)
    return sign * _unsigned(trimmed(F.regexp_replace(text, "^[△▼+▲-]", ""))) * unit_scale(unit)


def absolute_amount(number: Column, unit: Column) -> Column:
    """An amount whose signs are dropped."""
    return _unsigned(F.regexp_replace(trimmed(number), "^[△▲▼+\\- ]+", "")) * unit_scale(unit)


def cell_number(cell: Column) -> Column:
    """A table cell's number: stars, commas and % go; blanks and dashes are null; △ ▼ - take away."""
    text = trimmed(F.regexp_replace(cell, "[*]", ""))
    text = F.regexp_replace(text, "[,%]", "")
    sign = F.when(text.rlike(SIGNED), -1.0).otherwise(1.0)
    plain = trimmed(F.regexp_replace(text, "^[△▼+▲-]", ""))
    return F.when(~text.isin("—", "-", "·", "N/A", "n/a", ""), sign * F.when(plain.rlike("^[0-9]*\\.?[0-9]+$|^[0-9]+\\.$"), plain.try_cast("double")))


def pct_change(now: Column, before: Column, at_zero: Column | None = None) -> Column:
    """(now / before - 1) * 100; where before is 0, at_zero (null by default)."""
    pct = (now / F.nullif(before, F.lit(0)) - 1) * 100
    return pct if at_zero is None else F.when(before == 0, at_zero).otherwise(pct)


def fact_decimals(x: Column) -> Column:
    """Blank, INF and anything that isn't digits: null."""
    return F.when(trimmed(x).rlike("^-?[0-9]+$"), trimmed(x).try_cast("int"))
