"""The end products: operators put together over whole tables, a plan for all tickers at once."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.dates import compact_date
from ..functions.numbers import trimmed
from ..functions.text import lines
from ..sources.folders import dealt
from . import facts as fact_ops
from . import holdings, series, triggers, validate
from .planner import to_render


def evaluate_triggers(watchlist: DataFrame, bars: DataFrame, flows: DataFrame, filings: DataFrame, as_of: date, days_back: int = 1, **thresholds: float) -> DataFrame:
    """All hits of a day, scored and ranked. Filings count from ``days_back`` days before it on. thresholds: price,
    flow, decoupling_pct, decoupling_krw; the defaults are the rules'."""
    t = {"price": rules.PRICE_MOVE_PCT, "flow": rules.FLOW_KRW, "decoupling_pct": rules.DECOUPLING_PCT, "decoupling_krw": rules.DECOUPLING_KRW} | thresholds
    recent = filings.where(compact_date(F.col("rcept_dt")).between(F.date_sub(F.lit(as_of), days_back), F.lit(as_of)))
    return triggers.ranked_hits(
        watchlist, triggers.price_moves(bars, t["price"]), triggers.flow_hits(flows, t["flow"]), triggers.best_disclosures(recent), triggers.decoupling_hits(flows, t["decoupling_pct"], t["decoupling_krw"])
    )


def market_snapshot(bars: DataFrame, share_items: DataFrame, rows: int = 60, year_rows: int = 240) -> DataFrame:
    """Per ticker: close, its date, change over 60 rows and a year (two decimals), the last closes, share counts and
    market cap; prices or counts may be missing."""
    priced = series.change_over_rows(bars, rows).withColumnRenamed("pct", "pct_60d")
    priced = series.latest(series.change_over_rows_or_first(priced, year_rows)).select("ticker", "close", F.col("dt").alias("close_date"), F.round("pct_60d", 2).alias("pct_60d"), F.round("pct", 2).alias("pct_1y"))
    closes = series.tail(bars, rows).withColumnRenamed("series", "closes")
    out = holdings.ticker_snapshot(priced.join(closes, "ticker", "left"), holdings.share_counts(share_items))
    return out.withColumn("cap_trillion", F.round(F.col("market_cap") / 1e12, 4))


def holding_snapshot(reports: DataFrame, history: DataFrame) -> DataFrame:
    """Per ticker: holders, foreign holders and their share, the latest holding and its change over five rows (three
    decimals)."""
    summary = holdings.foreign_summary(holdings.latest_per_holder(reports))
    moved = series.delta_rows(history, "holding_pct").select("ticker", F.col("holding_pct").alias("latest_pct"), F.round("delta", 3).alias("change_5d"))
    return summary.join(moved, "ticker", "full")


def fact_summary(facts: DataFrame, labels: DataFrame, most: int = 200) -> DataFrame:
    """Core concepts of consolidated primary facts with their labels and series, up to the cap."""
    primary = facts.where(fact_ops.is_consolidated_primary(F.col("period_end"), F.col("dimensions")))
    core = fact_ops.core_timeseries(primary, most=most)
    return core.join(fact_ops.label_concepts(core, labels), "concept", "left").withColumn("label", F.coalesce("label", "concept"))


# The concept that each fact with authority is read from.
AUTHORITY_CONCEPTS = {
    "revenue": "ifrs-full:Revenue",
    "operating_income": "dart:OperatingIncomeLoss",
    "operating_cash_flow": "ifrs-full:CashFlowsFromUsedInOperatingActivities",
    "capex": "ifrs-full:PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities",
}


def authoritative_facts(facts: DataFrame, year: int, market_cap: float | None = None) -> DataFrame:
    """Facts with authority for a year: of each concept the first fact of the year's end; a few rows."""
    spark = facts.sparkSession
    wanted = facts.where(F.col("concept").isin(*AUTHORITY_CONCEPTS.values()) & (F.col("period_end") == f"{year}-12-31"))
    plain = (F.size("dimensions") == 0) | F.exists("dimensions", lambda d: F.contains(d.axis, F.lit("ConsolidatedMember")) | F.contains(d.member, F.lit("ConsolidatedMember")))
    first = Window.partitionBy("concept").orderBy("ord")
    values = wanted.where(plain).withColumn("nth", F.row_number().over(first)).where("nth = 1").select("concept", "value")
    names = F.create_map(*(F.lit(x) for k, c in AUTHORITY_CONCEPTS.items() for x in (c, k)))
    known = values.select(names[F.col("concept")].alias("key"), F.col("value").alias("value_krw"))
    if market_cap is not None:
        known = known.unionByName(spark.createDataFrame([("market_cap", float(market_cap))], "key string, value_krw double"))
    meta = rules.authority_frame(spark, {k: 0.0 for k, *_ in rules.AUTHORITATIVE}).drop("value_krw")
    return meta.join(known.where("value_krw is not null"), "key").select("key", "label", "value_krw", "keywords", "tolerance_pct")


def checked_attempts(attempts: DataFrame, facts: DataFrame, authority: DataFrame) -> DataFrame:
    """Attempts (section, attempt, text) with passed: no failure of style, tables, numbers or consistency. facts: fact."""
    docs = dealt(attempts.withColumn("doc_id", F.struct("section", "attempt")), "doc_id")  # once for all validators
    rows = lines(docs)
    claims = validate.numeric_claims(rows).withColumn("claim_id", F.struct("doc_id", "line_no", "nth")).withColumn("scope", F.lit(0))
    numbers = fact_ops.check_claims(claims, facts.select(F.lit(0).alias("scope"), "fact"), ["scope"]).where("severity = 'fail'").select("doc_id")
    failed = validate.style_hits(rows).select("doc_id").unionByName(validate.unmarked_speculation(rows).select("doc_id")).unionByName(numbers)
    failed = failed.unionByName(validate.table_arithmetic(validate.tables_of(docs)).select("doc_id")).unionByName(validate.consistency(rows, authority).select("doc_id"))
    out = docs.join(failed.distinct().withColumn("bad", F.lit(True)), "doc_id", "left")
    return out.select("section", "attempt", "text", F.col("bad").isNull().alias("passed"))


def accepted_sections(attempts: DataFrame, facts: DataFrame, authority: DataFrame) -> DataFrame:
    """Of each section the first attempt that passes, else the last, as best_effort."""
    return validate.chosen_attempt(checked_attempts(attempts, facts, authority))


def render_plan(reports: DataFrame, rendered: DataFrame, watchlist: DataFrame) -> DataFrame:
    """What to render: reports without an output or newer than it, and a placeholder for each name without any report."""
    due = to_render(reports, rendered).select("name", F.lit("report").alias("kind"))
    without = watchlist.select("name").join(reports.select("name"), "name", "left_anti").withColumn("kind", F.lit("placeholder"))
    return due.unionByName(without)


def one_liner(text: Column, most: int = 200) -> Column:
    """The first line of prose of 20 characters or more: no headers, rules, quotes, lists of links or short items;
    links as their words; cut with an ellipsis."""
    linked = "\\[([^\\]]+)\\]\\([^)]+\\)"
    outside = F.regexp_replace(text, "(?s)(^|\\n)\\s*```.*?(\\n\\s*```[^\\n]*|\\z)", "\n")
    each = F.transform(F.split(outside, "\\r\\n|\\n"), trimmed)
    prose = F.filter(each, lambda s: ~s.rlike("^(#|---|>|$)") & ~s.rlike("^[-*+]\\s*\\[.+\\]\\(.+\\)\\s*$") & ~(s.rlike("^[-*+]") & (F.char_length(s) < 40)))
    words = F.filter(F.transform(prose, lambda s: F.regexp_replace(s, linked, "$1")), lambda s: F.char_length(s) >= 20)
    first = F.coalesce(F.get(words, 0), F.lit(""))
    return F.when(F.char_length(first) > most, F.concat(F.left(first, F.lit(most)), F.lit("…"))).otherwise(first)
