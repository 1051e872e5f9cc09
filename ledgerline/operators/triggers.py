"""Daily triggers: four kinds of hits, their scores, and the ranking of hits and tickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.dates import holds_any
from .ranking import ranked
from .series import latest, one_row_change

HIT = ["ticker", "trigger_type", "severity"]


def score(trigger_type: Column, severity: Column) -> Column:
    """The kind's weight times the severity; flows by the logarithm of 1 + severity, so that one doesn't drown the rest."""
    weight = F.lit(rules.OTHER_WEIGHT)
    for kind, w in rules.SCORE_WEIGHTS.items():
        weight = F.when(trigger_type == kind, F.lit(w)).otherwise(weight)
    return weight * F.when(trigger_type == "foreign_flow", F.log1p(severity)).otherwise(severity)


def trigger_order(trigger_type: Column) -> Column:
    return F.coalesce(*(F.when(trigger_type == kind, F.lit(i)) for i, kind in enumerate(rules.TRIGGER_ORDER)), F.lit(len(rules.TRIGGER_ORDER)))


def price_moves(bars: DataFrame, threshold: float = rules.PRICE_MOVE_PCT) -> DataFrame:
    """Tickers whose newest close moved by ``threshold`` percent or more; one close alone is no move."""
    moved = latest(one_row_change(bars)).where(F.col("prev_close").isNotNull() & (F.abs("pct_change") >= threshold))
    return moved.select("ticker", F.lit("price_move").alias("trigger_type"), (F.abs("pct_change") / threshold).alias("severity"), "dt", "close", "prev_close", "pct_change")


def cumulative_flow(flows: DataFrame, rows: int = rules.FLOW_DAYS) -> DataFrame:
    """The sum of each ticker's newest rows; with fewer rows, of those there are."""
    return latest(flows, rows).groupBy("ticker").agg(F.sum("net_krw").alias("cumulative"), F.count("*").alias("n"))


def flow_hits(flows: DataFrame, threshold: float = rules.FLOW_KRW, rows: int = rules.FLOW_DAYS) -> DataFrame:
    """Tickers whose newest ``rows`` rows (no fewer) add up to ``threshold`` or more, either way."""
    newest = latest(flows, rows).groupBy("ticker").agg(
        F.count("*").alias("n"), F.sum("net_krw").cast("double").alias("cumulative"), F.min("dt").alias("first_date"), F.max("dt").alias("last_date"),
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"),
    )
    hits = newest.where((F.col("n") == rows) & (F.abs("cumulative") >= threshold))
    direction = F.when(F.col("cumulative") > 0, "매수").otherwise("매도")
    return hits.select("ticker", F.lit("foreign_flow").alias("trigger_type"), (F.abs("cumulative") / threshold).alias("severity"), direction.alias("direction"), "cumulative", "first_date", "last_date", "sources")


def decoupling_hits(flows: DataFrame, pct: float = rules.DECOUPLING_PCT, krw: float = rules.DECOUPLING_KRW) -> DataFrame:
    """Tickers whose newest row has price and flow going opposite ways, both beyond their thresholds."""
    net = F.col("net_krw").cast("double")
    far = (F.abs("pct_change") >= pct) & (F.abs(net) >= krw) & ((F.col("pct_change") > 0) != (net > 0))
    hits = latest(flows).where(far)
    severity = (F.abs("pct_change") / pct + F.abs(net) / krw) / 2
    label = F.when(F.col("pct_change") > 0, "국내 환호 / 외인 매도").otherwise("국내 패닉 / 외인 매수")
    return hits.select("ticker", F.lit("decoupling").alias("trigger_type"), severity.alias("severity"), label.alias("label"), "dt", "pct_change", net.alias("net_krw"))


def impact(report_nm: Column) -> Column:
    """A filing's impact by its name: the first tier that it holds a word of, else 0."""
    out = F.lit(0.0)
    for value, words in reversed(rules.IMPACT_TIERS):
        out = F.when(holds_any(report_nm, words), F.lit(value)).otherwise(out)
    return F.when(report_nm.isNull(), F.lit(0.0)).otherwise(out)


def best_disclosures(filings: DataFrame, key: str = "ticker") -> DataFrame:
    """Each key's filing of the greatest impact, the first in order on a tie, and how many had any."""
    scored = filings.withColumn("severity", impact(F.col("report_nm"))).where("severity > 0")
    best = Window.partitionBy(key).orderBy(F.desc("severity"), "ord")
    out = scored.withColumn("rn", F.row_number().over(best)).withColumn("matched_count", F.count("*").over(Window.partitionBy(key))).where("rn = 1")
    return out.select(key, F.lit("dart_disclosure").alias("trigger_type"), "severity", "rcept_no", "report_nm", "matched_count")


def ranked_hits(watchlist: DataFrame, *hits: DataFrame) -> DataFrame:
    """All hits of the watchlist with score and rank: greatest score first, ties by watchlist and trigger order."""
    union = hits[0].select(*HIT)
    for more in hits[1:]:
        union = union.unionByName(more.select(*HIT))
    scored = union.join(watchlist.select("ticker", "ord"), "ticker").withColumn("score", score(F.col("trigger_type"), F.col("severity")))
    scored = scored.withColumn("kind_ord", trigger_order(F.col("trigger_type")))
    return ranked(scored, F.desc("score"), F.col("ord"), F.col("kind_ord")).select(F.col("rank").cast("int").alias("rank"), *HIT, "score", "ord")


def top_tickers(hits: DataFrame, n: int = 3) -> DataFrame:
    """The n tickers of the greatest summed score; ties go to the one whose first hit ranks first."""
    per = hits.groupBy("ticker").agg(F.sum("score").alias("total_score"), F.min("rank").alias("first_rank"))
    return per.orderBy(F.desc("total_score"), "first_rank").limit(n).select("ticker", "total_score")


def counts_by_type(hits: DataFrame) -> DataFrame:
    """Hits of each kind in display order, kinds without hits left out."""
    shown = {"price_move": 0, "dart_disclosure": 1, "foreign_flow": 2, "decoupling": 3}
    place = F.coalesce(*(F.when(F.col("trigger_type") == k, F.lit(i)) for k, i in shown.items()), F.lit(len(shown)))
    return hits.groupBy("trigger_type").agg(F.count("*").alias("n")).withColumn("display_ord", place)


def should_publish(hits: DataFrame) -> bool:
    return not hits.isEmpty()


def hits_for_ticker(hits: DataFrame, ticker) -> DataFrame:
    return hits.where(F.col("ticker") == ticker)
