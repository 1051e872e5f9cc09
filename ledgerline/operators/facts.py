"""Facts of financial statements: labels, selections, and the matching of claims within tolerances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules


def with_contexts(facts: DataFrame, contexts: DataFrame) -> DataFrame:
    """Facts with their context's period and dimensions; an unknown context gives '?', nulls and no dimensions."""
    out = facts.join(contexts, "context_id", "left")
    none = F.array().cast("array<struct<axis:string,member:string>>")
    return out.withColumn("period_type", F.coalesce("period_type", F.lit("?"))).withColumn("dimensions", F.coalesce("dimensions", none))


def labels_of(locators: DataFrame, arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """concept_id and label through locators (loc, concept_id), arcs (ord, loc, res) and label resources (res, lang,
    role, text, ord): Korean ones, the standard role first; the last arc of a concept wins."""
    usable = labels.where(F.startswith("lang", F.lit("ko")) & F.contains("role", F.lit("/label")) & ~F.endswith("role", F.lit("documentation")))
    standard = F.contains("role", F.lit("/2003/role/label"))
    best = Window.partitionBy("res").orderBy(F.desc(standard.cast("int")), F.when(standard, F.col("ord")).desc(), F.when(~standard, F.col("ord")).asc())
    chosen = usable.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("res", "text")
    joined = arcs.join(locators, "loc").join(chosen, "res")
    last = Window.partitionBy("concept_id").orderBy(F.desc("ord"))
    return joined.withColumn("nth", F.row_number().over(last)).where("nth = 1").select("concept_id", F.col("text").alias("label"), "ord")


def label_concepts(concepts: DataFrame, labels: DataFrame) -> DataFrame:
    """Each distinct concept (prefix:Local) with the label of the same id, else of the first id that ends with Local.

    The ends of each label id that could be a local name, from every place in it, meet the local names by equality:
    rows follow the ids' lengths, and no table is compared with all of another.
    """
    distinct = concepts.select("concept").distinct()
    exact = distinct.join(labels.select(F.col("concept_id").alias("concept"), F.col("label").alias("own")), "concept", "left")
    open_ = exact.where("own is null and instr(concept, ':') > 0").select("concept", F.expr("substr(concept, instr(concept, ':') + 1)").alias("local"))
    ends = labels.where("concept_id != ''").select("label", "ord", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("concept_id")), lambda i: F.col("concept_id").substr(i, F.char_length("concept_id")))).alias("local"))
    first = Window.partitionBy("concept").orderBy("ord")
    by_end = open_.join(ends, "local").withColumn("nth", F.row_number().over(first)).where("nth = 1").select("concept", F.col("label").alias("by_end"))
    return exact.join(by_end, "concept", "left").select("concept", F.coalesce("own", "by_end").alias("label"))


def is_consolidated_primary(period_end: Column, dimensions: Column, since: str = "2023-01-01") -> Column:
    """Of a period ending since then (as text), without dimensions or only consolidated."""
    axes = F.array_distinct(F.transform(dimensions, lambda d: d.axis))
    own = F.array(F.lit(f"ifrs-full:{rules.CONSOLIDATED_AXIS}"))
    last = F.element_at(F.filter(dimensions, lambda d: F.lit(True)), -1)
    return F.coalesce(period_end >= since, F.lit(False)) & ((F.size(dimensions) == 0) | ((axes == own) & F.endswith(last.member, F.lit(":ConsolidatedMember"))))


def core_timeseries(facts: DataFrame, concepts: Sequence[str] = rules.CORE_CONCEPTS, most: int = 200) -> DataFrame:
    """Concepts in order with their facts by period; none after the one with which ``most`` facts are reached.
    facts: concept, period_end, value, ord. Concepts are a given list, so the running sum is over so many rows."""
    per = facts.where(F.col("concept").isin(*concepts)).groupBy("concept").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.coalesce("period_end", F.lit("")).alias("period_end"), "ord", "value"))).alias("series"),
    )
    before = Window.orderBy("concept").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < most).drop("before")


def top_concepts(facts: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent concepts; on a tie the one seen first."""
    return facts.groupBy("concept").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord")).orderBy(F.desc("n"), "first_ord").limit(n)


def first_authoritative(facts: DataFrame, year: int, concept: str) -> DataFrame:
    """The first fact of a concept at the year's end that is without dimensions or of the consolidated member."""
    own = (F.col("concept") == concept) & (F.col("period_end") == f"{year}-12-31")
    plain = (F.size("dimensions") == 0) | F.exists("dimensions", lambda d: F.contains(d.axis, F.lit("ConsolidatedMember")) | F.contains(d.member, F.lit("ConsolidatedMember")))
    return facts.where(own & plain).orderBy("ord").limit(1)


def within(fact: Column, target: Column, tolerance: float) -> Column:
    return F.abs(fact - target) <= F.greatest(F.abs(target) * tolerance, F.lit(1.0))


WIDTH = 0.2  #: of a bucket, on the scale of log(1 + |x|): wide against tolerances, so that few claims reach into two


def _bucket(x: Column) -> Column:
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) / WIDTH)


def _near(claims: DataFrame, facts: DataFrame, scope: Sequence[str], tolerance: float) -> DataFrame:
    """claims (scope, target) with each fact of their scope within the tolerance of the target, or 1, and some more.

    Both sides meet in buckets of their logarithm: a fact lies in one, a claim in those that its reach meets, mostly one
    and a few around 0. So this is an equi-join, whatever the tables' sizes.
    """
    far = F.greatest(F.abs("target") * tolerance, F.lit(1.0)) + F.abs("target") * 1e-9  # where rounding might put an end of the reach on the other side of a bucket's
    wanted = claims.where("abs(target) < double('infinity')").withColumn("bucket", F.explode(F.sequence(_bucket(F.col("target") - far), _bucket(F.col("target") + far))))
    return wanted.join(facts.withColumn("bucket", _bucket(F.col("fact"))), [*scope, "bucket"])


def tolerance_matches(claims: DataFrame, facts: DataFrame, scope: Sequence[str], tolerance: float, scales: Sequence[float] = (1.0,), signed: bool = True) -> DataFrame:
    """claim_id and scale of the claims (claim_id, claim, scope) that a fact (fact, scope) of their scope matches:
    |fact - claim * scale| <= max(|claim * scale| * tolerance, 1), on absolute values unless signed."""
    fact, claim = (F.col("fact"), F.col("claim")) if signed else (F.abs("fact"), F.abs("claim"))
    left = facts.where("fact is not null").select(*scope, fact.alias("fact"))
    targets = claims.where("claim is not null").select("claim_id", *scope, claim.alias("claim"), F.explode(F.array(*map(F.lit, scales))).alias("scale"))
    targets = targets.select("claim_id", *scope, "scale", (F.col("claim") * F.col("scale")).alias("target"))
    hits = _near(targets, left, scope, tolerance).where(within(F.col("fact"), F.col("target"), tolerance))
    return hits.select("claim_id", "scale").distinct()


SCALED = (10.0, 0.1)


def check_claims(claims: DataFrame, facts: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Adds status and severity to claims (claim_id, claim, is_in_inference, scope): skipped when marked as inference,
    ok within 1 %, warn numeric_abs_or_rounded_match within 3 % of absolute values, fail numeric_scale_mismatch within
    2 % of ten times or a tenth, else warn numeric_unverified. All three are told in one meeting of claims and facts: what is
    within 1 % is within 3 % of absolute values, too. Claims marked as inference need no meeting."""
    open_ = claims.where("claim is not null and not coalesce(is_in_inference, false)").select("claim_id", *scope, "claim", F.explode(F.array(*map(F.lit, (1.0, *SCALED)))).alias("scale"))
    targets = open_.withColumn("target", F.abs("claim") * F.col("scale"))
    left = facts.where("fact is not null").select(*scope, F.abs("fact").alias("fact"), (F.col("fact") < 0).alias("below"))
    one = F.col("scale") == 1.0
    met = _near(targets, left, scope, 0.03)
    signed = F.when(F.col("below"), -F.col("fact")).otherwise(F.col("fact"))
    tier = (
        F.when(one & within(signed, F.col("claim"), 0.01), 1).when(one & within(F.col("fact"), F.col("target"), 0.03), 2)
        .when(~one & within(F.col("fact"), F.col("target"), 0.02), 3)
    )
    best = met.select("claim_id", tier.alias("tier")).where("tier is not null").groupBy("claim_id").agg(F.min("tier").alias("tier"))
    status = (
        F.when(F.col("is_in_inference"), "skipped").when(F.col("tier") == 1, "ok").when(F.col("tier") == 2, "numeric_abs_or_rounded_match")
        .when(F.col("tier") == 3, "numeric_scale_mismatch").otherwise("numeric_unverified")
    )
    severity = F.when(F.col("status").isin("skipped", "ok"), "none").when(F.col("status") == "numeric_scale_mismatch", "fail").otherwise("warn")
    return claims.join(best, "claim_id", "left").withColumn("status", status).withColumn("severity", severity).drop("tier")


def detail_against_total(details: DataFrame, totals: DataFrame, key: Sequence[str], share: float = 0.02, least: float = 0.5) -> DataFrame:
    """Sums of details (key, value) against totals (key, total): mismatch beyond max(share * |total|, least)."""
    summed = details.groupBy(*key).agg(F.sum("value").alias("detail_sum"), F.count("*").alias("n"))
    out = totals.join(summed, list(key)).where("n >= 2")
    return out.withColumn("mismatch", F.abs(F.col("detail_sum") - F.col("total")) > F.greatest(F.abs("total") * share, F.lit(least)))


def restatement_check(claims: DataFrame, authority: DataFrame, key: Sequence[str]) -> DataFrame:
    """Claims (key, found) beyond the tolerance_pct of their fact (key, expected, tolerance_pct), with the signed
    deviation in percent."""
    out = claims.join(authority, list(key))
    off = F.abs(F.col("found") - F.col("expected")) > F.abs("expected") * F.col("tolerance_pct")
    return out.where(off).withColumn("deviation_pct", (F.col("found") - F.col("expected")) / F.col("expected") * 100)
