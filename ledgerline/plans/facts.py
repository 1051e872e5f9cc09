"""Queries on facts and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import facts as ops
from .registry import query
from .tables import read

# Facts: the value of each line; claims: the lines again, off by up to some percent, or by a power of ten.
SQL_FACTS = """facts AS (SELECT l_orderkey AS scope, l_extendedprice AS fact FROM lineitem),
claims AS (SELECT l_orderkey * 8 + l_linenumber AS claim_id, l_orderkey AS scope, l_extendedprice * CASE l_orderkey % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 1.005 WHEN 2 THEN -1.02 WHEN 3 THEN 10.05 WHEN 4 THEN 0.1 ELSE 1.4 END AS claim, l_orderkey % 13 = 0 AS is_in_inference
  FROM lineitem)"""


def _facts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    line = read(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") % 6
    factor = F.when(k == 0, 1.0).when(k == 1, 1.005).when(k == 2, -1.02).when(k == 3, 10.05).when(k == 4, 0.1).otherwise(1.4)
    facts = line.select(F.col("l_orderkey").alias("scope"), F.col("l_extendedprice").alias("fact"))
    claims = line.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("claim_id"), F.col("l_orderkey").alias("scope"), (F.col("l_extendedprice") * factor).alias("claim"), (F.col("l_orderkey") % 13 == 0).alias("is_in_inference"))
    return claims, facts


@query(f"WITH {SQL_FACTS} SELECT DISTINCT c.claim_id, CAST(1.0 AS DOUBLE) AS scale FROM claims c JOIN facts f ON c.scope = f.scope AND abs(f.fact - c.claim) <= greatest(abs(c.claim) * 0.01, 1.0)")
def tolerance_match(spark, sf_dir):
    return ops.tolerance_matches(*_facts(spark, sf_dir), ["scope"], 0.01)


@query(f"WITH {SQL_FACTS} SELECT DISTINCT c.claim_id, CAST(1.0 AS DOUBLE) AS scale FROM claims c JOIN facts f ON c.scope = f.scope AND abs(abs(f.fact) - abs(c.claim)) <= greatest(abs(c.claim) * 0.03, 1.0)")
def abs_match(spark, sf_dir):
    return ops.tolerance_matches(*_facts(spark, sf_dir), ["scope"], 0.03, signed=False)


@query(f"WITH {SQL_FACTS}, s AS (SELECT * FROM (VALUES (CAST(10.0 AS DOUBLE)), (CAST(0.1 AS DOUBLE))) AS v(scale)) SELECT DISTINCT c.claim_id, scale FROM claims c CROSS JOIN s JOIN facts f ON c.scope = f.scope AND abs(abs(f.fact) - abs(c.claim) * scale) <= greatest(abs(c.claim) * scale * 0.02, 1.0)")
def scale_match(spark, sf_dir):
    return ops.tolerance_matches(*_facts(spark, sf_dir), ["scope"], 0.02, (10.0, 0.1), signed=False)


@query(f"""WITH {SQL_FACTS}, t AS (SELECT c.claim_id, min(CASE WHEN abs(f.fact - c.claim) <= greatest(abs(c.claim) * 0.01, 1.0) THEN 1 WHEN abs(abs(f.fact) - abs(c.claim)) <= greatest(abs(c.claim) * 0.03, 1.0) THEN 2
  WHEN abs(abs(f.fact) - abs(c.claim) * 10.0) <= greatest(abs(c.claim) * 10.0 * 0.02, 1.0) OR abs(abs(f.fact) - abs(c.claim) * 0.1) <= greatest(abs(c.claim) * 0.1 * 0.02, 1.0) THEN 3 END) AS tier FROM claims c LEFT JOIN facts f ON c.scope = f.scope GROUP BY 1),
v AS (SELECT c.claim_id, CASE WHEN is_in_inference THEN 'skipped' WHEN tier = 1 THEN 'ok' WHEN tier = 2 THEN 'numeric_abs_or_rounded_match' WHEN tier = 3 THEN 'numeric_scale_mismatch' ELSE 'numeric_unverified' END AS status FROM claims c JOIN t ON c.claim_id = t.claim_id)
SELECT claim_id, status, CASE WHEN status IN ('skipped', 'ok') THEN 'none' WHEN status = 'numeric_scale_mismatch' THEN 'fail' ELSE 'warn' END AS severity FROM v""")
def claim_cascade(spark, sf_dir):
    return ops.check_claims(*_facts(spark, sf_dir), ["scope"]).select("claim_id", "status", "severity")


SQL_LABELS = """parts AS (SELECT p_partkey, 'ifrs-full:' || replace(p_type, ' ', '') AS concept FROM part), labels AS (SELECT 'ifrs-full_' || replace(p_type, ' ', '') || CASE WHEN min(p_partkey) % 3 = 0 THEN 'X' ELSE '' END AS concept_id, min(p_name) AS label, min(p_partkey) AS ord FROM part GROUP BY p_type)"""


@query(f"""WITH {SQL_LABELS}, c AS (SELECT DISTINCT concept, split_part(concept, ':', 2) AS local FROM parts)
SELECT concept, (SELECT label FROM labels l WHERE suffix(l.concept_id, c.local) ORDER BY ord LIMIT 1) AS label FROM c""")
def fact_label_suffix_join(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("local", F.replace("p_type", F.lit(" "), F.lit("")))
    labels = part.groupBy("local").agg(F.min("p_name").alias("label"), F.min("p_partkey").alias("ord"))
    labels = labels.select(F.concat(F.lit("ifrs-full_"), "local", F.when(F.col("ord") % 3 == 0, "X").otherwise("")).alias("concept_id"), "label", "ord")
    return ops.label_concepts(part.select(F.concat(F.lit("ifrs-full:"), "local").alias("concept")), labels)


@query("""WITH f AS (SELECT p_brand AS concept, count(*) AS n FROM part GROUP BY 1), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY concept ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT concept, n FROM b WHERE before < 200""")
def core_timeseries_softcap(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    core = [r[0] for r in part.select("p_brand").distinct().orderBy("p_brand").collect()]  # a short list of names
    facts = part.select(F.col("p_brand").alias("concept"), F.lit("2025-12-31").alias("period_end"), F.col("p_partkey").alias("ord"), F.col("p_retailprice").alias("value"))
    return ops.core_timeseries(facts, core).select("concept", "n")


@query("SELECT p_type AS concept, count(*) AS n, min(p_partkey) AS first_ord FROM part GROUP BY 1 ORDER BY n DESC, first_ord LIMIT 20")
def concept_top20(spark, sf_dir):
    return ops.top_concepts(read(spark, sf_dir, "part").select(F.col("p_type").alias("concept"), F.col("p_partkey").alias("ord")))


@query("""WITH d AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k, CAST(s AS DOUBLE) AS detail_sum, o_totalprice AS total, n, abs(CAST(s AS DOUBLE) - o_totalprice) > greatest(abs(o_totalprice) * 0.02, 0.5) AS mismatch FROM d JOIN orders ON k = o_orderkey WHERE n >= 2""")
def detail_vs_total(spark, sf_dir):
    details = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"))
    totals = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"))
    out = ops.detail_against_total(details, totals, ["k"])
    detail_sum = F.col("detail_sum").cast("double")
    return out.select("k", detail_sum.alias("detail_sum"), "total", "n", (F.abs(detail_sum - F.col("total")) > F.greatest(F.abs("total") * 0.02, F.lit(0.5))).alias("mismatch"))


@query("""WITH s AS (SELECT l_orderkey AS k, count(*) AS n, CAST(sum(CAST(l_discount * 100 + l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY 1) SELECT k, total FROM s WHERE n >= 3 AND (total < 95 OR total > 105)""")
def share_sum_100(spark, sf_dir):
    share = (F.col("l_discount") * 100 + F.col("l_quantity")).cast("decimal(18,2)")
    sums = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.sum(share).cast("double").alias("total"))
    return sums.where("n >= 3 and (total < 95 or total > 105)").select("k", "total")


@query("""WITH a AS (SELECT c_nationkey AS ticker, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS expected, 0.05 AS tolerance_pct FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
c AS (SELECT ticker, expected * CASE ticker % 3 WHEN 0 THEN 1.01 WHEN 1 THEN 0.9 ELSE 1.2 END AS found FROM a)
SELECT a.ticker, found, expected, (found - expected) / expected * 100 AS deviation_pct FROM a JOIN c ON a.ticker = c.ticker WHERE abs(found - expected) > abs(expected) * tolerance_pct""")
def fact_restatement_check(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("ticker"))
    sums = read(spark, sf_dir, "orders").join(customer, "o_custkey").groupBy("ticker").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("expected"))
    factor = F.when(F.col("ticker") % 3 == 0, 1.01).when(F.col("ticker") % 3 == 1, 0.9).otherwise(1.2)
    claims = sums.select("ticker", (F.col("expected") * factor).alias("found"))
    return ops.restatement_check(claims, sums.withColumn("tolerance_pct", F.lit(0.05)), ["ticker"]).select("ticker", "found", "expected", "deviation_pct")
