"""Forms that must not hang on one task, one key or the square of a text."""

from __future__ import annotations

import random
import subprocess
import sys
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import ranking, triggers, validate
from ledgerline.sources import markup

from .conftest import ROOT
from .test_sources import LABELS, XBRL


def test_ranks_by_ranges(spark):
    random.seed(1)
    rows = [(i, random.choice([None, 1.0, 2.5, 2.5, 7.0])) for i in range(500)]
    frame = spark.createDataFrame(rows, "id int, score double").repartition(7)
    found = ranking.ranked(frame, F.desc("score"), F.col("id"))
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.id, r.score) for r in sorted(found.collect(), key=lambda r: r["rank"])] == want and found.columns == ["id", "score", "rank"]
    assert sorted(r["rank"] for r in found.collect()) == list(range(1, 501))
    assert ranking.ranked(frame.where("id < 0"), F.col("id")).count() == 0


def test_ranked_hits_has_no_window_of_one_task(spark):
    watch = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "ord int, ticker string")
    hits = spark.createDataFrame([(f"t{i % 20}", "price_move", float(i % 3)) for i in range(40)], "ticker string, trigger_type string, severity double")
    found = triggers.ranked_hits(watch, hits)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan and found.agg(F.max("rank")).first()[0] == 40


def test_budgets_of_a_hot_key(spark):
    random.seed(2)
    rows = [("hot", i, random.randrange(0, 90)) for i in range(3000)] + [(None, i, 50) for i in range(5)] + [("small", i, 10 * i) for i in range(7)]
    frame = spark.createDataFrame(rows, "grp string, ord int, n_chars int").repartition(5)
    group, before = Window.partitionBy("grp"), Window.partitionBy("grp").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    want = F.least("n_chars", F.lit(60))
    plain = frame.withColumn("base", F.least(want, F.greatest(F.lit(1), F.floor(F.lit(9000) / F.count("*").over(group))))).withColumn("room", want - F.col("base"))
    rest = F.lit(9000) - F.sum("base").over(group) - F.coalesce(F.sum("room").over(before), F.lit(0))
    plain = plain.withColumn("budget", (F.col("base") + F.least("room", F.greatest(rest, F.lit(0)))).cast("long"))
    key = lambda frame: sorted(((r.grp, r.ord, r.budget) for r in frame.collect()), key=repr)
    found = ranking.budgets(frame, 60, 9000)
    assert key(found) == key(plain) and found.columns == ["grp", "ord", "n_chars", "budget"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins what is small
    try:
        ranged = ranking.running(frame.where("grp = 'hot'"), "grp", "ord", {"s": F.col("n_chars")})
        assert len([f for f in ranged.inputFiles() if "running" in f]) >= 3  # one key, several ranges
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_places_take_linear_time(spark):
    places = 100_000
    text = "capex 확인되지 않음\n" + "capex 1조 " * places + "\n" + "x capex\n" * 1000
    frame = spark.createDataFrame([(1, text), (1, text), (2, "capex " * places), (3, "😀 CAPEX 확인되지 않음\n" + "😀" * 70 + " capex\n3조"), (4, None), (None, "WACC 확인되지 않음\nwacc 2조")], "doc_id int, text string")
    validate.unknown_and_asserted(frame.where("doc_id = 3")).collect()
    start = time.perf_counter()
    assert sorted((str(r.doc_id), r.word) for r in validate.unknown_and_asserted(frame).collect()) == [("1", "capex"), ("3", "capex"), ("None", "WACC")]
    assert time.perf_counter() - start < 60


def test_windows_reach_over_lines(spark):
    near, far = "capex 확인되지 않음\n" + "y" * 80 + "\ncapex\n" + "z" * 40 + " 5조", "capex 확인되지 않음\n" + "y" * 80 + "\ncapex\n" + "z" * 60 + " 5조"
    inferred = "capex 확인되지 않음\n추론" + "y" * 50 + "\ncapex 5억"
    frame = spark.createDataFrame([(1, near), (2, far), (3, inferred), (4, inferred.replace("추론", "추론" + "y" * 20))], "doc_id int, text string")
    assert sorted(r.doc_id for r in validate.unknown_and_asserted(frame).collect()) == [1, 4]


def test_pull_parser_rows():
    instance = list(markup._xbrl_rows("i", XBRL.encode()))
    assert [(r["kind"], r["ord"]) for r in instance] == [("context", 0), ("context", 1), ("unit", 2), ("fact", 3), ("fact", 4), ("fact", 5), ("fact", 6)]
    assert instance[0]["dimensions"] == [{"axis": "a:Axis", "member": "a:Member"}] and instance[1]["period_start"] == "2025-01-01"
    labels = list(markup._xbrl_rows("l", LABELS.encode()))
    assert [(r["kind"], r["ord"]) for r in labels] == [("loc", 2), ("labelArc", 3), ("label", 4), ("label", 5), ("label", 6)] and labels[3]["value"] == "자산"


LARGE = """
import resource, sys
sys.path.insert(0, {root!r})
from ledgerline.sources import markup
fact = b'<ifrs:Revenue contextRef="c2" unitRef="KRW" decimals="-6">' + b'1' * 60 + b'</ifrs:Revenue>\\n'
head = b'<xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:ifrs="http://xbrl.ifrs.org/taxonomy/2021-03-24/ifrs-full">'
n = (200 << 20) // len(fact)
content = b"".join([head, fact * n, b"</xbrli:xbrl>"])
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
before = peak()
rows = sum(1 for _ in markup._xbrl_rows("x", content))
print(rows == n, peak() - before)
"""


def test_large_instance_in_bounded_memory():
    out = subprocess.run([sys.executable, "-c", LARGE.format(root=ROOT)], capture_output=True, text=True, timeout=300, check=True).stdout.split()
    assert out[0] == "True" and int(out[1]) < 50  # MB beside the content of 200 MB
