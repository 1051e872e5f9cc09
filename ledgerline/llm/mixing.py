"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

The points frac(n * golden ratio), n = 0, 1, ..., fall on [0, 1) evenly at every stage; cut by the sources' cumulative
shares of the slots they give each slot its source, and a source's slots are ranked. A source's documents, shuffled,
are one stream of words that begins again after its end; its blocks are equally many words, its target divided by its
slots, and the slot of rank k takes the k-th block. So every source's slots take its target to the word, however
small it is: only how finely it is spread over the schedule depends on its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .shared import materialise

SLOTS = 1 << 16
LEAST_SLOTS = 64  # slots that a source has beside its share of the others; the schedule grows with the number of sources
CELL_POINTS = 16  # points of a cell of [0, 1), by which points and shares meet
RUN = 1 << 12  # slots that are ranked together
GOLDEN = 0.6180339887498949
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_of(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5("text")))


def key_of(source: str) -> Column:
    """Sources as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, its key, size and the hash that shuffles a source, with its bucket (first digits)."""
    return docs.select("doc_id", "source", key_of("source").alias("key"), word_count(F.col("text")).alias("size"), shuffle_of(seed).alias("shuffle")).withColumn("bucket", F.substring("shuffle", 1, 3))


def _before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum over all rows before this one in the order. Rows are dealt out by ranges of the
    order, so that a window runs in each range and the one over all only joins the ranges' sums, one row each."""
    ranged = materialise(rows.repartitionByRange(*order).withColumn("order_range", F.spark_partition_id()), "ranges")
    inside = _before(Window.partitionBy("order_range").orderBy(*order))
    ranges = ranged.groupBy("order_range").agg(*(F.sum(c).alias(f"{name}_range") for name, c in sums.items()))
    earlier = _before(Window.orderBy("order_range"))
    ranges = ranges.select("order_range", *(F.coalesce(F.sum(f"{name}_range").over(earlier), F.lit(0)).alias(f"{name}_range") for name in sums))
    out = ranged.join(ranges, "order_range")
    return out.withColumns({name: F.col(f"{name}_range") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()}).drop("order_range", *(f"{name}_range" for name in sums))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """key, nth (from 0, by code point, null last), source_size and target: ``share`` of all words divided by the
    repeating weights, none over ``most`` times its source. One row for each source.

    Sharing the excess again and again ends with the sources at their limit being those of the smallest limit per
    weight, so they are sorted by that: the first that its equal share of the rest doesn't fill sets the level for
    all after it.
    """
    each = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    each = running(each, [F.col("key") == "", F.col("key")], {"nth": F.lit(1).cast("long")})
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long"))
    each = each.withColumn("limit", F.col("source_size") * F.lit(most))
    each = running(each, [F.col("limit") / F.col("weight"), F.col("nth")], {"full": F.col("limit"), "filled_weight": F.col("weight")})
    each = materialise(each, "filling")
    whole = each.agg((F.sum("source_size") * F.lit(share)).alias("goal"), F.sum("weight").alias("all_weight"))  # one row
    each = each.crossJoin(whole).withColumn("level", (F.col("goal") - F.col("full")) / (F.col("all_weight") - F.col("filled_weight")))
    free = F.col("level") * F.col("weight") <= F.col("limit")
    level = each.where(free).agg(F.min_by("level", F.struct(F.col("limit") / F.col("weight"), "nth")).alias("level"))  # one row
    each = each.drop("level").crossJoin(level)
    return each.select("key", "nth", "source_size", F.coalesce(F.least("limit", F.col("level") * F.col("weight")), F.col("limit")).alias("target"))


def shares(goal: DataFrame, slots: int = SLOTS) -> DataFrame:
    """goal with words (the target, rounded; sources of none are left out), low and high (its part of [0, 1)) and
    n_points. Each source's part is its share of ``slots``, and ``LEAST_SLOTS`` more (a quarter of that for sources of
    fewer words); there are as many points as all parts take."""
    goal = goal.withColumn("words", F.round("target").cast("long")).where("words > 0")
    total = goal.agg(F.sum("words").alias("all_words"), F.count("*").alias("n_sources"))  # one row
    goal = goal.crossJoin(total).withColumn("part", F.ceil(F.col("words") / F.col("all_words") * slots) + F.least(F.greatest("words", F.lit(LEAST_SLOTS // 4)), F.lit(LEAST_SLOTS)))
    goal = running(goal, [F.col("nth")], {"begin": F.col("part")})
    return goal.crossJoin(goal.agg(F.sum("part").alias("n_points"))).withColumn("low", F.col("begin") / F.col("n_points")).withColumn("high", (F.col("begin") + F.col("part")) / F.col("n_points"))


def schedule(goal: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row for each slot: slot, key, rank (from 0), n_slots and words (of its source). Points and shares meet in the
    cells of [0, 1) that both touch."""
    parts = shares(goal, slots).withColumn("n_cells", F.expr(f"n_points div {CELL_POINTS} + 1"))
    cell = lambda point: F.least(F.floor(point * F.col("n_cells")), F.col("n_cells") - 1)
    cells = parts.select("key", "words", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    points = parts.agg(F.max("n_points").alias("n_points"), F.max("n_cells").alias("n_cells")).where("n_points > 0")  # one row
    points = points.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_points - 1) div {RUN}")))).repartition("run")
    points = points.withColumn("slot", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("run") * RUN + RUN, F.col("n_points")) - 1)))
    points = points.withColumn("point", F.pmod(F.col("slot") * F.lit(GOLDEN), F.lit(1.0))).select("slot", "run", "point", cell(F.col("point")).alias("cell"))
    hit = points.join(cells, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    hit = materialise(hit.select("slot", "run", "key", "words"), "slots")
    runs = hit.groupBy("key", "run").agg(F.count("*").alias("n"))
    by_key = Window.partitionBy("key")
    runs = runs.select("key", "run", F.coalesce(F.sum("n").over(_before(by_key.orderBy("run"))), F.lit(0)).alias("earlier"), F.sum("n").over(by_key).alias("n_slots"))
    rank = F.col("earlier") + F.row_number().over(Window.partitionBy("key", "run").orderBy("slot")) - 1
    return hit.join(runs, ["key", "run"]).select("slot", "key", rank.alias("rank"), "n_slots", "words")


def placed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """sized, with begin and end: the document's words among its source's, shuffled. Sums of buckets first, then a
    running sum inside each, so that a source of any size isn't one task."""
    base = materialise(sized(docs, seed), "mixing")
    sums = base.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(_before(Window.partitionBy("key").orderBy("bucket"))), F.lit(0))).drop("words")
    inside = _before(Window.partitionBy("key", "bucket").orderBy("shuffle", "size"))
    begin = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return base.join(starts, ["key", "bucket"]).withColumn("begin", begin).withColumn("end", F.col("begin") + F.col("size"))


def takings(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """key, begin (of a document), slot, skip (words of the document before) and words: what each slot takes of each
    document. rows: key, begin, end, source_size, n_slots and words (of the source); plan: the schedule.

    A source of S words and n slots that take T words: the slot of rank r takes words floor(r T / n) to
    floor((r + 1) T / n) of the stream, and word p of the stream lies in the slot of rank ((p + 1) n - 1) div T.
    """
    times = F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / F.col("source_size")))  # whole and part passes
    rows = rows.where("end > begin and n_slots > 0").withColumn("shift", F.explode(times)).withColumn("shift", F.col("shift") * F.col("source_size"))
    rows = rows.withColumn("from", F.col("begin") + F.col("shift")).withColumn("to", F.least(F.col("end") + F.col("shift"), F.col("words"))).where("from < to")
    rank = lambda p: F.expr(f"(({p} + 1) * n_slots - 1) div words")
    rows = rows.withColumn("rank", F.explode(F.sequence(rank("`from`"), rank("`to` - 1"))))
    met = rows.join(plan.select("slot", "key", "rank"), ["key", "rank"])
    low, high = F.greatest("from", F.expr("rank * words div n_slots")), F.least("to", F.expr("(rank + 1) * words div n_slots"))
    return met.select("key", "begin", "slot", (low - F.col("from")).alias("skip"), (high - low).alias("words")).where("words > 0")


def planned(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), seed: int = 0, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """placed, with source_size, target, words and n_slots of each row's source, and the schedule; both written."""
    rows = placed(docs, seed)
    goal = materialise(targets(rows, share, most, weights), "targets")
    plan = materialise(schedule(goal, slots), "schedule")
    sources = goal.join(plan.groupBy("key").agg(F.max("n_slots").alias("n_slots"), F.max("words").alias("words")), "key", "left")
    return materialise(rows.join(materialise(sources, "sources").drop("nth"), "key"), "placed"), plan


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), seed: int = 0, slots: int = SLOTS) -> DataFrame:
    """doc_id, source, shuffle, begin, size, source_size, target, taken (words the mix takes of the document, repeats
    counted) and first_slot (its first place in the mix; null if it isn't taken).

    Words are runs of characters other than 0x20 and 0x09 to 0x0D; a null text has none. A null source is a source.
    Each source's taken words are its target, rounded. Sources without words have target 0, documents without words
    are taken 0 times; no document is taken over ``most`` times (rounded up). Repeated rows are documents of their own. The
    same rows give the same mix, however they are partitioned. An empty table gives an empty table. Columns other than
    doc_id, text and source aren't read.
    """
    rows, plan = planned(docs, share, most, weights, seed, slots)
    taken = takings(rows.select("key", "begin", "end", "source_size", "n_slots", "words"), plan).groupBy("key", "begin").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    # a document without words may begin where another does; these have places of their own, spread by their hash
    rows = rows.withColumn("at", F.when(F.col("size") > 0, F.col("begin")).otherwise(-1 - F.crc32("shuffle")))
    out = rows.join(taken.withColumnRenamed("begin", "at"), ["key", "at"], "left")
    return out.select("doc_id", "source", "shuffle", "begin", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def takes(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """mix_key, copies (rows with that key), copy (which of them), slot and words: each time that a row is taken, the slot
    in which it begins and the words it gives, all of them but for the last time. rows and plan as ``planned`` gives them."""
    equal = Window.partitionBy("shuffle")
    rows = rows.where("size > 0 and n_slots > 0").withColumn("copy", F.row_number().over(equal.orderBy("begin"))).withColumn("copies", F.count("*").over(equal))
    begins = F.transform(F.sequence(F.lit(0).cast("long"), F.expr("(words - 1) div source_size")), lambda n: F.col("begin") + n * F.col("source_size"))
    each = rows.withColumn("from", F.explode(begins)).where("from < words").withColumn("rank", F.expr("((from + 1) * n_slots - 1) div words"))
    given = F.least("size", F.col("words") - F.col("from"))
    each = each.select("key", "rank", F.col("shuffle").alias("mix_key"), "copies", "copy", "size", given.alias("given"))
    return each.join(plan.select("key", "rank", "slot"), ["key", "rank"]).select("mix_key", "copies", "copy", "slot", "size", F.col("given").alias("words"))


HELD = 64  # equal rows whose takes travel as one array


def mixed_corpus(docs: DataFrame, seed: int = 0, slots: int = SLOTS, **options) -> DataFrame:
    """The documents as the mix takes them, in the order of the schedule: a row for each time, with the first words (one
    space between) where the target ends inside the document. Documents that aren't taken go. Columns are kept. Each of
    several equal rows is taken for itself: they stand one after the other in their source's stream.

    Every partition is a stretch of the schedule and sorted by the slots in which its rows begin. So whoever writes the
    rows, or reads on in each partition, meets the sources as evenly as the schedule deals them out. Texts move twice:
    to their takes, and to their stretch.
    """
    found = materialise(takes(*planned(docs, seed=seed, slots=slots, **options)), "takes")
    keyed = docs.withColumn("mix_key", shuffle_of(seed))
    copy = F.row_number().over(Window.partitionBy("mix_key").orderBy("mix_key")).alias("mix_copy")
    few = found.where(F.col("copies") <= HELD).groupBy("mix_key").agg(F.collect_list(F.struct("copy", "slot", "size", "words")).alias("mix_takes"))
    held = keyed.join(few, "mix_key").select("*", copy)
    taken = held.withColumn("mix", F.explode(F.filter("mix_takes", lambda t: t["copy"] == F.col("mix_copy")))).drop("mix_takes")
    many = found.where(F.col("copies") > HELD).select("mix_key", F.col("copy").alias("mix_copy"), F.struct("copy", "slot", "size", "words").alias("mix"))
    if not many.isEmpty():  # so many equal rows each meet their own takes only
        held = keyed.join(many.select("mix_key").distinct(), "mix_key").select("*", copy)
        taken = taken.unionByName(held.join(many, ["mix_key", "mix_copy"]))
    first_words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("mix.words").cast("int")), " ")
    taken = taken.withColumn("text", F.when(F.col("mix.words") < F.col("mix.size"), first_words).otherwise(F.col("text"))).withColumn("mix_slot", F.col("mix.slot")).drop("mix")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # as many slots for each partition; there are ``slots`` and a few more for each source, which the last one takes
    stretch = F.least(F.expr(f"mix_slot * {tasks} div {slots}"), F.lit(tasks - 1)).cast("int")
    return taken.repartitionById(tasks, stretch).sortWithinPartitions("mix_slot", "mix_key", "mix_copy").select(*docs.columns)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")
