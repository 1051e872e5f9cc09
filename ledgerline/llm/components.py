"""Connected components of links, by alternating large and small stars.

Each round links a vertex's neighbours straight to the smallest of them, so paths shorten until every component is a
star around its smallest vertex. Minima combine on the map side before they are shuffled, and the join that hands
them on is one that adaptive execution can split, so a vertex of very many links isn't one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: u, v with u > v. Large: every greater neighbour of u goes to u's smallest; small: u and every smaller."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("least"))
    handed = both.join(least, "u")
    if large:
        out = handed.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = handed.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """id and root (the component's smallest id) of every vertex of links (a, b), except roots themselves.

    Nulls and loops don't link; repeated links count once. Each round is written to the shared folder.
    """
    links = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, before = materialise(links, "links"), None
    for _ in range(rounds):
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return links.select(F.col("u").alias("id"), F.col("v").alias("root"))
        links, before = materialise(_star(_star(links, True), False), "links"), now
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
