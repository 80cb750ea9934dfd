"""Connected components of links between documents, by alternating large-star and small-star steps.

The algorithm is that of Kiveris et al. (2014). Links stay in Spark: each step is a group and a join,
each round ends in a table in the shared folder, and a hub with very many links is summed before the
shuffle (only the least neighbour counts) and split by Spark's skew join afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm import common
from lexigrove.sources import shared

MOST_ROUNDS = 60
LEAST_FILES, FILE_LINKS = 8, 500_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links (a, b) with a > b, moved to the least neighbour of each document.

    Large: at each document, its larger neighbours are linked with its least one (itself included).
    Small: its smaller neighbours, and itself, are linked with the least of them.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        out = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    else:
        down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("low"))
        moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("low").alias("b"))
        out = moved.union(least.select(F.col("u").alias("a"), F.col("low").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(node, component): for every document with a link, the least id that it can be reached from.

    Ends when a round changes no link, that is when the links form stars around least ids. A round makes no
    more links than there were, so their number says how many files are enough for them.
    """
    edges = links.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b"))
    edges = common.stored(edges.where(F.col("a") != F.col("b")).distinct(), "links")
    sums = F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.col("b").cast("decimal(38,0)"))
    before = edges.agg(*sums).first()
    for _ in range(MOST_ROUNDS if before["n"] else 0):
        last, edges = edges, common.stored(_star(_star(edges, large=True), large=False).coalesce(LEAST_FILES + before["n"] // FILE_LINKS), "links")
        shared.drop(last)  # what is left reads the new table only
        now = edges.agg(*sums).first()
        if now == before:
            break
        before = now
    else:
        if before["n"]:
            raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
