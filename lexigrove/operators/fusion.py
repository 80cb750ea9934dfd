"""Fusion of ranked lists, and normalised scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrove.sources import shared

K = 60.0


def ranked(scored: DataFrame, by: str | None = None, most: int | None = None) -> DataFrame:
    """``scored`` (doc_id, score) with rank from 1, best first, ties by doc_id; inside ``by`` if given.

    With ``most``, only so many ranks, which are cut before rows meet. Without either, all rows are ranked over
    ranges of scores: ranges are counted, and a running sum over the ranges places each, so no task sorts everything.
    """
    order = [F.desc("score"), F.col("doc_id").asc()]
    if by:
        out = scored.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)))
        return out if most is None else out.where(F.col("rank") <= most)
    if most is not None:
        top = scored.orderBy(*order).limit(most)  # ``most`` rows from here on
        return top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
    rows = shared.stored(scored.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("__before"))  # a row for each range
    out = rows.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    return out.withColumn("rank", (F.col("__before") + place + 1).cast("int")).drop("__part", "__before", "__at")


def reciprocal_ranks(first: DataFrame, second: DataFrame, weights: tuple[float, float] = (1.0, 1.0), k: float = K, by: str | None = None) -> DataFrame:
    """(doc_id, score): each list adds its weight, by share, over k + rank.

    ``first`` and ``second`` have doc_id and rank, and ``by`` for many queries at once. A list of weight
    0 still contributes its documents, with score 0. Weights that sum to 0 give an empty result.
    """
    total = sum(weights)
    keys = [by, "doc_id"] if by else ["doc_id"]
    part = lambda df, w: df.select(*keys, (F.lit(w / total if total else 0.0) / (F.lit(k) + F.col("rank"))).alias("score"))
    both = part(first, weights[0]).unionByName(part(second, weights[1]))
    fused = both.groupBy(*keys).agg(F.sum("score").alias("score"))
    return fused if abs(total) > 1e-12 else fused.where(F.lit(False))


def fused(keyword: DataFrame, vector: DataFrame, ratio: float = 0.5, k: float = K, by: str | None = None) -> DataFrame:
    """Reciprocal ranks with the share ``ratio``, cut to 0 to 1, for the vector list."""
    r = min(1.0, max(0.0, ratio))
    return reciprocal_ranks(keyword, vector, (1 - r, r), k, by)


def normalised(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Scores moved to 0 to 1; equal scores stay as they are."""
    if by:
        low, high = F.min("score").over(W.partitionBy(by)), F.max("score").over(W.partitionBy(by))
        return scored.withColumn("score", F.when(high - low > 2.220446049250313e-16, (F.col("score") - low) / (high - low)).otherwise(F.col("score")))
    ends = scored.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    if ends["low"] is None or ends["high"] - ends["low"] <= 2.220446049250313e-16:
        return scored
    return scored.withColumn("score", (F.col("score") - ends["low"]) / (ends["high"] - ends["low"]))
