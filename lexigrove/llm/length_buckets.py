"""Packing documents into token-budget batches by optimal length buckets (operator 6).

Sequences of a batch are padded to the length of their bucket. A dynamic programme over the histogram
of all lengths chooses the bucket boundaries that minimise padding over the whole corpus; the last
boundary is the greatest length, so nothing is cut. Inside a bucket, batches take as many sequences as
fit the budget of tokens, one at least.

A sequence's place in its bucket is a row number over a hash of its id, length and place in the table of
lengths, computed in two steps so that no bucket is sorted in one task: hash ranges are counted, a running
sum over the ranges places each, and rows are numbered inside their range. The number of ranges follows
the number of rows, and rows with one id, or none, spread over all of them.

Edge cases: a null or empty text is a sequence of one token, its end. Repeated rows are sequences of
their own; they tie and are interchangeable. Without rows the result is empty. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrove.llm import common

BUCKETS, BUDGET = 16, 65_536
RANGE_ROWS = 20_000  # rows of a hash range, about


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (greatest lengths) of at most ``buckets`` buckets with the least total padding.

    lengths are distinct and ascend. With P_j the padding-free sums, the cost of a bucket that ends at
    length j and begins after i is L_j * (N_j - N_i) - (T_j - T_i): for fixed i a line in L_j. So each
    layer of the programme is a lower envelope of lines whose slopes fall as L_j grows, which one
    pointer walks, and a layer takes linear time.
    """
    m = len(lengths)
    if not m:
        return []
    n = [0, *np.cumsum(counts).tolist()]
    t = [0, *np.cumsum(counts * lengths).tolist()]
    length = [int(x) for x in lengths]
    best = [0] + [length[j - 1] * n[j] - t[j] for j in range(1, m + 1)]
    choices: list[list[int]] = []
    for _ in range(min(buckets, m) - 1):
        now, choice = best.copy(), [-1] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        first = 0
        for j in range(1, m + 1):
            i = j - 1
            line = (-n[i], best[i] + t[i], i)
            while len(hull) - first >= 2:
                (s1, b1, _), (s2, b2, _) = hull[-2], hull[-1]
                if (line[1] - b1) * (s1 - s2) <= (b2 - b1) * (s1 - line[0]):
                    hull.pop()
                else:
                    break
            hull.append(line)
            x = length[j - 1]
            while len(hull) - first >= 2 and hull[first + 1][0] * x + hull[first + 1][1] <= hull[first][0] * x + hull[first][1]:
                first += 1
            cost = hull[first][0] * x + hull[first][1] + x * n[j] - t[j]
            if cost < now[j]:
                now[j], choice[j] = cost, hull[first][2]
        best = now
        choices.append(choice)
    out, j = [], m
    for choice in reversed(choices):
        if j <= 0:
            break
        if choice[j] < 0:
            continue
        out.append(length[j - 1])
        j = choice[j]
    if j > 0:
        out.append(length[j - 1])
    return sorted(out)


def padding(lengths: np.ndarray, counts: np.ndarray, boundaries: list[int]) -> int:
    """Total padding of a histogram under given boundaries."""
    edges = np.array(boundaries, np.int64)
    return int(((edges[np.searchsorted(edges, lengths)] - lengths) * counts).sum())


def sequence_length(text: Column) -> Column:
    """Column: tokens of a sequence, here its words and an end."""
    return common.word_count(text) + 1


def packed(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket (from 0), bucket_tokens (its padded length), batch (from 0 in its bucket),
    slot (from 0 in its batch) of every row.

    ``length`` is a Column over ``docs``; by default words and an end. The histogram that reaches the
    driver has a row for each distinct length.
    """
    tokens = sequence_length(F.col("text").cast("string")) if length is None else length
    rows = common.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens.cast("long").alias("n_tokens"), F.monotonically_increasing_id().alias("row")), "lengths")
    histogram = rows.groupBy("n_tokens").count().orderBy("n_tokens").collect()
    lengths = np.array([r["n_tokens"] for r in histogram], np.int64)
    counts = np.array([r["count"] for r in histogram], np.int64)
    edges = optimal_boundaries(lengths, counts, buckets)

    bucket = F.lit(0)
    for i, edge in enumerate(edges[:-1]):
        bucket = F.when(F.col("n_tokens") > edge, F.lit(i + 1)).otherwise(bucket) if i == 0 else F.when(F.col("n_tokens") > edge, i + 1).otherwise(bucket)
    padded = F.element_at(F.array(*(F.lit(e).cast("long") for e in edges or [1])), F.col("bucket") + 1)
    ranges = max(1, -(-int(counts.sum()) // RANGE_ROWS))
    key = F.pmod(F.xxhash64("doc_id", "n_tokens", "row"), F.lit(1 << 40))
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("key", key)
    rows = rows.withColumn("part", F.floor(F.col("key") * F.lit(ranges) / F.lit(1 << 40)).cast("int"))
    sums = rows.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    running = W.partitionBy("bucket").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("bucket", "part", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("bucket", "part").orderBy("key", "row")) - 1
    rows = rows.withColumn("inside", inside).join(sums, ["bucket", "part"])
    place = F.col("before") + F.col("inside")
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_tokens"))).cast("long")
    rows = rows.withColumn("bucket_tokens", padded).withColumn("place", place).withColumn("per_batch", per_batch)
    return rows.select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens",
        F.floor(F.col("place") / F.col("per_batch")).cast("long").alias("batch"), (F.col("place") % F.col("per_batch")).cast("int").alias("slot"),
    )


def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))
