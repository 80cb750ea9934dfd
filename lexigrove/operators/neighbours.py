"""Nearest vectors by brute force, and quantisers that are calibrated on a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.functions import vectors
from lexigrove.sources import shared


#: Vectors and queries of a task, and pairs of them whose products it holds at once.
BLOCK_ROWS, BLOCK_QUERIES, BLOCK_PAIRS = 20_000, 8_192, 4_000_000


def nearest(rows: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, score) of the k best for one query; distances count as negative scores; ties by key."""
    score = vectors.METRICS[metric](F.col(column), vectors.literal(query))
    return rows.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def nearest_batch(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "vec_id", column: str = "embedding", blocks: int | None = None) -> DataFrame:
    """(query_id, key, score) of the k best for each query (columns query_id, q).

    Vectors fall into blocks of about BLOCK_ROWS by a hash and queries into blocks of BLOCK_QUERIES; a task takes one of
    each and keeps the k best of a query before they meet: what is sorted for a query is k times the number of blocks.
    Products of matrices tell which rows can be among the best, with a margin for rounding; these get the metric itself,
    its sums in the same order. Null vectors and keys, and components that are null, not finite or extreme, take the
    metric's expression pair by pair.
    """
    blocks = blocks or max(16, -(-rows.count() // BLOCK_ROWS))
    parts = max(1, -(-queries.count() // BLOCK_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.select(F.pmod(F.hash(key), F.lit(blocks)).alias("block"), F.col(key).alias("key"), F.col(column).alias("v"), (_plain(F.col(column)) & F.col(key).isNotNull()).alias("plain"))
    asked = queries.select("query_id", "q", _plain(F.col("q")).alias("plain"))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("key", rows.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _best(left, right, k, metric)

    left = asked.where("plain").select(F.pmod(F.hash("query_id"), F.lit(parts)).alias("part"), "query_id", "q").withColumn("block", every(blocks))
    right = dealt.where("plain").select("block", "key", "v").withColumn("part", every(parts))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(best, schema)
    for these, those in ((asked.where("plain"), dealt.where("not plain")), (asked.where("not plain"), dealt)):
        pairs = these.select("query_id", "q").withColumn("block", every(blocks)).join(those.select("block", "key", "v"), "block")
        found = found.unionByName(pairs.select("query_id", "key", vectors.METRICS[metric](F.col("v"), F.col("q")).alias("score")))
    # Spark cuts groups before the shuffle for a rank that a filter bounds by a small number.
    rank = F.row_number().over(W.partitionBy("query_id").orderBy((-F.col("score")).asc(), F.col("key").asc()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("key").alias(key), "score")


def _plain(v: Column) -> Column:
    """Whether no square or product of components can be lost or infinite."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ((x == 0) | F.abs(x).between(1e-30, 1e30))), F.lit(False))


def _added(products: np.ndarray) -> np.ndarray:
    """Sums of rows, component after component, as the metrics' expressions add them."""
    out = np.zeros(len(products))
    for column in products.T:
        out = out + column
    return out


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """What ``vectors.METRICS`` gives for plain vectors of the query's length."""
    if metric == "euclidean":
        return -np.sqrt(_added((x - q) * (x - q)))
    dots = _added(x * q)
    if metric == "dot":
        return dots
    both = np.sqrt(_added(x * x)) * np.sqrt(_added((q * q)[None, :]))
    return np.divide(dots, both, out=np.zeros(len(x)), where=both > 0)


def _best(asked: pd.DataFrame, rows: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    """The k best rows of a block for each query of a block; all vectors are plain."""
    out: list[tuple] = []
    rows = rows.sort_values("key", ignore_index=True)  # so places go by key
    keys, sizes, asked_sizes = rows["key"], rows["v"].map(len).to_numpy(int), asked["q"].map(len).to_numpy(int)
    for n in np.unique(asked_sizes):
        ids, q = asked["query_id"][asked_sizes == n].tolist(), np.stack(asked["q"][asked_sizes == n].to_numpy()).astype(float)
        other, at = np.flatnonzero(sizes != n)[:k], np.flatnonzero(sizes == n)  # those of another length are all alike
        x = np.stack(rows["v"].iloc[at].to_numpy()).astype(float) if len(at) else np.zeros((0, n))
        lengths, q_lengths = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
        longest = lengths.max(initial=0.0)
        if metric == "cosine":
            near, margin = (x / np.where(lengths > 0, lengths, 1.0)[:, None]).T, np.full(len(q), 1e-11)
            wanted = q / np.where(q_lengths > 0, q_lengths, 1.0)[:, None]
        else:
            near, wanted, margin = x.T, q, 1e-11 * (q_lengths * longest if metric == "dot" else (q_lengths + longest) ** 2)
        step = max(1, BLOCK_PAIRS // max(1, len(at)))
        for first in range(0, len(q), step):
            about = wanted[first : first + step] @ near
            if metric == "euclidean":
                about = 2 * about - (lengths**2)[None, :]  # the query's own square is the same for all
            for i, row in enumerate(about, first):
                able = np.flatnonzero(row >= np.partition(row, -k)[-k] - 2 * margin[i]) if len(row) > k else np.arange(len(row))
                exact = np.concatenate([_scores(x[able], q[i], metric), np.full(len(other), float("-inf") if metric == "euclidean" else 0.0)])
                place = np.concatenate([at[able], other])
                for j in np.lexsort((place, -exact))[:k]:
                    out.append((ids[i], keys.iloc[place[j]], exact[j]))
    return pd.DataFrame(out, columns=["query_id", "key", "score"])


def scalar_ranges(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: low and span of each component over all vectors; a span is at least a float's epsilon."""
    each = rows.select(F.posexplode(F.col(column).cast("array<double>")).alias("pos", "x"))
    ends = each.groupBy("pos").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    ends = ends.select("pos", "low", F.greatest(F.col("high") - F.col("low"), F.lit(1.1920928955078125e-07)).alias("span"))
    sorted_rows = F.array_sort(F.collect_list(F.struct("pos", "low", "span")))
    return ends.agg(sorted_rows.alias("r")).select(F.col("r.low").alias("low"), F.col("r.span").alias("span"))


def scalar_coded(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``rows`` with ``code``, ``low`` and ``span`` of the scalar quantiser calibrated on them."""
    low, span = scalar_ranges(rows, column).first()
    low, span = vectors.literal(low), vectors.literal(span)
    return rows.withColumn("code", vectors.scalar_code(F.col(column), low, span)).withColumn("low", low).withColumn("span", span)


class ScalarQuantiser:
    """One byte for each component, on the range that it has over all vectors."""

    name = "scalar-int8"

    def __init__(self, dimensions: int) -> None:
        self.code_bytes = dimensions
        self.low = self.span = None

    def calibrate(self, rows: DataFrame, key: str = "vec_id", column: str = "embedding") -> ScalarQuantiser:
        low, span = scalar_ranges(rows, column).first()
        self.low, self.span = vectors.literal(low), vectors.literal(span)
        return self

    def code(self, column: Column) -> Column:
        return vectors.scalar_code(column, self.low, self.span)

    def distance(self, query: Sequence[float], code: Column) -> Column:
        """Column: Euclidean distance of a query to what a code stands for."""
        return vectors.euclidean(vectors.scalar_value(code, self.low, self.span), vectors.literal(query))


class BinaryQuantiser:
    """One bit for each component, its sign; nothing to calibrate."""

    name = "binary"

    def __init__(self, dimensions: int) -> None:
        self.code_bytes = -(-dimensions // 8)

    def calibrate(self, rows: DataFrame, key: str = "vec_id", column: str = "embedding") -> BinaryQuantiser:
        return self

    def code(self, column: Column) -> Column:
        return vectors.sign_bits(column)

    def distance(self, query: Sequence[float], code: Column) -> Column:
        """Column: -1 for equal codes, 1 for opposite ones."""
        return vectors.sign_distance(code, vectors.sign_bits(vectors.literal(query)))


class ProductQuantiser:
    """Sub-vectors coded by the nearest of at most ``codes`` centres of their sub-space.

    Lloyd's steps run over all rows: a task assigns its vectors and sums them by centre, Spark adds the
    sums, and the driver gets one row for each sub-space and centre. Centres begin at evenly strided
    vectors; the first of equally near centres counts; a centre without vectors stays. Dimensions that parts do not
    divide are filled up with zeros. Vectors that are null, of other dimensions, or hold null or non-finite components
    take no part: their code and distance are null.
    """

    name = "product"

    def __init__(self, dimensions: int, parts: int | None = None, codes: int = 256, rounds: int = 8) -> None:
        self.parts = min(8, max(1, dimensions)) if parts is None else parts
        self.dimensions, self.width, self.codes, self.rounds = dimensions, -(-dimensions // self.parts), codes, rounds
        self.code_bytes = self.parts
        self.centres = np.zeros((self.parts, 0, self.width))

    def _valid(self, v: Column) -> Column:
        return F.coalesce((F.size(v) == self.dimensions) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))

    def _filled(self, rows: np.ndarray) -> np.ndarray:
        return np.pad(rows, ((0, 0), (0, self.parts * self.width - rows.shape[1])))

    def calibrate(self, rows: DataFrame, key: str = "vec_id", column: str = "embedding") -> ProductQuantiser:
        rows = rows.where(self._valid(F.col(column)))
        n = rows.count()
        k = min(self.codes, n)
        if not k:
            return self
        stride = max(1, n // k)
        # Ids of a sorted table number the rows of each part of it; the parts' sizes give the rest of the place.
        ordered = rows.select(key, column).orderBy(key, column).select(F.col(column), F.monotonically_increasing_id().alias("id"))
        ordered = shared.stored(ordered, "sorted-vectors")
        part, at = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
        sizes = sorted((r["part"], r["count"]) for r in ordered.groupBy(part.alias("part")).count().collect())
        before = dict(zip((p for p, _ in sizes), np.cumsum([0, *(c for _, c in sizes)]).tolist(), strict=False))
        place = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[part] + at
        picks = ordered.select(place.alias("place"), column).where((F.col("place") % stride == 0) & (F.col("place") < stride * k))
        firsts = [r[column] for r in sorted(picks.collect(), key=lambda r: r["place"])]
        self.centres = self._filled(np.array(firsts, float)).reshape(len(firsts), self.parts, self.width).transpose(1, 0, 2)
        filled = self._filled
        for _ in range(self.rounds):
            centres, width = self.centres, self.width

            def sums(frames: Iterator[pd.DataFrame], centres=centres, width=width) -> Iterator[pd.DataFrame]:
                total, count = np.zeros_like(centres), np.zeros(centres.shape[:2])
                for frame in frames:
                    if len(frame):
                        x = filled(np.stack(frame[column].to_numpy()).astype(float))
                        for p, c in enumerate(centres):
                            part = x[:, p * width : (p + 1) * width]
                            near = ((c**2).sum(1) - 2 * part @ c.T).argmin(1)
                            np.add.at(total[p], near, part)
                            count[p] += np.bincount(near, minlength=len(c))
                at = np.argwhere(count > 0)
                if len(at):  # Arrow takes no column without a list for lists: a split can be without vectors
                    yield pd.DataFrame({"p": at[:, 0], "c": at[:, 1], "n": count[at[:, 0], at[:, 1]], "s": [total[p, c].tolist() for p, c in at]})

            parts = rows.select(column).mapInPandas(sums, "p int, c int, n double, s array<double>")
            each = parts.select("p", "c", "n", F.posexplode("s").alias("pos", "s")).groupBy("p", "c", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
            moved = centres.copy()
            for r in each.collect():  # parts x centres x width numbers
                moved[r["p"], r["c"], r["pos"]] = r["s"] / r["n"]
            self.centres = moved
        return self

    def code(self, column: Column) -> Column:
        """Column: the number of the nearest centre in each sub-space."""
        centres, width, filled = self.centres, self.width, self._filled
        if not centres.shape[1]:
            return F.lit(None).cast("array<int>")

        @F.pandas_udf("array<int>")
        def encode(v: pd.Series) -> pd.Series:
            there = np.flatnonzero(v.notna().to_numpy())
            out = np.full(len(v), None, object)
            if len(there):
                x = filled(np.stack(v.iloc[there].to_numpy()).astype(float))
                near = [((c**2).sum(1) - 2 * x[:, p * width : (p + 1) * width] @ c.T).argmin(1) for p, c in enumerate(centres)]
                for i, row in zip(there, np.stack(near, 1).astype(np.int32), strict=True):
                    out[i] = row
            return pd.Series(out, dtype=object)

        return encode(F.when(self._valid(column), column))

    def distance(self, query: Sequence[float], code: Column) -> Column:
        """Column: squared distance of a query to what a code stands for, from a table of look-ups."""
        if not self.centres.shape[1]:
            return F.lit(None).cast("double")
        q = self._filled(np.asarray(query, float)[None, :]).reshape(self.parts, 1, self.width)
        table = ((q - self.centres) ** 2).sum(2)
        total = F.lit(0.0)
        for p in range(self.parts):
            total = total + F.element_at(vectors.literal(table[p]), F.element_at(code, p + 1) + 1)
        return F.when(code.isNotNull(), total)  # a null place in an array of constants does not give null by itself


#: Quantisers by name; all have ``calibrate(rows)``, ``code(column)``, ``distance(query, code)`` and ``code_bytes``.
QUANTISERS = {q.name: q for q in (ScalarQuantiser, ProductQuantiser, BinaryQuantiser)}


def kmeans(rows: DataFrame, k: int, dimensions: int, rounds: int = 8, key: str = "vec_id", column: str = "embedding") -> np.ndarray:
    """(k, dimensions): centres of all vectors by Lloyd's steps, as the product quantiser takes them in one sub-space."""
    return ProductQuantiser(dimensions, 1, k, rounds).calibrate(rows, key, column).centres[0]
