"""Quality classifier learnt from weak labels (operator 2).

Overlapping heuristic labellers vote on every document; expectation-maximisation over all documents
estimates their accuracies, and the posterior of good is a soft label. A linear scorer over hashed
features then learns the labels, so that it also judges texts on which the labellers abstain.

Features: single words and pairs of neighbouring words, A-Z lower-cased, the shape of each word (case,
digits, symbols) and its last character, hashed to DIMENSIONS weights; the values are counts by the root
of their sum of squares. The scorer is fitted on at most about FIT_DOCS documents, half of them by a hash
of id and text among likely bad ones and half among the others, weighted back to the corpus; labels,
accuracies and scores cover all documents.

Edge cases: a null or empty text has no features and is rejected. Without rows, or with one kind of label
only, the scorer says what the labels say. Repeated rows are judged each. Only ``doc_id`` and ``text`` are
read, so other columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import common, quality_rules
from lexigrove.llm.weak_labels import LabelModel

DIMENSIONS = 1 << 16
FIT_DOCS = 12_000
EPOCHS, RATE, DECAY = 6, 2.0, 1e-6
_U = np.uint64


def labellers() -> list[quality_rules.Rule]:
    """The rules of operator 5 and one more view of capitals, so that each bad way is seen by several."""
    n, c = F.col("n_words"), F.col
    return [*quality_rules.standard_rules(), quality_rules.Rule("few_capitals", c("n_upper") * 2 > n, c("n_upper") * 10 <= n)]


_KIND = np.full(256, 3, np.uint64)
_KIND[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of all rows, one after the other; how many each row has)."""
    words, counts = common.split_words(data, offsets)
    part = data[int(offsets[0]) : int(offsets[-1])]
    blank = common.is_blank(part)
    edge = np.zeros(len(part) + 1, bool)
    edge[offsets - offsets[0]] = True
    starts = np.flatnonzero(~blank & (edge[:-1] | np.concatenate(([True], blank[:-1])))) if len(part) else np.empty(0, np.int64)
    ends = np.flatnonzero(~blank & (edge[1:] | np.concatenate((blank[1:], [True])))) if len(part) else np.empty(0, np.int64)
    kinds = _KIND[part]
    shape = kinds[starts] * _U(64) + kinds[ends] * _U(16)
    if len(starts):
        upper = np.add.reduceat((kinds == 1).astype(np.int64), starts)
        shape += np.minimum(upper, 3).astype(_U) * _U(4) + np.minimum(np.add.reduceat((kinds == 3).astype(np.int64) & ~blank, starts), 3).astype(_U)
    last = part[ends].astype(_U) if len(ends) else np.empty(0, _U)
    row = np.repeat(np.arange(len(counts)), counts)
    pair = np.zeros_like(words)
    pair[1:] = np.where(row[1:] == row[:-1], words[1:] * _U(3) + words[:-1], words[1:])
    pair[:1] = words[:1]
    every = np.stack([words, common.mix(pair ^ _U(0x1D)), common.mix(shape + _U(0x5A5A00)), common.mix(last + _U(0xA5A50000))], axis=1)
    return (every.reshape(-1) % _U(DIMENSIONS)).astype(np.int64), counts * every.shape[1]


def _vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of all rows; the values of a row have a sum of squares of 1."""
    flat, sizes = features(data, offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    kinds, n = np.unique(row * DIMENSIONS + flat, return_counts=True)
    row, feature, value = kinds // DIMENSIONS, kinds % DIMENSIONS, np.sqrt(n)
    norm = np.sqrt(np.bincount(row, value**2, minlength=len(sizes)))
    return row, feature, value / np.maximum(norm, 1e-12)[row]


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by averaged stochastic steps (AdaGrad), in a fixed order."""
    w, bias, total, total_bias = np.zeros(DIMENSIONS), 0.0, np.zeros(DIMENSIONS), 0.0
    squares, bias_square = np.full(DIMENSIONS, 1e-2), 1e-2
    order = np.random.default_rng(7)
    for epoch in range(EPOCHS):
        for i in order.permutation(len(rows)):
            feature, value = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[feature] @ value + bias, -30, 30)))
            slope = (p - labels[i]) * weights[i]
            g = slope * value + DECAY * w[feature]
            squares[feature] += g * g
            w[feature] -= RATE * 0.1 * g / np.sqrt(squares[feature])
            bias_square += slope * slope
            bias -= RATE * 0.1 * slope / np.sqrt(bias_square)
        if epoch >= EPOCHS // 2:
            total += w
            total_bias += bias
    n = EPOCHS - EPOCHS // 2
    return total / n, total_bias / n


def fit_scorer(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[np.ndarray, float]:
    """Weights and bias, fitted in one task on a bounded sample of labelled rows.

    ``labels``: row_key and quality. Likely bad documents are rarer, so they are sampled at a higher
    rate, and each row of the sample weighs as many rows as it stands for; rows that are alike are one.
    """
    sizes = {r["bad"]: r["count"] for r in labels.groupBy((F.col("quality") < 0.5).alias("bad")).count().collect()}
    if not sizes:
        return np.zeros(DIMENSIONS), 0.0
    rate = {bad: min(1.0, fit_docs / 2 / max(1, sizes.get(bad, 0))) for bad in (True, False)}
    bad = F.col("quality") < 0.5
    point = F.pmod(F.xxhash64("row_key", F.lit(11)), F.lit(1 << 52)) / float(1 << 52)
    chosen = labels.where(point < F.when(bad, rate[True]).otherwise(rate[False]))
    chosen = chosen.select("row_key", "quality", F.when(bad, 1 / rate[True]).otherwise(1 / rate[False]).alias("weight")).dropDuplicates(["row_key"])
    rows = docs.select(quality_rules.row_key().alias("row_key"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "row_key")  # fit_docs rows, about
    rows = rows.dropDuplicates(["row_key"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.short_batches(batches, 1):
            row, feature, value = _vectors(*common.text_buffer(batch.column(1)))
            edges = np.searchsorted(row, np.arange(len(batch) + 1))
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), cut(feature.astype(np.int32)), cut(value.astype(np.float32))],
                ["row_key", "quality", "weight", "feature", "value"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, weights = [], [], []
        for batch in batches:
            t = batch.to_pydict()
            rows += [(np.frombuffer(f, np.int32), np.frombuffer(v, np.float32)) for f, v in zip(t["feature"], t["value"], strict=True)]
            labels += t["quality"]
            weights += t["weight"]
        scale = len(weights) / max(sum(weights), 1e-12)
        w, bias = fit_linear(rows, np.array(labels), np.array(weights) * scale)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["w", "bias"])

    sample = rows.select("row_key", "text", "quality", "weight").mapInArrow(extract, "row_key long, quality double, weight double, feature binary, value binary")
    found = sample.repartition(1).sortWithinPartitions("row_key").mapInArrow(learn, "w binary, bias double").first()
    return np.frombuffer(bytes(found["w"])), float(found["bias"])


def classified(docs: DataFrame, keep_at: float = 0.5) -> tuple[DataFrame, LabelModel]:
    """doc_id, n_words, score (of the linear scorer) and kept; the label model.

    The text is read three times: for the labellers' counts, for the sample, and to score.
    """
    spark = docs.sparkSession
    labels, model = quality_rules.judged(docs, labellers())
    w, bias = fit_scorer(docs, labels.select("row_key", "quality"))
    shared = spark.sparkContext.broadcast((w, bias))  # DIMENSIONS numbers
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, offset = shared.value
        for batch in common.short_batches(batches, 1):
            data, offsets = common.text_buffer(batch.column(1))
            row, feature, value = _vectors(data, offsets)
            logit = np.bincount(row, weights[feature] * value, minlength=len(batch)) + offset
            n_words = common.split_words(data, offsets)[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(np.where(n_words > 0, 1 / (1 + np.exp(-np.clip(logit, -700, 700))), 0.0))], ["doc_id", "n_words", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, n_words long, score double")
    return out.withColumn("kept", (F.col("n_words") > 0) & (F.col("score") >= keep_at)), model


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(common.table(spark, sf_dir, "documents"))[0]
