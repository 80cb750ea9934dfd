"""BM25 ranking of an index, with or without weights of fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.operators.index import Index

K1, B = 1.2, 0.75


def bm25(index: Index, terms: Sequence[str], k1: float = K1, b: float = B, weights: Mapping[str, float] | None = None) -> DataFrame:
    """(doc_id, score) of documents with any of the terms; a term counts once however often it is given.

    The filter on terms reaches the scan of the postings; documents' lengths join what is left. Texts of an index that
    is not stored are read once, before. With weights, a field's term frequency counts by its weight (1 where none is given).
    """
    index = index.narrowed(terms)
    n, average = index.size()
    wanted = F.col("term").isin(sorted(set(terms)))
    tf = F.sum("tf")
    if weights:
        weight = F.coalesce(F.create_map(*(x for f, w in weights.items() for x in (F.lit(f), F.lit(float(w)))))[F.col("field")], F.lit(1.0))
        tf = F.sum(F.col("tf") * weight)
    hits = index.postings.where(wanted).groupBy("term", "doc_id").agg(tf.alias("tf"))
    known = index.dictionary.where(wanted).select("term", F.col("doc_freq").alias("df")) if index.dictionary is not None else hits.groupBy("term").agg(F.count("*").alias("df"))
    freq = F.broadcast(known)  # a row for each query term at most
    rows = hits.join(freq, "term").join(index.doc_lengths(), "doc_id", "left")
    length = F.coalesce("length", F.lit(0)) / F.lit(float(max(average, 1.0)))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length))
    # Terms meet in any order, and a sum of doubles depends on it in its last digits: documents with the same words would
    # have scores that differ and places that no key decides. So what a document gets is added by size.
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(score)).alias("parts"))
    return parts.select("doc_id", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x).alias("score")).where("score > 0")


def top(scored: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Best first, ties by doc_id."""
    return scored.orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit)
