"""A corpus from raw documents to training batches: filter, deduplicate, mix and pack.

Each stage gets all rows that its predecessor kept and decides on them with one operator. Between stages
the rows are a Parquet table. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import common, language_id, length_buckets, near_duplicates, quality_rules, source_mix

#: A document whose best language has less than this share of the posterior is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejects what fails the base test or is more likely bad than good."""
    return quality_rules.passed(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: rejects texts without a language, or of none in particular.

    The model learns from the languages of the stage's own rows. If none of them says its language, only texts
    without a letter are rejected.
    """
    model = language_id.fit(docs, F.lit(False))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    column = "__language"
    while column in docs.columns:
        column += "_"
    told = language_id.predict(docs, model, column)
    sure = (F.col(f"{column}.lang_pred") != language_id.NONE) & (F.col(f"{column}.score") >= LEAST_LANGUAGE_SCORE)
    return told.where(sure).drop(column)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-duplicates, five words and a similarity of 0.8: the least id of each group stays.

    Of rows that repeat an id, the one stays whose text comes first in the order of a hash, then of the text.
    Rows without an id are not compared and stay.
    """
    kept = near_duplicates.near_duplicates(docs, width=5, percent=80).where("kept and doc_id is not null")
    kept = common.stored(kept.groupBy("doc_id").agg(F.count("*").alias("rows")), "kept-ids")
    out = docs.join(kept.where("rows = 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    several = kept.where("rows > 1").select("doc_id")
    if not several.isEmpty():
        some = docs.join(several, "doc_id", "left_semi").select(docs.columns)
        struct = F.struct(F.xxhash64("text"), *(F.col(c) for c, kind in docs.dtypes if not kind.startswith("map")))
        first = some.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), struct).alias("row"))
        out = out.unionByName(first.select("row.*"))
    return out.unionByName(docs.where(F.col("doc_id").isNull()))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Source mix: every document as many times as the mix takes it, which may be none."""
    return source_mix.taken(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets: the batch and slot of every row."""
    return length_buckets.packed(docs)


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("near-dedup", near_dedup),
    ("source mix", mix),
    ("packing", pack),
]

#: SQL cannot express the models and the components of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
