"""Mixing sources to target weights by Pareto order sampling (operator 8).

Sizes are numbers of words. Each source gets a target: its weighted share of all words, at most
``most`` times its own size, the excess shared out again by weight. A source whose target is r times
its size takes floor(r) certain copies of every document. The rest of its target is filled by a
sample of fixed size (in words) with unequal inclusion probabilities: documents are ranked by random
odds divided by inclusion odds (Rosen, 1997) and taken in that order until the words are there.

The ranking never sorts a source in one task. Documents fall into buckets by the logarithm of their rank;
words of the buckets are summed before the shuffle, a running sum over buckets places each bucket, and
only then rows are ranked inside their bucket. The logarithm of a rank is that of random odds moved by a
constant, and random odds' logarithm has no density above 1/4, so whatever the inclusion odds are, a
bucket is expected to hold no more than one in 4 * STEPS rows of its source. Sources that need no sample are
not ranked.

Edge cases: a null text has size 0, and a document of size 0 takes no words; a null source is a
source of its own, last in order. Random odds depend on id and text, so rows without an id are drawn
each by itself. Repeated rows are documents of their own and tie, in which case they are interchangeable.
Without rows the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrove.llm import common

QUERY_WEIGHTS = (5, 2, 1)
MOST = 3
STEPS = 1024  # buckets for each unit of the logarithm of the rank
SEED = "mix"
_LEAST = 1e-9


def source_targets(sizes: DataFrame, weights=QUERY_WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each source: src (its key), source_size, tilted_size, target.

    Weights go to the sources by code point, null last, repeating. Capped shares have a closed form:
    with sources in the order of cap / weight, the level at which source i would be the first one
    below its cap is (all words - caps before i) / (weights from i on), and the highest such level
    is the true one. The windows run over sources, not documents.
    """
    by = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("tilt")).alias("tilted_size"))
    pick = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), ((F.row_number().over(W.orderBy("src")) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", pick).withColumn("cap", F.col("source_size") * most)
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("src").asc())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    everything = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by = by.withColumn("all_words", F.sum("source_size").over(everything))
    by = by.withColumn("level", (F.col("all_words") - before) / onward)
    by = by.withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight")))
    return by.select("src", "source_size", "tilted_size", "target")


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Column: a number in (0, 1) that depends on id, text and seed only."""
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), own).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def tilt_of(size: Column) -> Column:
    """Column: integer weight of a document's inclusion odds; long documents weigh less a word.

    It falls with the fourth root of the size, so that a partly taken source is filled by more, and
    more different, documents, and a single long one seldom decides how near the target is met.
    """
    return F.floor(F.lit(65536.0) / F.sqrt(F.sqrt(F.lit(1.0) + size)))


def mixed(docs: DataFrame, weights=QUERY_WEIGHTS, most: int = MOST, seed: str = SEED, row_key: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of every document.

    ``row_key``, a Column over ``docs``, is carried along as ``row_key`` if it is given.
    """
    src = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col("source").cast("string")))
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    carried = [] if row_key is None else [row_key.alias("row_key")]
    sizes = docs.select(doc_id.alias("doc_id"), src.alias("src"), common.word_count(text).alias("size"), uniform(doc_id, text, seed).alias("u"), *carried)
    sizes = common.stored(sizes.withColumn("tilt", tilt_of(F.col("size"))), "mix-sizes")
    targets = common.stored(source_targets(sizes, weights, most), "mix-targets")

    whole = F.floor(F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)))
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    share = F.col("rest") * F.col("tilt") / F.nullif(F.col("tilted_size"), F.lit(0))
    inclusion = F.greatest(F.lit(_LEAST), F.least(F.lit(1 - _LEAST), F.coalesce(share, F.lit(0.0))))
    rank = (F.col("u") / (1.0 - F.col("u"))) * ((1.0 - F.col("inclusion")) / F.col("inclusion"))
    rows = sizes.join(targets, "src")
    ranked = rows.where("rest > 0").withColumn("inclusion", inclusion).withColumn("rank", rank)
    ranked = ranked.withColumn("bucket", F.floor(F.log("rank") * STEPS))

    sums = ranked.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    running = W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("src", "bucket", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("before"))
    inside = W.partitionBy("src", "bucket").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = ranked.withColumn("upto", F.sum("size").over(inside)).join(sums, ["src", "bucket"])
    # A document whose middle word lies within the rest is in: the sum ends within half a document of it.
    chosen = F.col("before") + F.col("upto") - F.col("size") / 2.0 <= F.col("rest")
    names = ["doc_id", "size", "source_size", "target", "whole", *(["row_key"] if carried else [])]
    out = ranked.select(*names, chosen.cast("long").alias("more")).unionByName(rows.where("not rest > 0").select(*names, F.lit(0).cast("long").alias("more")))
    copies = (F.col("whole") + F.col("more")).cast("long")
    return out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("whole", "more")


def taken(docs: DataFrame, weights=QUERY_WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it.

    Rows are told apart by a hash of all their columns (but maps, which have none), so rows without an id, or with
    one id and different texts, get what is theirs. Rows that are alike share their copies.
    """
    column = "__mix"
    while any(c.startswith(column) for c in docs.columns):
        column += "_"
    key = F.xxhash64(*(F.col(c) for c, kind in docs.dtypes if not kind.startswith("map")))
    by_key = mixed(docs, weights, most, seed, key).groupBy("doc_id", "row_key").agg(F.sum("copies").alias(column), F.count("*").alias(f"{column}rows"))
    by_key = common.stored(by_key.withColumnRenamed("doc_id", f"{column}id").withColumnRenamed("row_key", f"{column}key").where(F.col(column) > 0), "mix-copies")

    def found(some: DataFrame) -> DataFrame:
        same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{column}id")) & (key == F.col(f"{column}key"))
        return docs.join(some, same)

    rows = found(by_key.where(F.col(f"{column}rows") == 1))
    alike = by_key.where(F.col(f"{column}rows") > 1)
    if not alike.isEmpty():
        rows = rows.unionByName(found(alike).dropDuplicates([f"{column}id", f"{column}key"]))
    return rows.withColumn(f"{column}no", F.explode(F.sequence(F.lit(1).cast("long"), F.col(column)))).select(docs.columns)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(common.table(spark, sf_dir, "documents"))


def op8_sql() -> str:
    weights = ", ".join(map(str, QUERY_WEIGHTS))
    return rf"""
WITH sizes AS (
  SELECT doc_id, text, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
tilted AS (SELECT *, floor(65536.0::DOUBLE / sqrt(sqrt(1.0::DOUBLE + size)))::BIGINT AS tilt FROM sizes),
by_source AS (
  SELECT src, sum(size)::BIGINT AS source_size, sum(size * tilt)::BIGINT AS tilted_size FROM tilted GROUP BY src),
weighed AS (
  SELECT *, [{weights}][1 + (row_number() OVER (ORDER BY src) - 1) % {len(QUERY_WEIGHTS)}] AS weight, source_size * {MOST} AS cap FROM by_source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight::DOUBLE, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY cap / weight::DOUBLE, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
targets AS (
  SELECT src, source_size, tilted_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
rests AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole,
         target - coalesce(floor(target / nullif(source_size, 0)), 0) * source_size AS rest FROM targets),
drawn AS (
  SELECT t.doc_id, t.size, r.*, greatest(1e-9::DOUBLE, least((1 - 1e-9)::DOUBLE, coalesce(r.rest * t.tilt / nullif(r.tilted_size, 0), 0))) AS inclusion,
         (('0x' || substr(md5('{SEED}' || coalesce(doc_id::VARCHAR, '') || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM tilted t JOIN rests r USING (src)),
ranked AS (
  SELECT *, sum(size) OVER (PARTITION BY src ORDER BY (u / (1 - u)) * ((1 - inclusion) / inclusion), doc_id, size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM drawn)
SELECT doc_id, size, source_size, target,
       (whole + CASE WHEN rest > 0 AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END)::BIGINT AS copies,
       ((whole + CASE WHEN rest > 0 AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM ranked"""
