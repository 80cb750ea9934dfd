"""Vector search, sparse and multi-vector similarities, and quantisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrove.functions import vectors as v
from lexigrove.operators import neighbours
from lexigrove.plans.common import table
from lexigrove.sources import shared
from lexigrove.sources.vector_table import VectorTable

QUERY = [0.5] * 16 + [-0.25] * 16 + [0.0] * 16 + [1.0] * 16


def _rounded(df):
    return df.withColumn("score", F.round("score", 5))


def _near(metric):
    return lambda spark, d: _rounded(neighbours.nearest(table(spark, d, "embeddings"), QUERY, 25, metric))


def knn_batch(spark, d):
    rows = table(spark, d, "embeddings")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return _rounded(neighbours.nearest_batch(rows, queries, 5))


def sparse_dot(spark, d):
    cut = lambda c: F.transform(F.col(c), lambda x: F.when(F.abs(x) > 0.1, x).otherwise(F.lit(0.0)))
    rows = table(spark, d, "embeddings").withColumn("s", v.sparse(cut("embedding")))
    one = v.sparse(v.literal(QUERY))
    return rows.select("vec_id", F.size("s").alias("nnz"), F.round(v.sparse_dot(F.col("s"), one), 5).alias("dot"), F.round(v.sparse_cosine(F.col("s"), one), 5).alias("cosine"))


def maxsim(spark, d):
    rows = table(spark, d, "embeddings")
    document = F.array(*(F.slice("embedding", 1 + 16 * i, 16) for i in range(4)))
    query = F.array(v.literal(QUERY[:16]), v.literal(QUERY[16:32]))
    return rows.select("vec_id", F.round(v.max_similarity(query, document), 5).alias("score"))


def binary_hamming(spark, d):
    rows = table(spark, d, "embeddings")
    code = v.sign_bits(v.literal(QUERY))
    return rows.select("vec_id", F.round(v.sign_distance(v.sign_bits(F.col("embedding")), code), 6).alias("distance"))


def scalar_quant_calibrate(spark, d):
    one = neighbours.scalar_ranges(table(spark, d, "embeddings"))
    return one.select(F.posexplode(F.arrays_zip("low", "span")).alias("pos", "x")).select("pos", F.round("x.low", 6).alias("low"), F.round("x.span", 6).alias("span"))


def scalar_quant_distance(spark, d):
    rows = neighbours.scalar_coded(table(spark, d, "embeddings"))
    value = v.scalar_value(F.col("code"), F.col("low"), F.col("span"))
    return rows.select("vec_id", F.round(v.euclidean(value, v.literal(QUERY)), 3).alias("distance"))


def product_quant_distance(spark, d):
    rows = table(spark, d, "embeddings")
    model = neighbours.ProductQuantiser(64).calibrate(rows)
    return rows.select("vec_id", F.round(model.distance(QUERY, model.code(F.col("embedding"))), 4).alias("distance"))


def vector_collection(spark, d):
    """A vector table through its life: vectors added, some replaced by their negatives, some deleted, then a search."""
    rows = table(spark, d, "embeddings")
    kept = VectorTable(spark, shared.new_path(spark, "vectors"), "dot")
    kept.upsert(rows)
    kept.upsert(rows.where("vec_id % 4 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    kept.delete(rows.where("vec_id % 10 = 3").select("vec_id"))
    assert kept.metric == VectorTable(spark, kept.table.path.removesuffix("/vectors"), "cosine").metric == "dot"
    return _rounded(kept.search(QUERY, 20)).crossJoin(F.broadcast(kept.counts()))


def _kinds(rows):
    """A struct of one kind of embedding for each row: dense, sparse and multi-vector ones in turn."""
    values = F.col("embedding").cast("array<double>")
    cut = F.transform(values, lambda x: F.when(x > 0.1, x).otherwise(F.lit(0.0)))
    kind = F.col("vec_id") % 3
    return rows.select("vec_id", F.struct(F.when(kind == 0, values).alias("dense"), F.when(kind == 1, v.sparse(cut)).alias("sparse"), F.when(kind == 2, F.array(F.slice(values, 1, 16), F.slice(values, 17, 16))).alias("multi")).alias("e"))


def embedding_similarity(spark, d):
    """Each vector with the one three before it, which is of its kind, and with the next, which is not."""
    rows = _kinds(table(spark, d, "embeddings"))
    other = rows.select((F.col("vec_id") + 3).alias("vec_id"), F.col("e").alias("o"))
    next_ = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("x"))
    both = rows.join(other, "vec_id").join(next_, "vec_id")
    return both.select(
        "vec_id", F.round(v.similarity(F.col("e"), F.col("o"), "cosine"), 5).alias("cosine"), F.round(v.similarity(F.col("e"), F.col("o"), "dot"), 5).alias("dot"),
        F.round(v.similarity(F.col("e"), F.col("x")), 5).alias("mixed"), v.embedding_dimension(F.col("e")).alias("dimension"),
    )


def quantiser_distances(spark, d):
    """Distances by the quantisers that need no centres, by name, with the bytes of a code."""
    rows = table(spark, d, "embeddings")
    out = None
    for name in ("scalar-int8", "binary"):
        model = neighbours.QUANTISERS[name](64).calibrate(rows)
        part = rows.select("vec_id", F.lit(name).alias("name"), F.lit(model.code_bytes).alias("code_bytes"), F.round(model.distance(QUERY, model.code(F.col("embedding"))), 3).alias("distance"))
        out = part if out is None else out.unionByName(part)
    return out


_Q = "[" + ", ".join(map(repr, QUERY)) + "]::DOUBLE[]"
_E = "embedding::DOUBLE[]"


def _near_sql(score: str) -> str:
    return f"SELECT vec_id, round({score}, 5) AS score FROM embeddings ORDER BY {score} DESC, vec_id LIMIT 25"


QUERIES = {
    "knn_cosine": (_near("cosine"), _near_sql(f"list_cosine_similarity({_E}, {_Q})")),
    "knn_dot": (_near("dot"), _near_sql(f"list_inner_product({_E}, {_Q})")),
    "knn_euclid": (_near("euclidean"), _near_sql(f"-list_distance({_E}, {_Q})")),
    "knn_batch": (
        knn_batch,
        f"""SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.{_E}, q.{_E}), 5) AS score FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.{_E}, q.{_E}) DESC, e.vec_id) <= 5""",
    ),
    "sparse_dot": (
        sparse_dot,
        f"""WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN abs(x) > 0.1 THEN x::DOUBLE ELSE 0.0::DOUBLE END) AS s FROM embeddings)
SELECT vec_id, len(list_filter(s, lambda x: x <> 0))::INTEGER AS nnz, round(list_inner_product(s, {_Q}), 5) AS dot, round(coalesce(list_cosine_similarity(s, {_Q}), 0), 5) AS cosine FROM t""",
    ),
    "maxsim": (
        maxsim,
        "SELECT vec_id, round("
        + " + ".join(
            "greatest(" + ", ".join(f"list_inner_product(({_E})[{1 + 16 * i}:{16 * i + 16}], ({_Q})[{a}:{a + 15}])" for i in range(4)) + ")" for a in (1, 17)
        )
        + ", 5) AS score FROM embeddings",
    ),
    "binary_hamming": (
        binary_hamming,
        f"SELECT vec_id, round(2.0::DOUBLE * len(list_filter(range(1, 65), lambda i: (embedding[i] > 0) <> (({_Q})[i] > 0))) / 64 - 1, 6) AS distance FROM embeddings",
    ),
    "scalar_quant_calibrate": (
        scalar_quant_calibrate,
        f"""WITH t AS (SELECT unnest({_E}) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT pos::INTEGER AS pos, round(min(x), 6) AS low, round(greatest(max(x) - min(x), 1.1920928955078125e-07), 6) AS span FROM t GROUP BY pos""",
    ),
    "scalar_quant_distance": (
        scalar_quant_distance,
        f"""WITH t AS (SELECT vec_id, unnest({_E}) AS x, unnest({_Q}) AS q, generate_subscripts(embedding, 1) AS pos FROM embeddings),
r AS (SELECT pos, min(x) AS low, greatest(max(x) - min(x), 1.1920928955078125e-07) AS span FROM t GROUP BY pos)
SELECT vec_id, round(sqrt(sum((round(greatest(0.0, least(1.0, (x - low) / span)) * 255) / 255.0 * span + low - q) ^ 2)), 3) AS distance FROM t JOIN r USING (pos) GROUP BY vec_id""",
    ),
    "product_quant_distance": (product_quant_distance, None),
    "vector_collection": (
        vector_collection,
        f"""WITH kept AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN list_transform({_E}, lambda x: -x) ELSE {_E} END AS e FROM embeddings WHERE vec_id % 10 <> 3)
SELECT vec_id, round(list_inner_product(e, {_Q}), 5) AS score, 64 AS dimensions, (SELECT count(*) FROM kept) AS n FROM kept ORDER BY list_inner_product(e, {_Q}) DESC, vec_id LIMIT 20""",
    ),
    "embedding_similarity": (
        embedding_similarity,
        f"""WITH t AS (SELECT vec_id, {_E} AS e, list_transform({_E}, lambda x: CASE WHEN x > 0.1::FLOAT THEN x ELSE 0 END) AS s FROM embeddings),
p AS (SELECT a.vec_id, a.e, a.s, b.e AS oe, b.s AS os FROM t a JOIN t b ON a.vec_id = b.vec_id + 3 JOIN t c ON a.vec_id = c.vec_id - 1)
SELECT vec_id, 0.0::DOUBLE AS mixed,
  round(CASE vec_id % 3 WHEN 0 THEN list_cosine_similarity(e, oe) WHEN 1 THEN coalesce(list_cosine_similarity(s, os), 0) ELSE
    greatest(list_inner_product(e[1:16], oe[1:16]), list_inner_product(e[1:16], oe[17:32])) + greatest(list_inner_product(e[17:32], oe[1:16]), list_inner_product(e[17:32], oe[17:32])) END, 5) AS cosine,
  round(CASE vec_id % 3 WHEN 0 THEN list_inner_product(e, oe) WHEN 1 THEN list_inner_product(s, os) ELSE
    greatest(list_inner_product(e[1:16], oe[1:16]), list_inner_product(e[1:16], oe[17:32])) + greatest(list_inner_product(e[17:32], oe[1:16]), list_inner_product(e[17:32], oe[17:32])) END, 5) AS dot,
  CASE vec_id % 3 WHEN 0 THEN 64 WHEN 1 THEN greatest(len(list_filter(s, lambda x: x <> 0)), coalesce(list_max(list_filter(range(1, 65), lambda i: s[i] <> 0)), 0)) ELSE 16 END::INTEGER AS dimension FROM p""",
    ),
    "quantiser_distances": (
        quantiser_distances,
        f"""WITH t AS (SELECT vec_id, unnest({_E}) AS x, unnest({_Q}) AS q, generate_subscripts(embedding, 1) AS pos FROM embeddings),
r AS (SELECT pos, min(x) AS low, greatest(max(x) - min(x), 1.1920928955078125e-07) AS span FROM t GROUP BY pos)
SELECT vec_id, 'scalar-int8' AS name, 64 AS code_bytes, round(sqrt(sum((round(greatest(0.0, least(1.0, (x - low) / span)) * 255) / 255.0 * span + low - q) ^ 2)), 3) AS distance FROM t JOIN r USING (pos) GROUP BY vec_id
UNION ALL SELECT vec_id, 'binary', 8, round(2.0::DOUBLE * len(list_filter(range(1, 65), lambda i: (embedding[i] > 0) <> (({_Q})[i] > 0))) / 64 - 1, 3) FROM embeddings""",
    ),
}
