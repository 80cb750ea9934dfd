import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrove.functions import vectors as v
from lexigrove.operators import neighbours
from lexigrove.plans import catalogue


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_dense(spark):
    lit = v.literal
    assert value(spark, v.cosine(lit([1, 0]), lit([1, 0]))) == 1
    assert value(spark, v.cosine(lit([0, 0]), lit([1, 0]))) == 0
    assert value(spark, v.dot(lit([1, 2, 3]), lit([4, 5, 6]))) == 32
    assert value(spark, v.dot(lit([1]), lit([4, 5]))) == 0
    assert value(spark, v.euclidean(lit([0, 0]), lit([3, 4]))) == 5
    assert value(spark, v.euclidean(lit([0]), lit([3, 4]))) == float("inf")


def test_sparse_and_multi(spark):
    a, b = v.sparse(v.literal([1, 0, 2, 0])), v.sparse(v.literal([2, 0, 3, 0]))
    assert value(spark, v.sparse_dot(a, b)) == 8
    assert value(spark, v.sparse_cosine(a, b)) == pytest.approx(0.992277, abs=1e-6)
    assert value(spark, v.sparse_dimension(a)) == 3
    q = F.array(v.literal([1, 0]), v.literal([0, 1]))
    d = F.array(v.literal([0.5, 0]), v.literal([0, 0.7]), v.literal([1, 0]))
    assert value(spark, v.max_similarity(q, d)) == pytest.approx(1.7)


def test_binary(spark):
    bits = lambda *x: v.sign_bits(v.literal(x))
    assert value(spark, v.sign_distance(bits(1, -1), bits(1, -1))) == -1
    assert value(spark, v.sign_distance(bits(1, -1), bits(-1, 1))) == 1


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, [((i * 31 + d * 7) % 13) / 13 for d in range(8)]) for i in range(60)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>")


def test_nearest_batch_matches_single(rows):
    queries = rows.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    batch = neighbours.nearest_batch(rows, queries, 4, "euclidean", blocks=3)
    for r in queries.collect():
        one = neighbours.nearest(rows, r["q"], 4, "euclidean").collect()
        assert sorted(x["vec_id"] for x in batch.where(F.col("query_id") == r["query_id"]).collect()) == sorted(x["vec_id"] for x in one)


def test_scalar_quantiser(rows):
    coded = neighbours.scalar_coded(rows)
    back = v.scalar_value(F.col("code"), F.col("low"), F.col("span"))
    assert coded.select(F.max(v.euclidean(back, F.col("embedding")))).first()[0] < 0.02


def test_product_quantiser(rows):
    model = neighbours.ProductQuantiser(8, parts=4, codes=8, rounds=5).calibrate(rows)
    got = rows.select("embedding", model.code(F.col("embedding")).alias("code")).collect()
    for r in got[:10]:
        parts = np.array(r["embedding"]).reshape(4, 2)
        assert r["code"] == [int(((c - x) ** 2).sum(1).argmin()) for c, x in zip(model.centres, parts, strict=True)]
    odd = rows.withColumn("embedding", F.slice("embedding", 1, 7))  # filled up with zeros
    model = neighbours.ProductQuantiser(7, parts=4, codes=60, rounds=1).calibrate(odd)
    one = odd.first()["embedding"]
    assert odd.select(F.min(model.distance(one, model.code(F.col("embedding"))))).first()[0] == pytest.approx(0, abs=1e-9)


def test_kmeans(rows):
    x = np.array([r["embedding"] for r in rows.orderBy("vec_id").collect()])
    centres = x[[i * (60 // 5) for i in range(5)]]
    for _ in range(4):
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(5)])
    assert np.allclose(neighbours.kmeans(rows, 5, 8, rounds=4), centres)


def test_quantisers_by_name(rows):
    assert {name: q(8).code_bytes for name, q in neighbours.QUANTISERS.items()} == {"scalar-int8": 8, "product": 8, "binary": 1}
    for q in neighbours.QUANTISERS.values():
        model = q(8).calibrate(rows)
        one = rows.first()["embedding"]
        near = rows.select("vec_id", model.distance(one, model.code(F.col("embedding"))).alias("d")).orderBy("d", "vec_id").first()
        assert near["d"] <= 0.1


def test_kinds_of_embeddings(spark):
    schema = "k int, e struct<dense: array<double>, sparse: map<int, double>, multi: array<array<double>>>"
    df = spark.createDataFrame([(1, ([3.0, 4.0], None, None)), (2, (None, {5: 2.0}, None)), (3, (None, None, [[1.0, 0.0], [0.0, 2.0]])), (4, (None, None, None))], schema)
    got = {r["k"]: (r["c"], r["d"], r["e"], r["n"]) for r in df.select("k", v.similarity(F.col("e"), F.col("e")).alias("c"), v.similarity(F.col("e"), F.col("e"), "dot").alias("d"), v.similarity(F.col("e"), F.col("e"), "euclidean").alias("e"), v.embedding_dimension(F.col("e")).alias("n")).collect()}
    assert got == {1: (1.0, 25.0, 0.0, 2), 2: (1.0, 4.0, 0.0, 6), 3: (5.0, 5.0, 5.0, 2), 4: (0.0, 0.0, 0.0, 0)}


def test_product_quantiser_begins_at_strided_rows(rows, spark):
    """The first centres are every n/k-th vector by key, found without a sort of the table in one task."""
    model = neighbours.ProductQuantiser(8, parts=4, codes=7, rounds=0).calibrate(rows.repartition(5))
    by_key = [r["embedding"] for r in rows.orderBy("vec_id").collect()]
    want = np.array([by_key[i * 8] for i in range(7)]).reshape(7, 4, 2).transpose(1, 0, 2)
    assert np.array_equal(model.centres, want)


def test_registered_quantiser_has_all_codes(spark, tmp_path, monkeypatch):
    data = [(i, [((i * 31 + d * 7) % 101) / 101 for d in range(64)]) for i in range(300)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    made = []
    calibrate = neighbours.ProductQuantiser.calibrate
    monkeypatch.setattr(neighbours.ProductQuantiser, "calibrate", lambda self, *a, **b: made.append(self) or calibrate(self, *a, **b))
    assert catalogue.queries()["product_quant_distance"](spark, str(tmp_path)).count() == 300
    assert made[0].centres.shape == (8, 256, 8) and made[0].rounds == 8


def test_nearest_batch_holds_no_lists(rows):
    queries = rows.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    plan = neighbours.nearest_batch(rows, queries, 4, "euclidean")._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "WindowGroupLimit" in plan


def test_product_quantiser_leaves_out_vectors_that_are_none(spark):
    good = [(i, [float(i % 7), float(i % 5), 1.0, float(i % 3)]) for i in range(40)]
    odd = [(90, None), (91, []), (92, [1.0, 2.0]), (93, [1.0] * 5), (94, [1.0, None, 1.0, 1.0]), (95, [float("nan")] * 4), (96, [float("inf"), 0.0, 0.0, 0.0])]
    schema = "vec_id long, embedding array<float>"
    rows = spark.createDataFrame(good + odd, schema).repartition(8)
    model = neighbours.ProductQuantiser(4, 2, 8, 3).calibrate(rows)
    alone = neighbours.ProductQuantiser(4, 2, 8, 3).calibrate(spark.createDataFrame(good, schema))
    assert np.allclose(model.centres, alone.centres)
    of = lambda m: {r[0]: r[1] for r in rows.select("vec_id", m.distance([0.0] * 4, m.code(rows["embedding"]))).collect()}
    found = of(model)
    assert len(found) == 47 and {i for i, d in found.items() if d is None} == {i for i, _ in odd}
    none = neighbours.ProductQuantiser(4, 2, 8).calibrate(rows.where("vec_id >= 90"))
    assert set(of(none).values()) == {None}


def test_product_quantiser_takes_tasks_without_vectors(rows):
    few = rows.where("vec_id < 5")
    model = neighbours.ProductQuantiser(8, 4, 3, 2).calibrate(few.repartition(9))
    alone = neighbours.ProductQuantiser(8, 4, 3, 2).calibrate(few.coalesce(1))
    assert np.allclose(model.centres, alone.centres)
    assert np.allclose(neighbours.kmeans(few.repartition(9), 3, 8, 2), neighbours.kmeans(few.coalesce(1), 3, 8, 2))


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_nearest_batch_is_brute_force_on_odd_vectors(spark, metric, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 9)
    rng = np.random.default_rng(4)
    some = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(120)]
    some += [(200 + i, some[7][1]) for i in range(12)] + [(300 + i, [0.0] * 6) for i in range(3)] + [(310 + i, [1.0] * 4) for i in range(8)]
    odd = [(400, None), (401, []), (402, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (403, [float("nan")] * 6), (404, [float("inf")] + [1.0] * 5), (405, [1e-38] * 6)]
    rows = spark.createDataFrame(some + odd, "vec_id long, embedding array<float>").repartition(5)
    queries = rows.where("vec_id % 5 = 0 or vec_id >= 300").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = neighbours.nearest_batch(rows, queries, 4, metric, blocks=3)
    assert "CoGroup" in found._jdf.queryExecution().analyzed().toString()  # blocks of queries meet blocks of vectors
    pairs = queries.crossJoin(rows).select("query_id", "vec_id", v.METRICS[metric](F.col("embedding"), F.col("q")).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy((-F.col("score")).asc(), F.col("vec_id").asc()))
    plain = pairs.withColumn("rank", rank).where("rank <= 4").drop("rank")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))
