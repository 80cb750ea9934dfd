import pytest

from lexigrove.sources import documents as source
from lexigrove.sources import shared
from lexigrove.sources.vector_table import VectorTable
from lexigrove.sources.versions import Table
from lexigrove.streaming import ingest


def test_versions_and_snapshots(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError):
        table.read()
    table.write(spark.range(3))
    table.snapshot("s")
    table.write(table.read().where("id > 0"))
    assert (table.versions(), table.read().count(), [(r["name"], r["rows"]) for r in table.snapshots().collect()]) == ([1, 2], 2, [("s", 3)])
    assert table.restore("s") == 3
    assert table.read().count() == 3
    with pytest.raises(ValueError):
        table.restore("other")
    spark.range(4).write.mode("overwrite").parquet(f"file://{tmp_path}/t/snapshots/s")
    with pytest.raises(ValueError):
        table.restore("s")
    table.snapshot("t")
    assert [r["name"] for r in table.snapshots().collect()] == ["t", "s"]  # newest first
    table.delete_snapshot("s")
    assert [r["name"] for r in table.snapshots().collect()] == ["t"]
    assert table.vacuum(1) == 2 and table.versions() == [3] and table.read().count() == 3


def test_stored_tables_can_be_dropped(spark):
    df = shared.stored(spark.range(5), "five")
    assert df.count() == 5 and shared.exists(spark, df.stored_path)
    shared.drop(df)
    assert not shared.exists(spark, df.stored_path)
    shared.stored(spark.range(5), "five")
    assert shared.drop_all(spark) >= 1 and shared.drop_all(spark) == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf = {}
        sparkContext = Context

    with pytest.raises(RuntimeError):
        shared.shared_folder(Session)


def test_stream_upserts(spark, tmp_path):
    schema = "k int, n int, v string"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], schema).coalesce(1).write.parquet(str(tmp_path / "in/one"))
    table = Table(spark, f"file://{tmp_path}/out")

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
        ingest.upserting(stream, table, "k", "n", str(tmp_path / "progress")).awaitTermination()

    run()
    spark.createDataFrame([(2, 4, "d")], schema).coalesce(1).write.parquet(str(tmp_path / "in/two"))
    run()
    assert sorted((r["k"], r["v"]) for r in table.read().collect()) == [(1, "b"), (2, "d")]
    spark.createDataFrame([(1, 0, "late"), (3, 1, "e")], schema).coalesce(1).write.parquet(str(tmp_path / "in/three"))
    run()  # a late batch does not bring back an older row
    assert sorted((r["k"], r["v"]) for r in table.read().collect()) == [(1, "b"), (2, "d"), (3, "e")]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2]), (10, None), (2, [3])], "doc_id int, a array<int>")
    for kind in ("ndjson", "csv", "parquet"):
        source.export(df, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 3
    with pytest.raises(ValueError):
        source.export(df, str(tmp_path / "x"), "xml")
    assert [r["doc_id"] for r in source.listed(df, 0, 2).collect()] == [1, 10]


def test_catalog(spark, tmp_path):
    from lexigrove.operators.search import Request, Rule
    from lexigrove.sources.catalog import Catalog, Settings

    catalog = Catalog(spark, f"file://{tmp_path}/c")
    assert catalog.names() == [] and catalog.stats().count() == 0
    catalog.create("a", Settings(key="id", searchable=("t",), stop_words=("the",)))
    catalog.create("b")
    for name in ("a", "no spaces"):
        with pytest.raises(ValueError):
            catalog.create(name)
    rows = lambda *x: spark.createDataFrame(list(x), "id int, t string, u string")
    catalog.add("a", rows((1, "the fox", "x"), (2, "a dog", "y")))
    with pytest.raises(ValueError):
        catalog.add("a", rows((3, "x", "x"), (3, "y", "y")))
    catalog.add("a", rows((2, "a fox", None)), merge=True)
    assert sorted(map(tuple, catalog.documents("a").collect())) == [(1, "the fox", "x"), (2, "a fox", "y")]
    assert sorted(r["doc_id"] for r in catalog.collection("a").page(Request(terms=["fox"])).collect()) == [1, 2]
    assert catalog.collection("a").page(Request(terms=["the"])).count() == 0
    catalog.delete("a", rows((1, None, None)).select("id"))
    catalog.change("a", stop_words=())
    catalog.swap("a", "b")
    assert catalog.documents("b").count() == 1 and catalog.settings("b").searchable == ("t",)
    assert [tuple(r) for r in catalog.stats().collect()] == [("b", 1)]
    assert {(r["field"], r["n"]) for r in catalog.field_counts().collect()} == {(None, 1), ("id", 1), ("t", 1), ("u", 1)}
    assert [r["id"] for r in catalog.get("b", spark.createDataFrame([(2,), (9,)], "id int")).collect()] == [2]
    rules = [Rule("fox", hide=(2,), filter="u is not null", sort=("u:desc",), name="r")]
    catalog.put_rules("b", rules)
    c = catalog.collection("b")
    assert list(c.rules) == rules and c.page(c.request("fox")).count() == 0
    with pytest.raises(TypeError):
        catalog.put_rules("b", [Rule("x", filter=rows((1, "a", "b")).u == "b")])
    assert sorted((r["query"], r["doc_id"]) for r in catalog.search([("b", Request(terms=["fox"])), ("nobody", Request())]).collect()) == [(0, "2")]
    catalog.change("b", weights={"t": 2.0})
    assert dict(catalog.collection("b").request("fox").weights) == {"t": 2.0}
    with pytest.raises(TypeError):
        catalog.add("b", spark.createDataFrame([(True, "x")], "id boolean, t string"))
    catalog.delete("b")
    assert catalog.documents("b").count() == 0
    catalog.drop("b")
    with pytest.raises(KeyError):
        catalog.documents("b")


def test_vector_table(spark, tmp_path):
    kept = VectorTable(spark, f"file://{tmp_path}/v", "euclidean")
    assert kept.search([1.0, 0.0], 3).count() == 0
    kept.upsert(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<double>"))
    kept.upsert(spark.createDataFrame([(2, [0.9, 0.0])], "vec_id long, embedding array<double>"))
    kept.delete(spark.createDataFrame([(3,)], "vec_id long"))
    assert [r["vec_id"] for r in kept.search([1.0, 0.0], 3).collect()] == [1, 2]
    assert [tuple(r) for r in kept.counts().collect()] == [(2, 2)]
    assert VectorTable(spark, f"file://{tmp_path}/v", "dot").metric == "euclidean"
    with pytest.raises(ValueError):
        kept.upsert(spark.createDataFrame([(4, [1.0]), (4, [2.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError):
        VectorTable(spark, f"file://{tmp_path}/w", "luck")
