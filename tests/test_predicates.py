import random

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import predicates as p

ROWS = [("alice", 30.0, True, "x\\y"), ("bob", None, False, None), (None, 20.0, None, "a_ice")]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, "name string, age double, active boolean, note string")


def names(df, condition):
    return {r["name"] for r in df.where(condition).collect()}


def test_leaves(people):
    name, age = F.col("name"), F.col("age")
    assert names(people, p.eq(name, "alice")) == {"alice"}
    assert names(people, p.ne(name, "alice")) == {"bob", None}
    assert names(people, p.between(age, 20, 40)) == {"alice", None}
    assert names(people, p.not_in(name, ["bob"])) == {"alice", None}
    assert names(people, p.in_(age, [30.0, 1.0])) == {"alice"}
    assert names(people, p.in_(age, [])) == set()
    assert names(people, p.not_(p.gt(age, 25))) == {"bob", None}
    assert names(people, p.is_null(age)) == {"bob"}
    assert names(people, p.eq(age, None)) == {"bob"}


def test_strings(people):
    note = F.col("note")
    assert names(people, p.like(note, "x\\y")) == {"alice"}
    assert names(people, p.like(note, "a%ce")) == {None}
    assert names(people, p.like(note, "_____")) == {None}
    assert names(people, p.contains(F.col("name"), "li")) == {"alice"}


def test_geo(spark):
    at = spark.createDataFrame([(10.0, 20.0), (0.0, 0.0), (None, 1.0)], "lat double, lng double").select(F.struct("lat", "lng").alias("at"))
    assert at.where(p.geo_box(F.col("at"), 11, 21, 9, 19)).count() == 1
    assert at.where(p.geo_box(F.col("at"), 11, 22, 9, 21)).count() == 0
    assert at.where(p.geo_radius(F.col("at"), 0, 0, 100)).count() == 1
    assert at.where(p.geo_radius(F.col("at"), 40.7128, -74.006, 1000)).count() == 0
    with pytest.raises(ValueError):
        p.geo_radius(F.col("at"), 91, 0, 1)


def test_json_kinds(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(['{"k":1}', '{"k":null}', "{}", '{"k":"1"}', '{"k":true}', "not json", None])], "i int, d string")
    k = p.json_field(F.col("d"), "k")
    at = lambda c: {r["i"] for r in df.where(c).collect()}
    assert at(k.exists()) == {0, 1, 3, 4}
    assert at(k.is_null()) == {1, 2, 5, 6}
    assert at(p.eq(k.number(), 1.0)) == {0}
    assert at(p.eq(k.string(), "1")) == {3}
    assert at(p.eq(k.boolean(), True)) == {4}
    assert at(p.not_(p.gt(k.number(), 0.0))) == {1, 2, 3, 4, 5, 6}


def test_random_trees_match_two_valued_logic(people):
    dice = random.Random(3)

    def tree(depth):
        if depth == 0 or dice.random() < 0.3:
            kind = dice.choice(["name", "age", "null"])
            if kind == "name":
                v = dice.choice(["alice", "bob", "zed"])
                return p.eq(F.col("name"), v), lambda r: r[0] == v
            if kind == "age":
                v = dice.choice([10, 25, 30])
                return p.gt(F.col("age"), v), lambda r: r[1] is not None and r[1] > v
            return p.is_null(F.col("age")), lambda r: r[1] is None
        kind = dice.choice(["and", "or", "not"])
        a, fa = tree(depth - 1)
        if kind == "not":
            return p.not_(a), lambda r: not fa(r)
        b, fb = tree(depth - 1)
        return (p.all_of(a, b), lambda r: fa(r) and fb(r)) if kind == "and" else (p.any_of(a, b), lambda r: fa(r) or fb(r))

    for _ in range(15):
        column, holds = tree(4)
        assert names(people, column) == {r[0] for r in ROWS if holds(r)}


def test_positive_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) s").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(p.all_of(p.gt(F.col("id"), 5), p.starts_with(F.col("s"), "1")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan and "StringStartsWith(s,1)" in plan
