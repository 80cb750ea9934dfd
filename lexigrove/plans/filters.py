"""Filter predicates, with nulls made where the tables have none."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrove.functions import predicates as p
from lexigrove.plans.common import table


def _part(make):
    def run(spark, d):
        rows = table(spark, d, "part").withColumn("size", F.expr("nullif(p_size, 10)")).withColumn("brand", F.expr("nullif(p_brand, 'Brand#13')"))
        return rows.where(make(F.col("size"), F.col("brand"), F.col("p_name"), F.col("p_retailprice"))).select("p_partkey")

    return run


def _part_sql(where: str) -> str:
    return f"WITH t AS (SELECT *, nullif(p_size, 10) AS size, nullif(p_brand, 'Brand#13') AS brand FROM part) SELECT p_partkey FROM t WHERE {where}"


def _geo(make):
    def run(spark, d):
        lat, lng = (F.col("c_custkey") * 37) % 180 - 90.0, (F.col("c_custkey") * 53) % 360 - 180.0
        rows = table(spark, d, "customer").withColumn("at", F.struct(lat.cast("double").alias("lat"), lng.cast("double").alias("lng")))
        return rows.where(make(F.col("at"))).select("c_custkey")

    return run


_POINT = "SELECT c_custkey, ((c_custkey * 37) % 180 - 90)::DOUBLE AS lat, ((c_custkey * 53) % 360 - 180)::DOUBLE AS lng FROM customer"


def _json(make):
    def run(spark, d):
        rows = table(spark, d, "events").withColumn("doc", F.when(F.col("event_id") % 7 == 0, '{"k":null}').when(F.col("event_id") % 7 == 1, '{"other":"x"}').when(F.col("event_id") % 7 == 2, '{"k":"5"}').otherwise(F.col("props")))
        return rows.where(make(p.json_field(F.col("doc"), "k"))).select("event_id")

    return run


_DOC = """WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '{"k":null}' WHEN 1 THEN '{"other":"x"}' WHEN 2 THEN '{"k":"5"}' ELSE props END AS doc FROM events),
t AS (SELECT event_id, json_type(doc, '$.k') AS kind, doc ->> '$.k' AS v FROM e)"""
_NUMBER = "(CASE WHEN kind IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN v::DOUBLE END)"


def _orders(spark, d):
    rows = table(spark, d, "orders")
    where = p.all_of(p.ge(F.col("o_totalprice"), 1000.0), p.any_of(p.eq(F.col("o_orderstatus"), "F"), p.starts_with(F.col("o_orderpriority"), "1")), p.not_(p.contains(F.col("o_orderpriority"), "LOW")))
    return rows.where(where).select("o_orderkey")


QUERIES = {
    "filter_eq": (_part(lambda s, b, n, c: p.eq(b, "Brand#11")), _part_sql("brand = 'Brand#11'")),
    "filter_eq_float": (_part(lambda s, b, n, c: p.eq(c, 901.0)), _part_sql("abs(p_retailprice - 901.0) < 2.220446049250313e-16")),
    "filter_ne": (_part(lambda s, b, n, c: p.ne(b, "Brand#11")), _part_sql("brand IS DISTINCT FROM 'Brand#11'")),
    "filter_gt": (_part(lambda s, b, n, c: p.gt(s, 25)), _part_sql("size > 25")),
    "filter_gte": (_part(lambda s, b, n, c: p.ge(s, 25)), _part_sql("size >= 25")),
    "filter_lt": (_part(lambda s, b, n, c: p.lt(s, 25)), _part_sql("size < 25")),
    "filter_lte": (_part(lambda s, b, n, c: p.le(s, 25)), _part_sql("size <= 25")),
    "filter_between": (_part(lambda s, b, n, c: p.between(s, 5, 15)), _part_sql("size BETWEEN 5 AND 15")),
    "filter_in": (_part(lambda s, b, n, c: p.in_(s, [1, 7, 10, 49])), _part_sql("size IN (1, 7, 10, 49)")),
    "filter_not_in": (_part(lambda s, b, n, c: p.not_in(s, [1, 7, 49])), _part_sql("size IS NULL OR size NOT IN (1, 7, 49)")),
    "filter_is_null": (_part(lambda s, b, n, c: p.is_null(s)), _part_sql("size IS NULL")),
    "filter_is_not_null": (_part(lambda s, b, n, c: p.is_not_null(s)), _part_sql("size IS NOT NULL")),
    "filter_contains": (_part(lambda s, b, n, c: p.contains(n, "e")), _part_sql("contains(p_name, 'e')")),
    "filter_starts": (_part(lambda s, b, n, c: p.starts_with(b, "Brand#1")), _part_sql("starts_with(brand, 'Brand#1')")),
    "filter_ends": (_part(lambda s, b, n, c: p.ends_with(b, "2")), _part_sql("ends_with(brand, '2')")),
    "filter_like": (_part(lambda s, b, n, c: p.like(b, "Br_nd#%3")), _part_sql("brand LIKE 'Br_nd#%3'")),
    "filter_not": (_part(lambda s, b, n, c: p.not_(p.gt(s, 25))), _part_sql("NOT coalesce(size > 25, false)")),
    "filter_nested": (
        _part(lambda s, b, n, c: p.not_(p.all_of(p.gt(s, 10), p.any_of(p.eq(b, "Brand#11"), p.lt(s, 30))))),
        _part_sql("NOT coalesce(size > 10 AND (coalesce(brand = 'Brand#11', false) OR coalesce(size < 30, false)), false)"),
    ),
    "filter_orders": (
        _orders,
        "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND (o_orderstatus = 'F' OR starts_with(o_orderpriority, '1')) AND NOT contains(o_orderpriority, 'LOW')",
    ),
    "geo_bbox": (_geo(lambda at: p.geo_box(at, 40.0, 60.0, -20.0, -50.0)), f"SELECT c_custkey FROM ({_POINT}) WHERE lat BETWEEN -20 AND 40 AND lng BETWEEN -50 AND 60"),
    "geo_radius": (
        _geo(lambda at: p.geo_radius(at, 10.0, 20.0, 3_000_000.0)),
        f"""SELECT c_custkey FROM (SELECT c_custkey, sin(radians(lat - 10) / 2) ^ 2 + cos(radians(10.0)) * cos(radians(lat)) * sin(radians(lng - 20) / 2) ^ 2 AS a FROM ({_POINT}))
WHERE 2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)) <= 3000000""",
    ),
    "json_exists": (_json(lambda k: k.exists()), f"{_DOC} SELECT event_id FROM t WHERE kind IS NOT NULL"),
    "json_is_null": (_json(lambda k: k.is_null()), f"{_DOC} SELECT event_id FROM t WHERE kind IS NULL OR kind = 'NULL'"),
    "json_number_gt": (_json(lambda k: p.gt(k.number(), 4.0)), f"{_DOC} SELECT event_id FROM t WHERE {_NUMBER} > 4"),
    "json_number_not": (_json(lambda k: p.not_(p.gt(k.number(), 4.0))), f"{_DOC} SELECT event_id FROM t WHERE NOT coalesce({_NUMBER} > 4, false)"),
    "json_string_eq": (_json(lambda k: p.eq(k.string(), "5")), f"{_DOC} SELECT event_id FROM t WHERE kind = 'VARCHAR' AND v = '5'"),
}
