"""Facets: how often values occur, the commonest values of each field, and numeric summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _flat(value: Column, kind: T.DataType) -> Column:
    """Array of texts: the value's, or those of all elements of arrays at any depth; objects give none, a null "null"."""
    if isinstance(kind, T.ArrayType):
        inner = F.flatten(F.transform(value, lambda x: _flat(x, kind.elementType)))
        return F.when(value.isNull(), F.array(F.lit("null"))).otherwise(inner)
    if isinstance(kind, T.StructType | T.MapType):
        return F.when(value.isNull(), F.array(F.lit("null"))).otherwise(F.array().cast("array<string>"))
    return F.array(F.coalesce(value.cast("string"), F.lit("null")))


def values(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value): values as text. Arrays, also inside arrays, give one row for each element, objects give none,
    and a null gives "null"."""
    pair = lambda f, v: F.struct(F.lit(f).alias("field"), v.alias("value"))
    nested = [f for f in fields if isinstance(rows.schema[f].dataType, T.ArrayType | T.StructType | T.MapType)]
    plain = [pair(f, F.coalesce(F.col(f).cast("string"), F.lit("null"))) for f in fields if f not in nested]
    parts = [F.array(*plain)] if plain else []
    each = lambda f: F.transform(_flat(F.col(f), rows.schema[f].dataType), lambda v: pair(f, v))
    parts += map(each, nested)
    return rows.select(F.explode(F.concat(*parts) if nested else parts[0]).alias("x")).select("x.field", "x.value")


def counts(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value, n) in one pass and one shuffle over all fields."""
    return values(rows, fields).groupBy("field", "value").agg(F.count("*").alias("n"))


def top_counts(rows: DataFrame, fields: Sequence[str], most: int = 100) -> DataFrame:
    """The commonest values of each field, ties by value."""
    best = W.partitionBy("field").orderBy(F.desc("n"), "value")
    return counts(rows, fields).withColumn("place", F.row_number().over(best)).where(F.col("place") <= max(1, most)).drop("place")


def stats(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, min, max, avg, sum, n) of numeric fields; fields without a number give no row."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields))).alias("x")
    each = rows.select(pairs).select("x.field", "x.v").where(F.col("v").isNotNull())
    return each.groupBy("field").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("avg"), F.sum("v").alias("sum"), F.count("v").alias("n"))
