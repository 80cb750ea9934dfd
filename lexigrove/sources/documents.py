"""Reading documents and exporting rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One JSON document a line; lines that hold no object are left out."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"(?s)^\s*\{.*\}\s*$"))
    if schema is None:
        return lines.select(F.col("value").alias("document"))
    return lines.select(F.from_json("value", schema).alias("d")).where("d is not null").select("d.*")


def listed(docs: DataFrame, offset: int = 0, limit: int = 20, key: str = "doc_id") -> DataFrame:
    """A page of documents in the order of their ids as text."""
    return docs.orderBy(F.col(key).cast("string")).offset(offset).limit(limit)


def as_json(docs: DataFrame) -> DataFrame:
    """One column, ``json``: each row as a JSON object, nulls included."""
    return docs.select(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).alias("json"))


def page_as_json(page: DataFrame, *order: str) -> DataFrame:
    """One row, ``json``: the rows of a page as one JSON array, in the order of its columns ``order``. A page is
    small; ``export`` writes tables of any size."""
    rows = F.array_sort(F.collect_list(F.struct(*(F.col(c) for c in order), F.struct(*page.columns).alias("__row"))))
    return page.agg(F.to_json(F.transform(rows, lambda r: r["__row"]), {"ignoreNullFields": "false"}).alias("json"))


def csv_text(column: Column) -> Column:
    """Column: a value as a CSV field; quoted if it holds a comma, a quote or a line feed; null is empty."""
    value = F.coalesce(column.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\n]'), quoted).otherwise(value)


def as_csv(docs: DataFrame) -> DataFrame:
    """One column, ``csv``: each row as a CSV line; arrays, maps and structs as JSON."""
    nested = ("array", "map", "struct")
    fields = [F.to_json(c) if kind.startswith(nested) else F.col(c) for c, kind in docs.dtypes]
    return docs.select(F.concat_ws(",", *map(csv_text, fields)).alias("csv"))


def export(docs: DataFrame, path: str, kind: str = "ndjson") -> None:
    """Writes rows as ndjson, csv (with a header and the same quoting) or parquet; one file a task."""
    if kind == "ndjson":
        docs.write.option("ignoreNullFields", "false").json(path)
    elif kind == "csv":
        nested = ("array", "map", "struct")
        flat = docs.select(*(F.to_json(c).alias(c) if k.startswith(nested) else F.col(c) for c, k in docs.dtypes))
        flat.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif kind == "parquet":
        docs.write.parquet(path)
    else:
        raise ValueError(f"unknown kind of export: {kind}")
