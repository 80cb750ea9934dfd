"""A table of vectors with one metric: upserts, deletes, counts and search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions import vectors
from lexigrove.operators import index, neighbours
from lexigrove.sources.versions import Table


class VectorTable:
    """Rows (vec_id, embedding). The metric with which the table was first opened stays."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "cosine") -> None:
        if metric not in vectors.METRICS:
            raise ValueError(f"metric {metric}: one of {sorted(vectors.METRICS)}")
        self.spark, self.table, self._kept = spark, Table(spark, f"{path}/vectors"), Table(spark, f"{path}/metric")
        if not self._kept.versions():
            self._kept.write(spark.createDataFrame([(metric,)], "metric string"))
        self.metric = self._kept.read().first()["metric"]

    def rows(self) -> DataFrame:
        if self.table.versions():
            return self.table.read()
        return self.spark.createDataFrame([], "vec_id long, embedding array<double>")

    def upsert(self, rows: DataFrame) -> None:
        new = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        if not index.repeated_keys(new, "vec_id").isEmpty():
            raise ValueError("null or repeated vec_id in the batch")
        self.table.write(index.upsert(self.rows(), new, "vec_id"))

    def delete(self, ids: DataFrame) -> None:
        self.table.write(self.rows().join(ids, "vec_id", "left_anti"))

    def counts(self) -> DataFrame:
        """(dimensions, n) of the vectors by their length."""
        return self.rows().groupBy(F.size("embedding").alias("dimensions")).agg(F.count("*").alias("n"))

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """(vec_id, score) of the k best by the table's metric."""
        return neighbours.nearest(self.rows(), query, k, self.metric)
