"""Documents that arrive as a stream, kept as a table of the latest version of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigrove.sources.versions import Table


def latest(batch: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows that share a key within a batch, the last one by ``order``."""
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return batch.withColumn("__place", place).where("__place = 1").drop("__place")


def upserting(stream: DataFrame, table: Table, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch into ``table`` and stops when what is there has been read.

    A row replaces the one of its key only if its ``order`` is not older, in whatever batch each of them comes. A
    version is written for each batch; one that runs again after a failure replaces rows by themselves.
    """

    def add(batch: DataFrame, number: int) -> None:
        new = latest(batch, key, order)
        if table.versions():
            old = table.read()
            known = old.join(new.select(key), key, "left_semi")
            new = old.join(new.select(key), key, "left_anti").unionByName(latest(known.unionByName(new), key, order))
        table.write(new)
        table.vacuum()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counting(stream: DataFrame, table: Table, time: str, by: str, checkpoint: str, width: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """Keeps the counts of ``windowed_counts`` in ``table``: a micro-batch brings the windows that it changed."""
    counts = windowed_counts(stream, time, by, width, late)

    def add(batch: DataFrame, number: int) -> None:
        keys = ["start", by]
        table.write(table.read().join(batch.select(keys), keys, "left_anti").unionByName(batch) if table.versions() else batch)
        table.vacuum()

    return counts.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, by, n): rows of tumbling windows; rows later than the watermark are left out."""
    windows = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"))
    return windows.select(F.col("w.start").alias("start"), by, "n")
