"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, str] = {}  # label by path of the tables that are there


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session may do without: it gets a folder of this
    machine, where on a cluster each executor would write to its own disk and later reads would miss rows."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexigrove-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows to a table in the shared folder and reads them back: no lineage, no lost blocks.

    The table stays, as frames that are read from it are evaluated later; ``drop`` or ``drop_all`` removes it.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    _written[path] = label
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop(df: DataFrame) -> None:
    """Removes the table of a frame that ``stored`` returned; nothing may read it any more."""
    path = getattr(df, "stored_path", None)
    if path and _written.pop(path, None):
        delete(df.sparkSession, path)


def drop_all(spark: SparkSession) -> int:
    """Removes all tables that ``stored`` has written from this driver, once their results are written or
    collected; returns how many."""
    n = len(_written)
    while _written:
        delete(spark, _written.popitem()[0])
    return n
