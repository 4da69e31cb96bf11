"""Tables written to the folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.model import NoSharedFolder
from sediment.session import ship

#: Rows of a few narrow columns up to this number may be broadcast; more go by a shuffle.
MOST_SENT = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; only a local master may do without, in a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise NoSharedFolder(f"spark.checkpoint.dir is unset; executors of {spark.sparkContext.master} share no folder")
    return f"file://{os.path.join(tempfile.gettempdir(), 'sediment-' + spark.sparkContext.applicationId)}"


def stored(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` and read it back: a lineage cut that survives lost executors.

    The files go when the application ends, if nothing removed them before, unless they are to ``keep``.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not keep:
        ending(spark, path)
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ending(spark: SparkSession, path: str) -> str:
    """``path`` as a new folder that goes when the application ends."""
    p, fs = _path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def few(rows: DataFrame) -> DataFrame:
    """``rows``, a written narrow table, marked for broadcast if its counted size allows; else as it is, for a shuffle."""
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


def _path(spark: SparkSession, path: str):
    """A path and the file system of the store it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.getFileStatus(p).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename within one store."""
    (p, fs), (q, _) = _path(spark, old), _path(spark, new)
    fs.mkdirs(q.getParent())
    if not fs.rename(p, q):
        raise OSError(f"{old} could not become {new}")


def replace_folder(spark: SparkSession, new: str, path: str) -> None:
    """Put the finished folder ``new`` in the place of ``path``. At any moment the old or the new one is whole; see ``recover``."""
    move(spark, path, path + ".old")
    move(spark, new, path)
    remove(spark, path + ".old")


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a ``replace_folder`` that a crash cut short."""
    if exists(spark, path + ".old"):
        if exists(spark, path):
            remove(spark, path + ".old")
        else:
            move(spark, path + ".old", path)
