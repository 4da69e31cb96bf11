"""What the operators of this subpackage share: reading, Arrow maps, folds, checkpoints, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.session import ship
from sediment.storage import remove, stored

#: Bytes of input that one Arrow batch may carry to a Python worker.
BATCH_BYTES = 4 << 20

#: Upper-case ASCII letters and their lower-case forms; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader opens the path, so it may lie in any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so long texts don't pile up in a worker, and let workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship(spark)


#: What operators keep in a worker process from task to task, by operator.
KEPT: dict[str, dict] = {}


def forget(owner: str = "") -> None:
    """Drop what operators other than ``owner`` keep in this worker; freed memory goes back to the system."""
    others = [k for k in KEPT if k != owner]
    for k in others:
        KEPT.pop(k).clear()
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, so that a worker, which lives on, holds no more than ``owner`` keeps before and after.

    Workers count to their executor's memory while they are idle too.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(owner)
        yield from run(batches)
        forget(owner)

    return task


def arrow_map(df: DataFrame, fn: Callable[[dict[str, list], int], dict[str, list]], schema: str, binary: tuple[str, ...] = (), owner: str = "") -> DataFrame:
    """Apply ``fn(columns, rows) -> columns`` to each Arrow batch of ``df``.

    Columns named in ``binary`` arrive as bytes of their UTF-8 text, the rest as Python values. What
    ``owner`` has in ``KEPT`` stays from task to task.
    """
    prepare(df.sparkSession)
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {}
            for name, col in zip(batch.schema.names, batch.columns, strict=True):
                cols[name] = (col.cast(pa.binary()) if name in binary else col).to_pylist()
            out = fn(cols, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], _KINDS[k]) for n, k in zip(names, types, strict=True)], names=names)

    types = [x.split()[1] for x in schema.split(",")]
    return df.mapInArrow(tidy(run, owner), schema)


#: Arrow types of the schemas given to ``arrow_map``.
_KINDS = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), "array<float>": pa.list_(pa.float32()),
}


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        remove(df.sparkSession, file.rpartition("/")[0])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: rows (node, component), component the least node.

    Alternating large-star and small-star rounds. Each round is two partial-aggregated minima and
    joins back on the node; the edge set never grows, no list of neighbours is built, and each round
    is written to the shared folder, so a lost executor costs one round.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (mark["n"], mark["s"]) == seen:
            break
        seen = (mark["n"], mark["s"])
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that Spark can send it whole or split a hub's rows in the join.
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        old, e = e, stored(small.distinct(), "edges")
        discard(old)
        discard(least)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
