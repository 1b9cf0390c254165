"""What the corpus operators share: clean input rows, repeated keys, components."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsnap.session import written


def ship(module: types.ModuleType) -> None:
    """Send a module's functions to the executors with the tasks, so that the
    package need not be installed there."""
    cloudpickle.register_pickle_by_value(module)


ship(sys.modules[__name__])


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of fewer rows for the jobs inside, for rows as long as texts or
    sets: a batch lies in the JVM and in a worker, once for each task. The caller's
    setting comes back afterwards."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def rows_by_id(df: DataFrame, key: str, *values: str) -> DataFrame:
    """Only ``key`` and ``values``, one row per key.

    Rows without a key are left out, since no result could name them. Of
    several rows with one key the smallest values count (null before all), so
    repeated rows count once. Other columns, whatever their names, are not read.
    Tables whose keys are already distinct are passed on without a shuffle of
    their values.
    """
    rows = df.select(key, *values)
    n, d = df.agg(F.count(F.lit(1)), F.countDistinct(key)).first()
    if n == d:
        return rows
    least = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*values)).alias("_row"))
    return least.select(key, *[F.col("_row")[v].alias(v) for v in values])


def distinct_rows(df: DataFrame, key: str) -> DataFrame:
    """Whole rows, one per key: rows without a key are left out, of several with
    one key the smallest by the other columns counts. Tables with distinct keys
    are passed on as they are."""
    n, d = df.agg(F.count(F.lit(1)), F.countDistinct(key)).first()
    if n == d:
        return df
    others = [c for c in df.columns if c != key]
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*others)).alias("_row"))
    return least.select(*[F.col(key) if c == key else F.col("_row")[c].alias(c) for c in df.columns])


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, z): texts compressed, for joins that move them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            texts = [z.compress((t.as_py() or "").encode()) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.binary())], names=["doc_id", "z"])

    return docs.mapInArrow(pack, "doc_id long, z binary")


def unpacked(z: pa.Scalar) -> str:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z.as_py()).decode()


def connected(edges: DataFrame) -> DataFrame:
    """Smallest member of every connected component: rows (node, root).

    ``edges`` has whole-number columns ``a`` and ``b``; nodes without an edge do
    not appear. Every round links each node and its larger neighbours to the
    smallest one around it and is written to the shared folder; rounds grow
    with the logarithm of the longest path. The edges never pass the driver.
    """
    def stars(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return large.where("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), "m")
        return moved.where("a <> m").select("a", F.col("m").alias("b")).distinct()

    e = written(edges.select("a", "b").where("a <> b").distinct(), "links")
    while True:
        after = written(small(stars(e)), "links")
        same = [t.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for t in (e, after)]
        e = after
        if same[0] == same[1]:
            break
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
