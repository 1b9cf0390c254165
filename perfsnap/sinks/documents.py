"""The document table: loads that can be repeated without duplicates.

Every load is a folder ``batch=<n>`` of its own, so a load that fails is simply
written again, and no load touches the files of another. A document id may
occur in several batches; the newest one counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsnap.session import written


def _all_batches(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every document.

    Ids that occur in several batches are found on the id column alone and kept
    as a table, by whose size Spark chooses the join.
    """
    rows = _all_batches(spark, path)
    if rows is None:
        raise ValueError(f"no documents in {path}")
    repeated = written(
        rows.groupBy("doc_id").agg(F.max("batch").alias("_newest"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"),
        "repeated",
    )
    newest = F.col("_newest").isNull() | (F.col("batch") == F.col("_newest"))
    return rows.join(repeated, "doc_id", "left").filter(newest).drop("batch", "_newest", "_print")


def last_batch(spark: SparkSession, path: str) -> int:
    rows = _all_batches(spark, path)
    return 0 if rows is None else (rows.agg(F.max("batch")).first()[0] or 0)


def fingerprint(columns: list[str]) -> Column:
    """A digest of a row's columns in the order of their names, nulls included,
    so that a value that moves from one column to another is a change."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def upsert_documents(
    docs: DataFrame, path: str, batch: int | None = None, order: str | None = None,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Add new documents and new versions; documents already stored as they are stay.

    Of an id that occurs twice in ``docs`` the version with the highest ``order``
    is kept, or with equal or no order the one with the highest fingerprint.
    Returns the batch number; pass it again to repeat a load that failed. ``derive``
    adds columns that follow from the others; it sees only the rows that are stored.
    """
    spark = docs.sparkSession
    number = last_batch(spark, path) + 1 if batch is None else batch
    content = [c for c in docs.columns if c != "doc_id"]
    # Texts and vectors are written as they come. What is to stay is settled on ids and
    # fingerprints, and whole rows are grouped only of ids that occur twice.
    load = written(docs.withColumn("_print", fingerprint(content)), "load")
    row = F.struct(*[c for c in load.columns if c != "doc_id"])
    best = F.struct(*([order] if order else []), "_print")
    twice = written(load.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc_id"), "twice")
    same_id = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"])
    several = load.join(twice, same_id(load, twice), "left_semi").groupBy("doc_id").agg(F.max_by(row, best).alias("_row"))
    fresh = load.join(twice, same_id(load, twice), "left_anti").unionByName(several.select("doc_id", "_row.*"))
    stored = _all_batches(spark, path)
    if stored is not None:
        earlier = stored.filter(F.col("batch") < number).groupBy("doc_id").agg(F.max_by("_print", "batch").alias("_stored"))
        ids = written(fresh.select("doc_id", "_print").join(earlier, "doc_id", "left").withColumn(
            "_same", F.coalesce(F.col("_stored") == F.col("_print"), F.lit(False))).select("doc_id", "_same"), "ids")
        n, same = ids.agg(F.count(F.lit(1)), F.count_if("_same")).first()
        # The shorter of the two lists goes to the rows.
        few = written(ids.filter("_same" if same < n - same else "NOT _same").select("doc_id"), "few")
        fresh = fresh.join(few, same_id(fresh, few), "left_anti" if same < n - same else "left_semi")
    if derive is not None:
        fresh = derive(fresh)
    fresh.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")
    return number
