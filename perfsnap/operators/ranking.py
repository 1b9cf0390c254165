"""Ranking, top-n and lag that stay spread out when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfsnap.session import written

MAX_GROUP_ROWS = 2_000_000
KEY_BUCKETS = 65536


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str | None = None) -> DataFrame:
    """The first ``n`` rows per key, or of the whole frame without keys.

    Spark cuts every input partition to its own first ``n`` rows per key before
    the shuffle, so a key holding most rows still sends few.
    """
    rank = name or "_rank"
    if not keys:
        out = df.orderBy(*order).limit(n)
        return out.withColumn(rank, F.row_number().over(Window.orderBy(*order))) if name else out
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
    return out if name else out.drop(rank)


def grouped_row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    max_group_rows: int = MAX_GROUP_ROWS,
    spread: bool | None = None,
) -> DataFrame:
    """``row_number`` per key, exact for groups of any size.

    The largest group is measured first. Groups that fit one task are numbered
    by a window; otherwise rows are range-partitioned by key and order, so one
    group may span many tasks, and numbers are offsets plus local positions.
    ``order`` must be total for the numbering to be repeatable. A caller that
    has measured the groups already passes the outcome as ``spread``.
    """
    if spread is None:
        spread = has_large_group([(df, keys)], max_group_rows)
    if not spread:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return _number_by_ranges(df, keys, order, name)


def has_large_group(
    groups: Sequence[tuple[DataFrame, Sequence[str]]], max_group_rows: int = MAX_GROUP_ROWS
) -> bool:
    """Whether any group of any of the frames has more rows than one task should sort.

    One job over all frames; each is counted where it lies before the shuffle.
    """
    sizes = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select("n") for df, keys in groups]
    return (reduce(DataFrame.unionByName, sizes).agg(F.max("n")).first()[0] or 0) > max_group_rows


def may_have_large_group(df: DataFrame, keys: Sequence[str], max_group_rows: int = MAX_GROUP_ROWS) -> bool:
    """Whether a group may have more rows than one task should sort; false only if none has.

    No group has more rows than its bucket of key hashes, and counting buckets
    shuffles few small rows. The first key alone mostly tells, so it is tried first.
    """
    def large(some: Sequence[str]) -> bool:
        bucket = F.pmod(F.xxhash64(*some), F.lit(KEY_BUCKETS)).alias("bucket")
        return has_large_group([(df.select(bucket), ["bucket"])], max_group_rows)

    return large(keys[:1]) and (len(keys) == 1 or large(keys))


def _number_by_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    # The cut points come from a sample, so they are drawn once and the pieces
    # kept: both the sizes and the rows below read the written table.
    pieces = written(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_piece", F.spark_partition_id()), "pieces"
    )
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*order))
    return (
        pieces.withColumn("_local", local)
        .join(offsets, [*keys, "_piece"])
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("int"))
        .drop("_before", "_local", "_piece")
    )


def lag_within(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    columns: Sequence[str],
    tie: Sequence[str] = (),
    chunk: int = 1024,
    prefix: str = "prev_",
) -> DataFrame:
    """Values of the preceding row per key, ordered by a whole-number position.

    Rows are windowed inside chunks of the position, so a long series is spread
    over tasks; the first row of a chunk takes the last row of the chunk before,
    found among one row per chunk.
    """
    carried = [position, *columns]
    row = F.struct(*carried)
    with_chunk = df.withColumn("_chunk", F.floor(F.col(position) / chunk))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(position, *tie)
    last = with_chunk.groupBy(*keys, "_chunk").agg(F.max_by(row, F.struct(position, *tie)).alias("_last"))
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    carry = last.select(*keys, "_chunk", F.lag("_last").over(over_chunks).alias("_carry"))
    joined = with_chunk.withColumn("_prev", F.lag(row).over(inside)).join(carry, [*keys, "_chunk"], "left")
    previous = F.coalesce("_prev", "_carry")
    return joined.withColumns({f"{prefix}{c}": previous[c] for c in carried}).drop("_prev", "_carry", "_chunk")
