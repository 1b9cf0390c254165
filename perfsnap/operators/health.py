"""Rules on the metric table: limits, changes between snapshots, relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfsnap.functions.labels import cache_status, cpu_status
from perfsnap.operators.ranking import lag_within
from perfsnap.operators.rollups import DB

SIGNIFICANT_Z = 2.0


def health_status(metrics: DataFrame, cpu: str = "os_cpu", cache_hit: str = "cache_hit") -> DataFrame:
    """Limit checks per row; the cache check only where the column exists."""
    out = metrics.withColumn("cpu_status", cpu_status(cpu))
    if cache_hit in metrics.columns:
        out = out.withColumn("cache_status", cache_status(cache_hit))
    return out


def snap_deltas(
    metrics: DataFrame,
    column: str,
    keys: Sequence[str] = DB,
    instance: str = "inst",
    snap: str = "snap",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Change from the preceding snapshot of the same instance.

    A change is significant when it lies more than two standard deviations from
    the mean change of its database.
    """
    df = metrics.select(*keys, instance, snap, *tie, column)
    value = F.col(column).cast("double")
    changes = (
        lag_within(df, [*keys, instance], snap, [column], tie)
        .withColumn("delta", (F.col(column) - F.col(f"prev_{column}")).cast("double"))
        .withColumn("pct", F.try_divide(F.col("delta") * 100, F.abs(F.col(f"prev_{column}").cast("double"))))
    )
    spread = changes.groupBy(*keys).agg(F.avg("delta").alias("_mean"), F.stddev_samp("delta").alias("_std"))
    z = F.try_divide(F.abs(F.col("delta") - F.col("_mean")), F.col("_std"))
    return (
        changes.join(spread, list(keys), "left")
        .withColumn("z", z)
        .withColumn("significant", F.coalesce(z > SIGNIFICANT_Z, F.lit(False)))
        .withColumn(column, value)
        .drop("_mean", "_std")
    )


def metric_correlation(metrics: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = DB) -> DataFrame:
    """Pearson correlation of metric pairs per database; null where one never varies."""
    def both(a: str, b: str) -> Column:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        whole = x.isNotNull() & y.isNotNull()
        x, y = F.when(whole, x), F.when(whole, y)
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), *[both(a, b).alias(f"corr_{a}_{b}") for a, b in pairs]
    )


def metric_series(metrics: DataFrame, sessions: DataFrame, waits: DataFrame, keys: Sequence[str] = DB, places: int = 2) -> DataFrame:
    """(keys, snap, series, value): CPU, sessions of each wait class and time of each wait event.

    CPU is that of the busiest instance of a snapshot. Values are decimals of
    ``places``, so that sums of products are exact in any order.
    """
    number = lambda c: c.cast(f"decimal(12,{places})").alias("value")
    cpu = metrics.groupBy(*keys, F.col("snap").cast("bigint").alias("snap")).agg(number(F.max("os_cpu")))
    by = lambda df, name, prefix, value: df.groupBy(*keys, F.col("SNAP_ID").cast("bigint").alias("snap"), F.concat(F.lit(prefix), name).alias("series")).agg(number(F.sum(value)))
    every = cpu.withColumn("series", F.lit("cpu")).unionByName(by(sessions, "WAIT_CLASS", "aas ", "AVG_SESS")).unionByName(by(waits, "EVENT_NAME", "wait ", "TOTAL_TIME_S"))
    return every.filter(F.col("snap").isNotNull() & F.col("series").isNotNull() & F.col("value").isNotNull())


def series_relations(series: DataFrame, keys: Sequence[str] = DB) -> DataFrame:
    """(keys, series_a, series_b, n_snaps, correlation) of any two series of a database
    over the snapshots that have both; null where one never varies.

    Series meet within their snapshot, which holds few, and leave it as co-moments:
    sums that combine before and after the shuffle, so a database with very many
    snapshots is spread over all tasks and read once.
    """
    gathered = series.groupBy(*keys, "snap").agg(F.sort_array(F.collect_list(F.struct("series", "value"))).alias("s"))
    pairs = gathered.select(*keys, F.posexplode("s").alias("i", "a"), "s").select(*keys, "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    a, b, n = F.col("a.value"), F.col("b.value"), F.col("n_snaps")
    sums = {"sa": a, "sb": b, "saa": a * a, "sbb": b * b, "sab": a * b}
    moments = pairs.groupBy(*keys, F.col("a.series").alias("series_a"), F.col("b.series").alias("series_b")).agg(
        F.count(F.lit(1)).alias("n_snaps"), *[F.sum(c).alias(name) for name, c in sums.items()])
    spread = lambda square, total: F.sqrt((n * F.col(square) - F.col(total) * F.col(total)).cast("double"))
    shared = (n * F.col("sab") - F.col("sa") * F.col("sb")).cast("double")
    return moments.select(*keys, "series_a", "series_b", "n_snaps", F.try_divide(shared, spread("saa", "sa") * spread("sbb", "sb")).alias("correlation"))


def snap_mention(snap: Column | str, end: Column | str) -> Column:
    """How a snapshot is named in text: its number and minute."""
    s = F.col(snap) if isinstance(snap, str) else snap
    e = F.col(end) if isinstance(end, str) else end
    return F.concat(F.lit("SNAP_ID "), s.cast("string"), F.lit(" ("), F.date_format(e, "yyyy-MM-dd HH:mm"), F.lit(")"))
