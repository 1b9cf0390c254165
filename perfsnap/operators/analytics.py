"""SQL statistics over snapshot ranges.

Every function takes the top-SQL table (columns as in the section schema plus
the columns named in ``keys``) and returns one plan; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfsnap.functions.labels import bottleneck_labels
from perfsnap.operators.ranking import first_rows, grouped_row_number, may_have_large_group

DB = ("db_id",)

# Result column -> summed input column.
TREND_SUMS = {
    "total_execs": "EXECS",
    "total_cpu_s": "CPU_T_S",
    "total_elapsed_s": "ELAP_S",
    "total_buffer_gets": "BUFFER_GETS",
    "total_read_mb": "READ_MB",
    "total_io_wait_s": "IO_WAIT",
    "total_physical_read_gb": "PHY_READ_GB",
    "total_direct_w_gb": "DIRECT_W_GB",
}


def in_snap_range(df: DataFrame, start: int | None, end: int | None, snap: str = "SNAP_ID") -> DataFrame:
    """Rows of a closed snapshot range; an open bound keeps everything."""
    if start is not None:
        df = df.filter(F.col(snap) >= start)
    if end is not None:
        df = df.filter(F.col(snap) <= end)
    return df


def rows_in_requests(df: DataFrame, requests: DataFrame, snap: str = "SNAP_ID", keys: Sequence[str] = DB) -> DataFrame:
    """Rows once per requested range (``request_id, <keys>, start_snap, end_snap``) they fall in.

    An equi-join on the database with the range as its condition; ranges may
    overlap, and a database may have any number of them.
    """
    return df.join(requests, list(keys)).filter(F.col(snap).between(F.col("start_snap"), F.col("end_snap")))


def _first_name(column: str, order: Sequence[str] | None) -> Column:
    """First non-null value of a name, in file order or else the smallest."""
    if not order:
        return F.min(column)
    return F.min(F.when(F.col(column).isNotNull(), F.struct(*order, F.col(column).alias("_name"))))["_name"]


def sql_trend_over_range(
    top_sql: DataFrame,
    start_snap: int | None = None,
    end_snap: int | None = None,
    keys: Sequence[str] = DB,
    order: Sequence[str] | None = None,
    spread: bool | None = None,
) -> DataFrame:
    """Totals per SQL over a snapshot range. ``ranked_by_elapsed`` sorts them.

    Rows are dealt by SQL once; snapshots, sums and names come from one sorted pass
    over them. With ``spread`` they are not dealt first: for SQL with more rows than
    one task should sort, which combine before the shuffle, and for rows that are
    dealt by some of the keys already. Unless it is given, the groups are measured.
    """
    names = {"schema": "PARSING_SCHEMA_NAME", "module": "MODULE", "command": "COMMAND_NAME"}
    by = [*keys, "SQL_ID"]
    df = in_snap_range(top_sql, start_snap, end_snap)
    if spread is None:
        spread = may_have_large_group(df, by)
    for c in by:
        df = df.filter(F.col(c).isNotNull())
    # Of a group that fits a task the snapshots are gathered, which spares two passes of a distinct count.
    snaps = F.count_distinct("SNAP_ID") if spread else F.size(F.collect_set("SNAP_ID")).cast("bigint")
    return (df if spread else df.repartition(*by)).groupBy(*by).agg(
        *[_first_name(c, order).alias(n) for n, c in names.items()],
        snaps.alias("snaps"),
        *[F.sum(c).alias(name) for name, c in TREND_SUMS.items()],
        F.max("PLAN_CHANGE").alias("max_plan_changes"),
        F.max("PLANS").alias("plans_seen"),
    )


def by_elapsed() -> list[Column]:
    """Heaviest first; equal totals by SQL_ID."""
    return [F.desc("total_elapsed_s"), F.asc("SQL_ID")]


def ranked_by_elapsed(trend: DataFrame, keys: Sequence[str] = DB) -> DataFrame:
    return trend.orderBy(*keys, *by_elapsed())


def heaviest(trend: DataFrame, n: int, keys: Sequence[str] = DB, name: str = "rank") -> DataFrame:
    """The ``n`` heaviest SQL per key, with their rank."""
    return first_rows(trend, keys, by_elapsed(), n, name)


def sql_snapshots_ranked(
    top_sql: DataFrame, keys: Sequence[str] = DB, tie: Sequence[str] = ("SQL_ID",), name: str = "sql_rank", **limits
) -> DataFrame:
    """SQL of each snapshot in order of the given rank, then elapsed time."""
    return grouped_row_number(top_sql, [*keys, "SNAP_ID"], rank_order(top_sql, tie), name, **limits)


def rank_order(top_sql: DataFrame, tie: Sequence[str] = ("SQL_ID",)) -> list[Column]:
    ranked = "elap_rank" in {c.lower() for c in top_sql.columns}
    first = [F.asc_nulls_last("ELAP_RANK")] if ranked else []
    return [*first, F.desc("ELAP_S"), *[F.asc(t) for t in tie]]


def detect_sql_plan_changes(
    top_sql: DataFrame,
    start_snap: int | None = None,
    end_snap: int | None = None,
    keys: Sequence[str] = DB,
) -> DataFrame:
    """SQL with signs of more than one plan, with its schemas, modules and hashes."""
    df = in_snap_range(top_sql, start_snap, end_snap).filter(F.col("SQL_ID").isNotNull())
    by = [*keys, "SQL_ID"]
    totals = df.groupBy(*by).agg(
        F.min("PLANS").alias("min_plans"),
        F.max("PLANS").alias("max_plans"),
        F.max("PLAN_CHANGE").alias("max_plan_change"),
        F.count_distinct("SNAP_ID").alias("snaps"),
        F.sum("ELAP_S").alias("total_elapsed_s"),
        F.sum("CPU_T_S").alias("total_cpu_s"),
    )

    # Most combinations of names repeat from snapshot to snapshot, so they are
    # made distinct before the values are gathered.
    names = {"schemas": "PARSING_SCHEMA_NAME", "modules": "MODULE", "plan_hashes": "PLAN_HASH"}
    lists = (
        df.select(*by, *names.values()).distinct()
        .groupBy(*by).agg(*[F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(n) for n, c in names.items()])
    )
    signs = (F.col("max_plan_change") > 0) | (F.col("max_plans") > 1) | (F.size("plan_hashes") > 1)
    return totals.join(lists, by).filter(signs)


def plan_change_members(top_sql: DataFrame, keys: Sequence[str] = DB) -> DataFrame:
    """The distinct schemas, modules and plan hashes of each SQL, one per row.

    The long form of the lists, for SQL with more values than fit one row.
    """
    kinds = {"schema": "PARSING_SCHEMA_NAME", "module": "MODULE", "plan": "PLAN_HASH"}
    values = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in kinds.items()]
    )
    # Whole combinations are made distinct before they are unfolded: most
    # repeat from snapshot to snapshot.
    return (
        top_sql.select(*keys, "SQL_ID", *kinds.values())
        .distinct()
        .select(*keys, "SQL_ID", F.inline(values))
        .filter(F.col("value").isNotNull())
        .distinct()
    )


def summarize_top_sql(top_sql: DataFrame, keys: Sequence[str] = DB) -> DataFrame:
    """One row per snapshot: totals, distinct SQL and schemas, usual module, heaviest SQL."""
    by = [*keys, "SNAP_ID"]
    totals = top_sql.groupBy(*by).agg(
        F.sum("ELAP_S").alias("total_elapsed_s"),
        F.sum("CPU_T_S").alias("total_cpu_s"),
        F.sum("EXECS").alias("total_execs"),
        F.count_distinct("SQL_ID").alias("unique_sql"),
        F.count_distinct("PARSING_SCHEMA_NAME").alias("unique_schemas"),
        F.count_if(F.col("PLAN_CHANGE") > 0).alias("plan_change_rows"),
    )
    ranked = [c for c in top_sql.columns if c.lower() == "elap_rank"]
    heaviest_sql = first_rows(
        top_sql.select(*by, "SQL_ID", "ELAP_S", "CPU_T_S", "EXECS", "BUFFER_GETS", *ranked), by, rank_order(top_sql), 1
    ).select(
        *by,
        F.col("SQL_ID").alias("top_sql_id"),
        F.col("ELAP_S").alias("top_elapsed_s"),
        F.col("CPU_T_S").alias("top_cpu_s"),
        F.col("EXECS").alias("top_execs"),
        F.col("BUFFER_GETS").alias("top_buffer_gets"),
    )
    return (
        totals.join(heaviest_sql, by)
        .join(usual_value(top_sql, by, "MODULE", "top_module"), by, "left")
        .withColumn("top_module", F.coalesce("top_module", F.lit("N/A")))
    )


def summarize_ranked(ranked: DataFrame, rank: str, keys: Sequence[str] = DB) -> DataFrame:
    """``summarize_top_sql`` of rows numbered by ``rank`` per snapshot, in one pass over groups that fit a task."""
    first = {"top_sql_id": "SQL_ID", "top_elapsed_s": "ELAP_S", "top_cpu_s": "CPU_T_S", "top_execs": "EXECS", "top_buffer_gets": "BUFFER_GETS"}
    return ranked.groupBy(*keys, "SNAP_ID").agg(
        F.sum("ELAP_S").alias("total_elapsed_s"),
        F.sum("CPU_T_S").alias("total_cpu_s"),
        F.sum("EXECS").alias("total_execs"),
        F.size(F.collect_set("SQL_ID")).cast("bigint").alias("unique_sql"),
        F.size(F.collect_set("PARSING_SCHEMA_NAME")).cast("bigint").alias("unique_schemas"),
        F.count_if(F.col("PLAN_CHANGE") > 0).alias("plan_change_rows"),
        F.max(F.when(F.col(rank) == 1, F.struct(*first.values()))).alias("_first"),
        F.coalesce(F.mode("MODULE", True), F.lit("N/A")).alias("top_module"),
    ).select("*", *[F.col(f"_first.{c}").alias(n) for n, c in first.items()]).drop("_first")


def usual_value(df: DataFrame, by: Sequence[str], column: str, name: str) -> DataFrame:
    """Most frequent non-null value per group, the smallest of equally frequent ones.

    Counted per value first, so the values of a huge group are spread out.
    """
    counted = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*by).agg(F.min_by(column, F.struct((-F.col("n")).alias("n"), F.col(column))).alias(name))


def classify_bottlenecks(trend: DataFrame) -> DataFrame:
    """Add ``bottleneck_class``, the array of labels, to an aggregated table."""
    return trend.withColumn("bottleneck_class", bottleneck_labels(trend.columns))


def classify_all_sql_in_range(
    top_sql: DataFrame,
    start_snap: int | None = None,
    end_snap: int | None = None,
    keys: Sequence[str] = DB,
    order: Sequence[str] | None = None,
) -> DataFrame:
    return classify_bottlenecks(sql_trend_over_range(top_sql, start_snap, end_snap, keys, order))


def label_distribution(classified: DataFrame, keys: Sequence[str] = DB) -> DataFrame:
    """SQL per label, numbered in the order labels first appear by elapsed time."""
    place = F.struct((-F.col("total_elapsed_s")).alias("e"), F.col("SQL_ID").alias("s"), F.col("pos").alias("p"))
    counted = (
        classified.select(*keys, "SQL_ID", "total_elapsed_s", F.posexplode("bottleneck_class").alias("pos", "label"))
        .groupBy(*keys, "label")
        .agg(F.count(F.lit(1)).alias("n_sql"), F.min(place).alias("_seen"))
    )
    seen = F.row_number().over(Window.partitionBy(*keys).orderBy("_seen"))
    return counted.withColumn("seen_order", seen).drop("_seen")


def aggregate_counts(trend: DataFrame, keys: Sequence[str] = DB) -> DataFrame:
    """Entries of the aggregate and distinct SQL among them."""
    return trend.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_entries"), F.count_distinct("SQL_ID").alias("n_sql")
    )
