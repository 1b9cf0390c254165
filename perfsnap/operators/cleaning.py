"""Cleaning and typing of section tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfsnap.functions.text import strip
from perfsnap.functions.values import (
    minutes_before,
    to_any_time,
    to_number,
    to_number_or_zero,
    to_snapshot_time,
    to_whole,
)
from perfsnap.operators.ranking import first_rows


def sanitize_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Listed columns that exist become DOUBLE; bad values become 0.0."""
    present = {c.lower(): c for c in df.columns}
    wanted = {present[c.lower()]: to_number_or_zero(present[c.lower()]) for c in columns if c.lower() in present}
    return df.withColumns(wanted) if wanted else df


def type_metrics(df: DataFrame) -> DataFrame:
    """Names, types and the start time of the main-metrics table.

    ``SNAP_ID``, ``END``, ``DUR_M`` and ``INSTANCE_NUMBER`` take their short
    names unless those exist already; a missing duration leaves ``start`` null.
    """
    short = {"SNAP_ID": "snap", "END": "end", "DUR_M": "dur_m", "INSTANCE_NUMBER": "inst"}
    have = {c.lower() for c in df.columns}
    renames = {c: short[c.upper()] for c in df.columns if c.upper() in short and short[c.upper()] not in have}
    out = df.withColumnsRenamed(renames)
    kinds = {c.lower(): t for c, t in out.dtypes}
    typed = {c: to_whole(c) for c in ("snap", "dur_m") if kinds[c] != "bigint"}
    if "inst" in kinds and kinds["inst"] != "int":
        typed["inst"] = to_whole("inst").cast("int")
    if not kinds["end"].startswith("timestamp"):
        typed["end"] = to_snapshot_time("end")
    if typed:
        out = out.withColumns(typed)
    return out.withColumn("start", minutes_before("end", "dur_m"))


def majority_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: values, convertible values, and whether to convert.

    Thousands commas and percent signs are ignored. A column is numeric when at
    least half of its values, and at least one, convert.
    """
    def convertible(c: str) -> Column:
        bare = F.regexp_replace(strip(F.col(c).cast("string")), "[,%]", "")
        return F.count_if(to_number(bare).isNotNull())

    counts = df.agg(F.count(F.lit(1)).alias("n"), *[convertible(c).alias(f"k{i}") for i, c in enumerate(columns)])
    per_column = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"k{i}").alias("n_numeric")) for i, c in enumerate(columns)]
    )
    return counts.select("n", F.inline(per_column)).select(
        "column_name",
        F.col("n").alias("n_values"),
        "n_numeric",
        (F.col("n_numeric") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2))).alias("is_numeric"),
    )


def convert_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Apply the verdict of ``majority_numeric``; this runs one aggregate job."""
    chosen = [r["column_name"] for r in majority_numeric(df, columns).collect() if r["is_numeric"]]
    return df.withColumns({c: to_number(F.regexp_replace(strip(c), "[,%]", "")) for c in chosen}) if chosen else df


def first_column_time(df: DataFrame, column: str, order: str, keys: Sequence[str]) -> DataFrame:
    """Parse a column as times if its first ten values look like times.

    The text is kept in ``<column>_raw``. ``keys`` names the table a row belongs
    to; each table is judged by its own first ten rows.
    """
    looks = strip(column).rlike(r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|:")
    head = first_rows(df.select(*keys, column, order), keys, [F.col(order)], 10)
    verdict = head.groupBy(*keys).agg(F.bool_or(F.coalesce(looks, F.lit(False))).alias("_is_time"))
    joined = df.join(verdict, list(keys), "left")
    return (
        joined.withColumn(f"{column}_raw", F.when(F.col("_is_time"), F.col(column)))
        .withColumn(f"{column}_time", F.when(F.col("_is_time"), to_any_time(column)))
        .drop("_is_time")
    )


# The environment keys a dump carries, and our column for each.
OS_KEYS = {
    "DB_NAME": "db_name",
    "DBID": "dbid",
    "VERSION": "version",
    "INSTANCES": "instances",
    "HOSTS": "hosts",
    "NUM_CPUS": "num_cpus",
    "NUM_CPU_CORES": "num_cpu_cores",
    "NUM_CPU_SOCKETS": "num_cpu_sockets",
    "PHYSICAL_MEMORY_GB": "physical_memory_gb",
    "!PLATFORM_NAME": "platform_name",
    "!CPU_COUNT": "cpu_count",
}


def os_wide(os_info: DataFrame, keys: Sequence[str] = ("db_id",), order: str = "line_pos") -> DataFrame:
    """One row per database from its name/value rows; the last value of a name wins."""
    name = F.col("STAT_NAME")
    picked = [
        F.max_by(F.when(name == k, F.col("STAT_VALUE")), F.when(name == k, F.col(order))).alias(c)
        for k, c in OS_KEYS.items()
    ]
    return os_info.filter(name.isin(*OS_KEYS)).groupBy(*keys).agg(*picked)
