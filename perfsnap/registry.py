"""The queries checked against the driver tables, and their SQL counterparts.

Each entry is a function of (session, folder) and, where the result can be
written in SQL, a statement over the same parquet tables. Every query reads
whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsnap.bindings import VIEWS, with_views
from perfsnap.functions import values
from perfsnap.operators import analytics, cleaning, health, ranges, ranking, rollups

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


# ---- inputs ---------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding of the driver tables to a section table."""
    sql = VIEWS[name]
    for t in ("lineitem", "events", "customer", "nation"):
        if t in sql:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def top_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_top_sql")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.type_metrics(view(spark, sf_dir, "v_main_metrics").withColumnRenamed("end_ts", "end"))


def plain(df: DataFrame) -> DataFrame:
    """Exact decimals as DOUBLE and lists as text, for comparison across engines."""
    out = {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind.startswith("decimal"):
            out[f.name] = F.col(f.name).cast("double")
        elif kind == "array<string>":
            out[f.name] = F.array_join(f.name, ",")
        elif kind.startswith("timestamp"):
            out[f.name] = F.date_format(f.name, "yyyy-MM-dd HH:mm")
    return df.withColumns(out) if out else df


# ---- SQL analytics --------------------------------------------------------

TREND = """
SELECT {keys}, SQL_ID, min(PARSING_SCHEMA_NAME) AS schema, min(MODULE) AS module, min(COMMAND_NAME) AS command,
 count(distinct SNAP_ID) AS snaps, cast(sum(EXECS) as bigint) AS total_execs,
 cast(sum(CPU_T_S) as double) AS total_cpu_s, cast(sum(ELAP_S) as double) AS total_elapsed_s,
 cast(sum(BUFFER_GETS) as bigint) AS total_buffer_gets, cast(sum(READ_MB) as bigint) AS total_read_mb,
 cast(sum(IO_WAIT) as double) AS total_io_wait_s, cast(sum(PHY_READ_GB) as double) AS total_physical_read_gb,
 cast(sum(DIRECT_W_GB) as double) AS total_direct_w_gb,
 max(PLAN_CHANGE) AS max_plan_changes, max(PLANS) AS plans_seen
FROM {source} GROUP BY {keys}, SQL_ID
"""

YEARLY = f"(SELECT *, cast(floor((SNAP_ID - 3001) / 12) as int) AS period FROM v_top_sql) t"


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top SQL with the year of its snapshot as a second key."""
    return top_sql(spark, sf_dir).withColumn("period", F.floor((F.col("SNAP_ID") - 3001) / 12).cast("int"))


PERIOD = ("db_id", "period")


@query("sql_trend_range", with_views(TREND.format(keys="db_id", source="v_top_sql"), "v_top_sql"))
def sql_trend_range(spark, sf_dir):
    return plain(analytics.ranked_by_elapsed(analytics.sql_trend_over_range(top_sql(spark, sf_dir))))


# A closed range of snapshots given as numbers, and the order of lines in a dump.
LOW, HIGH = 3010, 3050
IN_RANGE = f"(SELECT * FROM v_top_sql WHERE SNAP_ID BETWEEN {LOW} AND {HIGH}) t"
FILE_ORDER = ("SNAP_ID", "l_orderkey", "l_partkey", "ELAP_RANK")
FIRST_NAMED = {f"min({c})": f"arg_min({c}, row({', '.join(FILE_ORDER)}))" for c in ("PARSING_SCHEMA_NAME", "MODULE", "COMMAND_NAME")}


def first_named(sql: str) -> str:
    for least, first in FIRST_NAMED.items():
        sql = sql.replace(least, first)
    return sql


@query("sql_trend_snaps", with_views(first_named(TREND.format(keys="db_id", source=IN_RANGE)), "v_top_sql"))
def sql_trend_snaps(spark, sf_dir):
    """Totals over a literal range, with the names that come first in file order."""
    return plain(analytics.sql_trend_over_range(top_sql(spark, sf_dir), LOW, HIGH, order=FILE_ORDER))


@query("sql_trend_periods", with_views(TREND.format(keys="db_id, period", source=YEARLY), "v_top_sql"))
def sql_trend_periods(spark, sf_dir):
    return plain(analytics.sql_trend_over_range(yearly(spark, sf_dir), keys=PERIOD))


REQUESTED = """(SELECT r.request_id, t.* FROM v_top_sql t JOIN (
 SELECT concat(db_id, '-all') AS request_id, db_id, min(SNAP_ID) AS lo, max(SNAP_ID) AS hi FROM v_top_sql GROUP BY db_id
 UNION ALL SELECT concat(db_id, '-late') AS request_id, db_id, cast(floor((min(SNAP_ID) + max(SNAP_ID)) / 2) as bigint) AS lo,
  max(SNAP_ID) AS hi FROM v_top_sql GROUP BY db_id
) r ON t.db_id = r.db_id AND t.SNAP_ID BETWEEN r.lo AND r.hi) t"""


def all_and_late(sql):
    """Requests for the whole range of each database and for its second half."""
    whole = rollups.snap_range(sql)
    middle = F.floor((F.col("start_snap") + F.col("end_snap")) / 2).cast("bigint")
    return whole.select(
        "db_id",
        F.inline(F.array(
            F.struct(F.concat("db_id", F.lit("-all")).alias("request_id"), "start_snap", "end_snap"),
            F.struct(F.concat("db_id", F.lit("-late")).alias("request_id"), middle.alias("start_snap"), "end_snap"),
        )),
    )


@query("sql_trend_requests", with_views(TREND.format(keys="request_id, db_id", source=REQUESTED), "v_top_sql"))
def sql_trend_requests(spark, sf_dir):
    sql = top_sql(spark, sf_dir)
    # Dealt by database for the join, rows lie as the totals of each request need them.
    asked = analytics.rows_in_requests(sql.repartition("db_id"), all_and_late(sql))
    return plain(analytics.sql_trend_over_range(asked, keys=("request_id", "db_id"), spread=True))


MANY = """(SELECT r.request_id, t.* FROM v_top_sql t JOIN (
 SELECT concat(db_id, '-', cast(i as varchar(9))) AS request_id, db_id, lo + 7 * i AS lo, lo + 7 * i + 3 * (i % 9) AS hi
 FROM (SELECT db_id, min(SNAP_ID) AS lo FROM v_top_sql GROUP BY db_id) d, range(12) n(i)
) r ON t.db_id = r.db_id AND t.SNAP_ID BETWEEN r.lo AND r.hi) t"""


def many_ranges(sql):
    """Twelve overlapping ranges of many lengths for each database."""
    i = F.explode(F.sequence(F.lit(0), F.lit(11)))
    start = F.col("lo") + 7 * F.col("i")
    return sql.groupBy("db_id").agg(F.min("SNAP_ID").alias("lo")).select("db_id", "lo", i.alias("i")).select(
        F.concat_ws("-", "db_id", F.col("i").cast("string")).alias("request_id"), "db_id", start.alias("start_snap"), (start + 3 * (F.col("i") % 9)).alias("end_snap"))


@query("sql_trend_blocks", with_views(TREND.format(keys="request_id, db_id", source=MANY), "v_top_sql"))
def sql_trend_blocks(spark, sf_dir):
    """Trends of many overlapping ranges, from blocks of snapshots."""
    sql = top_sql(spark, sf_dir)
    return plain(ranges.sql_trend_in_requests(sql, many_ranges(sql)))


@query("distinct_in_requests", with_views(f"""
SELECT request_id, db_id, count(distinct SQL_ID) AS exact_sql, count(distinct PARSING_SCHEMA_NAME) AS exact_schemas,
 true AS sql_within_2_percent, true AS schemas_within_2_percent FROM {REQUESTED} GROUP BY 1, 2""", "v_top_sql"))
def distinct_in_requests(spark, sf_dir):
    """Sketches of each range beside the exact counts, and whether they are within 2 %."""
    sql = top_sql(spark, sf_dir)
    requests = all_and_late(sql)
    exact = analytics.rows_in_requests(sql, requests).groupBy("request_id", "db_id").agg(
        F.count_distinct("SQL_ID").alias("exact_sql"), F.count_distinct("PARSING_SCHEMA_NAME").alias("exact_schemas"))
    both = exact.join(ranges.distinct_in_requests(sql, requests), ["request_id", "db_id"], "left")
    near = lambda kind: (F.abs(F.col(f"distinct_{kind}") - F.col(f"exact_{kind}")) <= 0.02 * F.col(f"exact_{kind}")).alias(f"{kind}_within_2_percent")
    return both.select("request_id", "db_id", "exact_sql", "exact_schemas", near("sql"), near("schemas"))


PLAN_CHANGES = """
SELECT db_id, period, SQL_ID,
 min(PLANS) AS min_plans, max(PLANS) AS max_plans, max(PLAN_CHANGE) AS max_plan_change,
 count(distinct SNAP_ID) AS snaps, cast(sum(ELAP_S) as double) AS total_elapsed_s, cast(sum(CPU_T_S) as double) AS total_cpu_s,
 coalesce(string_agg(distinct PARSING_SCHEMA_NAME, ',' ORDER BY PARSING_SCHEMA_NAME), '') AS schemas,
 coalesce(string_agg(distinct MODULE, ',' ORDER BY MODULE), '') AS modules,
 coalesce(string_agg(distinct PLAN_HASH, ',' ORDER BY PLAN_HASH), '') AS plan_hashes
FROM {source} GROUP BY db_id, period, SQL_ID
HAVING max(PLAN_CHANGE) > 0 OR max(PLANS) > 1 OR count(distinct PLAN_HASH) > 1
"""


@query("plan_change_detect", with_views(PLAN_CHANGES.format(source=YEARLY), "v_top_sql"))
def plan_change_detect(spark, sf_dir):
    return plain(analytics.detect_sql_plan_changes(yearly(spark, sf_dir), keys=PERIOD))


@query("plan_change_snaps", with_views(PLAN_CHANGES.format(source=f"(SELECT * FROM {YEARLY} WHERE SNAP_ID BETWEEN {LOW} AND {HIGH}) r"), "v_top_sql"))
def plan_change_snaps(spark, sf_dir):
    """Changed plans within a literal range."""
    return plain(analytics.detect_sql_plan_changes(yearly(spark, sf_dir), LOW, HIGH, PERIOD))


@query("plan_change_blocks", with_views(PLAN_CHANGES.format(source=MANY).replace("period", "request_id"), "v_top_sql"))
def plan_change_blocks(spark, sf_dir):
    """Changed plans in many overlapping ranges, from blocks of snapshots."""
    sql = top_sql(spark, sf_dir)
    return plain(ranges.plan_changes_in_requests(sql, many_ranges(sql)))


LABELS = """
SELECT *, CASE WHEN labels = '' THEN 'Mixed/Other' ELSE labels END AS bottleneck_class FROM (
 SELECT *, concat_ws(',',
  CASE WHEN total_elapsed_s > 0 AND total_cpu_s / total_elapsed_s > 0.7 AND total_cpu_s > 10 THEN 'CPU-bound' END,
  CASE WHEN total_io_wait_s > 10 AND (total_read_mb > 100 OR total_physical_read_gb > 1.0) THEN 'IO-bound' END,
  CASE WHEN total_direct_w_gb > 5 THEN 'PX-intensive' END,
  CASE WHEN max_plan_changes > 0 OR plans_seen > 1 THEN 'Plan-change-risk' END,
  CASE WHEN total_elapsed_s < 10 AND total_cpu_s < 5 AND total_execs < 10 THEN 'Low-impact' END) AS labels
 FROM ({trend}) trend) labelled
"""
LABELLED = LABELS.format(trend=TREND.format(keys="db_id, period", source=YEARLY))


@query("bottleneck_labels", with_views(f"SELECT * EXCLUDE (labels) FROM ({LABELLED}) x", "v_top_sql"))
def bottleneck_labels(spark, sf_dir):
    return plain(analytics.classify_all_sql_in_range(yearly(spark, sf_dir), keys=PERIOD))


DISTRIBUTION = f"""
SELECT db_id, period, label, n_sql, row_number() OVER (PARTITION BY db_id, period ORDER BY place) AS seen_order FROM (
 SELECT db_id, period, label, count(*) AS n_sql, min(row(-total_elapsed_s, SQL_ID, pos)) AS place FROM (
  SELECT db_id, period, SQL_ID, total_elapsed_s, unnest(string_split(bottleneck_class, ',')) AS label,
   generate_subscripts(string_split(bottleneck_class, ','), 1) AS pos FROM ({LABELLED}) x) y
 GROUP BY 1,2,3) z
"""


@query("bottleneck_distribution", with_views(DISTRIBUTION, "v_top_sql"))
def bottleneck_distribution(spark, sf_dir):
    classified = analytics.classify_all_sql_in_range(yearly(spark, sf_dir), keys=PERIOD)
    return analytics.label_distribution(classified, PERIOD).withColumn("seen_order", F.col("seen_order").cast("bigint"))


TOP5 = f"""
SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY db_id ORDER BY total_elapsed_s DESC, SQL_ID) as int) AS rank
 FROM ({TREND.format(keys="db_id", source="v_top_sql")}) t) u WHERE rank <= 5
"""


@query("trend_top5", with_views(TOP5, "v_top_sql"))
def trend_top5(spark, sf_dir):
    return plain(analytics.heaviest(analytics.sql_trend_over_range(top_sql(spark, sf_dir)), 5))


@query("aggregate_counts", with_views(
    f"SELECT db_id, count(*) AS n_entries, count(distinct SQL_ID) AS n_sql FROM "
    f"({TREND.format(keys='db_id', source='v_top_sql')}) t GROUP BY db_id", "v_top_sql"))
def aggregate_counts(spark, sf_dir):
    return analytics.aggregate_counts(analytics.sql_trend_over_range(top_sql(spark, sf_dir)))


SUMMARY = """
SELECT b.*, coalesce(m.MODULE, 'N/A') AS top_module, h.SQL_ID AS top_sql_id, cast(h.ELAP_S as double) AS top_elapsed_s,
 cast(h.CPU_T_S as double) AS top_cpu_s, h.EXECS AS top_execs, h.BUFFER_GETS AS top_buffer_gets
FROM (
 SELECT db_id, SNAP_ID, cast(sum(ELAP_S) as double) AS total_elapsed_s, cast(sum(CPU_T_S) as double) AS total_cpu_s,
  cast(sum(EXECS) as bigint) AS total_execs, count(distinct SQL_ID) AS unique_sql,
  count(distinct PARSING_SCHEMA_NAME) AS unique_schemas, count(*) FILTER (PLAN_CHANGE > 0) AS plan_change_rows
 FROM v_top_sql GROUP BY 1,2) b
LEFT JOIN (SELECT db_id, SNAP_ID, MODULE, row_number() OVER (PARTITION BY db_id, SNAP_ID ORDER BY count(*) DESC, MODULE) AS rn
 FROM v_top_sql WHERE MODULE IS NOT NULL GROUP BY 1,2,3) m ON b.db_id = m.db_id AND b.SNAP_ID = m.SNAP_ID AND m.rn = 1
JOIN (SELECT *, row_number() OVER (PARTITION BY db_id, SNAP_ID ORDER BY ELAP_RANK, ELAP_S DESC, SQL_ID, l_orderkey) AS rn
 FROM v_top_sql) h ON b.db_id = h.db_id AND b.SNAP_ID = h.SNAP_ID AND h.rn = 1
"""


@query("snapshot_sql_summary", with_views(SUMMARY, "v_top_sql"))
def snapshot_sql_summary(spark, sf_dir):
    return plain(analytics.summarize_top_sql(top_sql(spark, sf_dir)))


RANKS = """
SELECT db_id, SNAP_ID, SQL_ID, ELAP_RANK, cast(ELAP_S as double) AS ELAP_S, l_orderkey, l_partkey,
 cast(row_number() OVER (PARTITION BY db_id, SNAP_ID ORDER BY ELAP_RANK, ELAP_S DESC, SQL_ID, l_orderkey, l_partkey) as int) AS sql_rank
FROM v_top_sql
"""


@query("snapshot_sql_rank", with_views(RANKS, "v_top_sql"))
def snapshot_sql_rank(spark, sf_dir):
    rows = top_sql(spark, sf_dir).select("db_id", "SNAP_ID", "SQL_ID", "ELAP_RANK", "ELAP_S", "l_orderkey", "l_partkey")
    return plain(analytics.sql_snapshots_ranked(rows, tie=("SQL_ID", "l_orderkey", "l_partkey")))


# ---- cleaning and typing --------------------------------------------------

DIGITS = "regexp_replace(props, '[^0-9]', '', 'g')"

DIRTY = f"""SELECT event_id, event_type,
 CASE event_type WHEN 'click' THEN concat(' ', {DIGITS}, ' ') WHEN 'view' THEN concat({DIGITS}, '%')
  WHEN 'error' THEN concat('1,', {DIGITS}) WHEN 'signup' THEN concat({DIGITS}, 'd') ELSE concat('-', {DIGITS}, '.5e1') END AS raw
FROM events"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers in the event properties, most of them written badly."""
    digits = F.regexp_replace("props", "[^0-9]", "")
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", F.concat(F.lit(" "), digits, F.lit(" ")))
        .when(kind == "view", F.concat(digits, F.lit("%")))
        .when(kind == "error", F.concat(F.lit("1,"), digits))
        .when(kind == "signup", F.concat(digits, F.lit("d")))
        .otherwise(F.concat(F.lit("-"), digits, F.lit(".5e1")))
    )
    return table(spark, sf_dir, "events").select("event_id", "event_type", raw.alias("raw"))


@query("numeric_sanitize", f"""
SELECT event_id, event_type, CASE WHEN regexp_full_match(trim(raw), '-?[0-9]+(\\.[0-9]+)?(e[0-9]+)?')
 THEN cast(trim(raw) as double) ELSE 0.0 END AS raw FROM ({DIRTY}) d""")
def numeric_sanitize(spark, sf_dir):
    return cleaning.sanitize_numeric(dirty(spark, sf_dir), ["RAW", "absent"])


@query("majority_numeric", f"""
SELECT column_name, n_values, n_numeric, n_numeric >= greatest(1, n_values // 2) AS is_numeric FROM (
 SELECT 'raw' AS column_name, count(*) AS n_values, count(*) FILTER (
  regexp_full_match(regexp_replace(trim(raw), '[,%]', '', 'g'), '-?[0-9]+(\\.[0-9]+)?(e[0-9]+)?')) AS n_numeric FROM ({DIRTY}) d
 UNION ALL SELECT 'event_type', count(*), 0 FROM events) t""")
def majority_numeric(spark, sf_dir):
    return cleaning.majority_numeric(dirty(spark, sf_dir), ["raw", "event_type"])


@query("metrics_typed", with_views("""
SELECT db_id, cast(snap as bigint) AS snap, inst, cast(dur_m as bigint) AS dur_m, strftime(end_ts, '%Y-%m-%d %H:%M') AS "end",
 strftime(end_ts - INTERVAL 60 MINUTE, '%Y-%m-%d %H:%M') AS start, cast(os_cpu as double) AS os_cpu FROM v_main_metrics""",
    "v_main_metrics"))
def metrics_typed(spark, sf_dir):
    """Metric rows turned into the dump's texts and typed again."""
    as_text = view(spark, sf_dir, "v_main_metrics").select(
        "db_id",
        F.col("snap").cast("string").alias("SNAP_ID"),
        F.col("inst").cast("string").alias("INSTANCE_NUMBER"),
        F.col("dur_m").cast("string").alias("DUR_M"),
        F.date_format("end_ts", "yy/MM/dd HH:mm").alias("END"),
        F.col("os_cpu").cast("string").alias("os_cpu"),
    )
    typed = cleaning.sanitize_numeric(cleaning.type_metrics(as_text), ["os_cpu", "OS_CPU_MAX"])
    return plain(typed.select("db_id", "snap", "inst", "dur_m", "end", "start", "os_cpu"))


@query("first_column_time", """
SELECT concat('t', event_type) AS source_file, event_id, strftime(ts, '%y/%m/%d %H:%M') AS raw_time,
 strftime(ts, '%Y-%m-%d %H:%M') AS parsed FROM events WHERE event_type <> 'view'
UNION ALL SELECT concat('t', event_type), event_id, NULL, NULL FROM events WHERE event_type = 'view'""")
def first_column_time(spark, sf_dir):
    """Each event type is a table; the first column of one holds no times."""
    e = table(spark, sf_dir, "events")
    first = F.when(F.col("event_type") == "view", F.col("event_id").cast("string")).otherwise(
        F.date_format("ts", "yy/MM/dd HH:mm")
    )
    df = e.select(F.concat(F.lit("t"), "event_type").alias("source_file"), "event_id", first.alias("when"))
    out = cleaning.first_column_time(df, "when", "event_id", ["source_file"])
    return out.select(
        "source_file", "event_id", F.col("when_raw").alias("raw_time"),
        F.date_format("when_time", "yyyy-MM-dd HH:mm").alias("parsed"),
    )


@query("os_pivot", with_views("""
SELECT db_id, max(STAT_VALUE) FILTER (STAT_NAME = 'DB_NAME') AS db_name, max(STAT_VALUE) FILTER (STAT_NAME = 'DBID') AS dbid,
 arg_max(STAT_VALUE, line_pos) FILTER (STAT_NAME = 'VERSION') AS version,
 cast(NULL as varchar) AS instances, cast(NULL as varchar) AS hosts,
 max(STAT_VALUE) FILTER (STAT_NAME = 'NUM_CPUS') AS num_cpus,
 cast(NULL as varchar) AS num_cpu_cores, cast(NULL as varchar) AS num_cpu_sockets, cast(NULL as varchar) AS physical_memory_gb,
 max(STAT_VALUE) FILTER (STAT_NAME = '!PLATFORM_NAME') AS platform_name, cast(NULL as varchar) AS cpu_count
FROM v_os_info GROUP BY db_id""", "v_os_info"))
def os_pivot(spark, sf_dir):
    return cleaning.os_wide(view(spark, sf_dir, "v_os_info"))


# ---- metric rollups -------------------------------------------------------


@query("hour_of_day_rollup", with_views("""
SELECT db_id, cast(hour(end_ts) as int) AS hour, count(*) AS n_rows, count(distinct snap) AS n_snaps,
 cast(sum(os_cpu) as double) / count(*) AS avg_os_cpu, cast(max(os_cpu_max) as double) AS max_os_cpu,
 cast(NULL as double) AS avg_read_mb_s, cast(NULL as double) AS avg_write_mb_s, cast(NULL as double) AS avg_read_iops,
 cast(NULL as double) AS avg_write_iops, cast(NULL as double) AS avg_redo_mb_s, cast(NULL as double) AS avg_gc_cr_rec_s,
 cast(NULL as double) AS avg_gc_cu_rec_s
FROM v_main_metrics GROUP BY 1,2""", "v_main_metrics"))
def hour_of_day_rollup(spark, sf_dir):
    return plain(rollups.hour_of_day_rollup(metrics(spark, sf_dir)))


HOURS = "(SELECT DISTINCT db_id, snap AS SNAP_ID, cast(hour(end_ts) as int) AS hour FROM v_main_metrics) h"


@query("hourly_memory", with_views(f"""
SELECT m.db_id, h.hour, m.INSTANCE_NUMBER, cast(sum(SGA) as double)/count(*) AS avg_sga, cast(sum(PGA) as double)/count(*) AS avg_pga
FROM v_memory m JOIN {HOURS} ON m.db_id = h.db_id AND m.SNAP_ID = h.SNAP_ID GROUP BY 1,2,3""", "v_memory", "v_main_metrics"))
def hourly_memory(spark, sf_dir):
    return rollups.hourly_memory(view(spark, sf_dir, "v_memory"), metrics(spark, sf_dir))


@query("hourly_aas", with_views(f"""
SELECT m.db_id, h.hour, m.WAIT_CLASS, cast(sum(AVG_SESS) as double)/count(*) AS avg_sess
FROM v_aas m JOIN {HOURS} ON m.db_id = h.db_id AND m.SNAP_ID = h.SNAP_ID GROUP BY 1,2,3""", "v_aas", "v_main_metrics"))
def hourly_aas(spark, sf_dir):
    return rollups.hourly_active_sessions(view(spark, sf_dir, "v_aas"), metrics(spark, sf_dir))


@query("snap_time_range", with_views("""
SELECT db_id, cast(min(snap) as bigint) AS start_snap, cast(max(snap) as bigint) AS end_snap,
 strftime(min(end_ts - INTERVAL 60 MINUTE), '%Y-%m-%d %H:%M') AS start_time, strftime(max(end_ts), '%Y-%m-%d %H:%M') AS end_time
FROM v_main_metrics GROUP BY db_id""", "v_main_metrics"))
def snap_time_range(spark, sf_dir):
    return plain(rollups.snap_range(metrics(spark, sf_dir)))


# ---- health ---------------------------------------------------------------


@query("health_status", with_views("""
SELECT db_id, cast(snap as bigint) AS snap, inst, cast(os_cpu as double) AS os_cpu, exec_s AS cache_hit,
 CASE WHEN os_cpu > 90 THEN 'critical' WHEN os_cpu > 80 THEN 'warning' ELSE 'healthy' END AS cpu_status,
 CASE WHEN exec_s < 90 THEN 'memory issue' ELSE 'healthy' END AS cache_status FROM v_main_metrics""", "v_main_metrics"))
def health_status(spark, sf_dir):
    m = metrics(spark, sf_dir).select("db_id", "snap", "inst", "os_cpu", F.col("exec_s").alias("cache_hit"))
    return plain(health.health_status(m))


@query("snap_deltas", with_views("""
SELECT * EXCLUDE (m, sd), round(abs(delta - m) / nullif(sd, 0), 6) AS z,
 coalesce(abs(delta - m) / nullif(sd, 0) > 2, false) AS significant
FROM (
 SELECT *, avg(delta) OVER (PARTITION BY db_id) AS m, stddev_samp(delta) OVER (PARTITION BY db_id) AS sd FROM (
  SELECT db_id, inst, snap, os_cpu, prev_snap, prev_os_cpu, delta, round(delta * 100 / nullif(abs(prev_os_cpu), 0), 6) AS pct FROM (
   SELECT db_id, inst, cast(snap as bigint) AS snap, cast(os_cpu as double) AS os_cpu,
    cast(lag(snap) OVER w as bigint) AS prev_snap, cast(lag(os_cpu) OVER w as double) AS prev_os_cpu,
    cast(os_cpu - lag(os_cpu) OVER w as double) AS delta
   FROM v_main_metrics WINDOW w AS (PARTITION BY db_id, inst ORDER BY snap)) a) b) c""", "v_main_metrics"))
def snap_deltas(spark, sf_dir):
    out = plain(health.snap_deltas(metrics(spark, sf_dir), "os_cpu"))
    return out.withColumns({"z": F.round("z", 6), "pct": F.round("pct", 6)})


@query("metric_corr", with_views("""
SELECT db_id, count(*) AS n_rows,
 round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS corr_os_cpu_exec_s,
 round(covar_pop(a, c) / nullif(stddev_pop(a) * stddev_pop(c), 0), 6) AS corr_os_cpu_os_cpu_max
FROM (SELECT db_id, cast(os_cpu as double) AS a, cast(exec_s as double) AS b, cast(os_cpu_max as double) AS c
 FROM v_main_metrics) t GROUP BY db_id""", "v_main_metrics"))
def metric_corr(spark, sf_dir):
    out = health.metric_correlation(metrics(spark, sf_dir), [("os_cpu", "exec_s"), ("os_cpu", "os_cpu_max")])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("corr_")})


RELATIONS = """
SELECT a.db_id, a.series AS series_a, b.series AS series_b, count(*) AS n_snaps,
 round(cast(count(*) * sum(a.value * b.value) - sum(a.value) * sum(b.value) as double)
  / nullif(sqrt(cast(count(*) * sum(a.value * a.value) - sum(a.value) * sum(a.value) as double))
   * sqrt(cast(count(*) * sum(b.value * b.value) - sum(b.value) * sum(b.value) as double)), 0), 6) AS correlation
FROM s a JOIN s b ON a.db_id = b.db_id AND a.snap = b.snap AND a.series < b.series GROUP BY 1, 2, 3"""


@query("metric_relations", with_views("""
SELECT * FROM (WITH s AS (
 SELECT db_id, cast(snap as bigint) AS snap, 'cpu' AS series, cast(max(os_cpu) as decimal(12,2)) AS value FROM v_main_metrics GROUP BY 1, 2
 UNION ALL SELECT db_id, cast(SNAP_ID as bigint), concat('aas ', WAIT_CLASS), cast(sum(AVG_SESS) as decimal(12,2)) FROM v_aas GROUP BY 1, 2, 3
 UNION ALL SELECT db_id, cast(SNAP_ID as bigint), concat('wait ', EVENT_NAME), cast(sum(TOTAL_TIME_S) as decimal(12,2)) FROM v_top_wait GROUP BY 1, 2, 3)
""" + RELATIONS + ") r", "v_main_metrics", "v_aas", "v_top_wait"))
def metric_relations(spark, sf_dir):
    series = health.metric_series(metrics(spark, sf_dir), view(spark, sf_dir, "v_aas"), view(spark, sf_dir, "v_top_wait"))
    return health.series_relations(series).withColumn("correlation", F.round("correlation", 6))


@query("snap_mentions", with_views("""
SELECT db_id, cast(snap as bigint) AS snap, inst,
 concat('SNAP_ID ', cast(snap as varchar), ' (', strftime(end_ts, '%Y-%m-%d %H:%M'), ')') AS mention FROM v_main_metrics""",
    "v_main_metrics"))
def snap_mentions(spark, sf_dir):
    return metrics(spark, sf_dir).select("db_id", "snap", "inst", health.snap_mention("snap", "end").alias("mention"))
