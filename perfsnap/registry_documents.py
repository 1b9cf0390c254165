"""Registered queries on documents, retrieval, contexts, prompts and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from perfsnap.bindings import with_views
from perfsnap.operators import analytics, cleaning, context, docs, prompts, retrieval, rollups
from perfsnap.plans import pipeline
from perfsnap.registry import LABELLED, PERIOD, PLAN_CHANGES, TREND, YEARLY, metrics, plain, query, table, top_sql, view, yearly
from perfsnap.session import scratch_path, written
from perfsnap.sinks import documents as store
from perfsnap.sinks import sections as reports

SQL_TIE = ("SQL_ID", "l_orderkey", "l_partkey")


def num(x: str, places: int = 3) -> str:
    """DuckDB text of a number as the documents show it."""
    return f"rtrim(rtrim(cast(cast({x} as decimal(38,{places})) as varchar), '0'), '.')"


def shown(x: str) -> str:
    return f"coalesce({num(x)}, 'N/A')"


def mean_text(total: str, n: str = "count(*)") -> str:
    """DuckDB text of the mean of values with two decimals, rounded half up to three in whole numbers."""
    thousandths = f"((cast({total} * 100 as bigint) * 20 + {n}) // (2 * {n}))"
    return (
        f"rtrim(rtrim(concat(cast({thousandths} // 1000 as varchar), '.', lpad(cast({thousandths} % 1000 as varchar), 3, '0')), '0'), '.')"
    )


def sections(spark, sf_dir):
    return (
        metrics(spark, sf_dir),
        view(spark, sf_dir, "v_memory"),
        view(spark, sf_dir, "v_aas"),
        view(spark, sf_dir, "v_top_wait"),
        top_sql(spark, sf_dir),
        cleaning.os_wide(view(spark, sf_dir, "v_os_info")),
    )


ALL_VIEWS = ("v_main_metrics", "v_memory", "v_aas", "v_top_wait", "v_top_sql", "v_os_info")

OS_DIM = """(SELECT db_id, max(STAT_VALUE) FILTER (STAT_NAME = 'DB_NAME') AS db_name, max(STAT_VALUE) FILTER (STAT_NAME = 'DBID') AS dbid,
 arg_max(STAT_VALUE, line_pos) FILTER (STAT_NAME = 'VERSION') AS version,
 max(STAT_VALUE) FILTER (STAT_NAME = 'NUM_CPUS') AS num_cpus,
 max(STAT_VALUE) FILTER (STAT_NAME = '!PLATFORM_NAME') AS platform_name FROM v_os_info GROUP BY db_id)"""

# ---- joins and documents --------------------------------------------------


@query("snapshot_join", with_views(f"""
SELECT m.db_id, m.snap, m.inst, cast(m.os_cpu as double) AS os_cpu, mem.SGA, mem.PGA, mem.TOTAL, a.n_sessions, a.sum_avg_sess,
 w.n_waits, w.sum_wait_s, s.n_sql_rows, s.sum_elapsed_s, o.db_name, o.platform_name
FROM v_main_metrics m
LEFT JOIN v_memory mem ON m.db_id = mem.db_id AND m.snap = mem.SNAP_ID AND m.inst = mem.INSTANCE_NUMBER
LEFT JOIN (SELECT db_id, SNAP_ID, count(*) AS n_sessions, cast(sum(AVG_SESS) as double) AS sum_avg_sess FROM v_aas GROUP BY 1,2) a
 ON m.db_id = a.db_id AND m.snap = a.SNAP_ID
LEFT JOIN (SELECT db_id, SNAP_ID, count(*) AS n_waits, cast(sum(TOTAL_TIME_S) as double) AS sum_wait_s FROM v_top_wait GROUP BY 1,2) w
 ON m.db_id = w.db_id AND m.snap = w.SNAP_ID
LEFT JOIN (SELECT db_id, SNAP_ID, count(*) AS n_sql_rows, cast(sum(ELAP_S) as double) AS sum_elapsed_s FROM v_top_sql GROUP BY 1,2) s
 ON m.db_id = s.db_id AND m.snap = s.SNAP_ID
LEFT JOIN {OS_DIM} o ON m.db_id = o.db_id""", *ALL_VIEWS))
def snapshot_join(spark, sf_dir):
    out = docs.snapshot_join(*sections(spark, sf_dir))
    return plain(out.drop("os_cpu_max", "exec_s", "dur_m", "end", "start"))


@query("os_documents", with_views(f"""
SELECT db_id, concat_ws(chr(10), 'Environment', 'Database: ' || coalesce(db_name, 'N/A'), 'Version: ' || coalesce(version, 'N/A'),
 'Instances: N/A', 'Hosts: N/A', 'CPUs: ' || coalesce(num_cpus, 'N/A'), 'CPU cores: N/A', 'CPU sockets: N/A', 'Memory (GB): N/A',
 'Platform: ' || coalesce(platform_name, 'N/A')) AS content, sha256(concat_ws('|', 'os_info', db_id, '', '', '', '0')) AS doc_id
FROM {OS_DIM} o""", "v_os_info"))
def os_documents(spark, sf_dir):
    os_dim = cleaning.os_wide(view(spark, sf_dir, "v_os_info"))
    return docs.os_documents(os_dim).select("db_id", "content", "doc_id")


SQL_TEXT = f"""concat(cast(ELAP_RANK as varchar), '. SQL ', SQL_ID, ': schema ', PARSING_SCHEMA_NAME, ', module ', coalesce(MODULE, 'N/A'),
 ', command ', COMMAND_NAME, ', executions ', {num('EXECS')}, ', buffer gets ', {num('BUFFER_GETS')}, ', rows ', {num('ROWS_PROC')},
 ', CPU ', {num('CPU_T_S')}, ' s, elapsed ', {num('ELAP_S')}, ' s, read ', {num('READ_MB')}, ' MB, I/O wait ', {num('IO_WAIT')},
 ' s, physical read ', {num('PHY_READ_GB')}, ' GB, direct write ', {num('DIRECT_W_GB')}, ' GB, PX servers N/A, plan ', PLAN_HASH,
 ', plan changes ', {num('PLAN_CHANGE')}, ', plans ', {num('PLANS')})"""

WAIT_TEXT = f"concat(EVENT_NAME, ' (', WAIT_CLASS, '): ', {num('PCTDBT')}, ' % of DB time, ', {num('TOTAL_TIME_S')}, ' s')"

SUMMARY_TEXT = f"""concat_ws(' ', concat(cast(unique_sql as varchar), ' SQL took ', {num('elapsed', 1)}, ' s, of it ', {num('cpu', 1)}, ' s CPU.'),
 concat(cast(execs as varchar), ' executions from ', cast(unique_schemas as varchar), ' schemas; usual module ', top_module, '.'),
 concat('Heaviest: ', top_id, ' with ', {num('top_elapsed', 1)}, ' s elapsed, ', {num('top_cpu', 1)}, ' s CPU, ', cast(top_execs as varchar),
  ' executions, ', cast(top_gets as varchar), ' buffer gets.'),
 CASE WHEN changes > 0 THEN concat(cast(changes as varchar), ' SQL changed plan.') END)"""

# Pages of three rows, so that most lists of SQL go on in further documents.
SNAPSHOT_PAGE = 3

SNAPSHOT_DOCS = f"""
SELECT m.db_id, m.snap AS snap_id, m.inst AS instance, coalesce(p.page, 0) AS page,
 CASE WHEN coalesce(p.page, 0) = 0 THEN concat_ws(chr(10), title, chr(10) || '[1] Snapshot', 'Database: ' || name,
  'Instance: ' || m.inst, 'Platform: ' || platform, 'Number: ' || m.snap, 'From: ' || strftime(end_ts - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M'),
  'To: ' || strftime(end_ts, '%Y-%m-%d %H:%M'), 'Minutes: 60', chr(10) || '[2] CPU and load',
  concat('OS CPU: ', {num('os_cpu')}, ' % (peak ', {num('os_cpu_max')}, ' %)'), 'DB time on CPU: N/A %', 'DB time waiting: N/A %',
  'Average active sessions: N/A', 'Executions per second: ' || {num('exec_s')}, 'Logons per second: N/A', 'SQL response (cs): N/A',
  chr(10) || '[3] Memory', CASE WHEN SGA IS NULL THEN 'No memory figures.' ELSE concat('SGA ', SGA, ' GB, PGA ', PGA, ' GB, total ', TOTAL, ' GB') END,
  chr(10) || '[4] Active sessions by wait class', coalesce(sessions, 'No session figures.'),
  chr(10) || '[5] Main waits', coalesce(waits, 'No wait events.'),
  chr(10) || '[6] Heaviest SQL', coalesce(sqls, 'No SQL was recorded for this snapshot.'), summary,
  chr(10) || '[7] I/O', 'Read MB/s: N/A', 'Write MB/s: N/A', 'Read IOPS: N/A', 'Write IOPS: N/A', 'Redo MB/s: N/A',
  chr(10) || '[8] Cluster cache', 'CR blocks received per second: N/A', 'Current blocks received per second: N/A',
  chr(10) || '[9] Reading', 'Weigh load, waits, sessions, memory, cluster traffic and SQL together before naming a cause.')
 ELSE concat_ws(chr(10), title, chr(10) || '[4] Active sessions by wait class' || chr(10) || sessions,
  chr(10) || '[5] Main waits' || chr(10) || waits, chr(10) || '[6] Heaviest SQL' || chr(10) || sqls) END AS content
FROM (SELECT m.*, coalesce(o.db_name, 'N/A') AS name, coalesce(o.platform_name, 'N/A') AS platform FROM v_main_metrics m
 LEFT JOIN {OS_DIM} o ON m.db_id = o.db_id) m
LEFT JOIN v_memory mem ON m.db_id = mem.db_id AND m.snap = mem.SNAP_ID AND m.inst = mem.INSTANCE_NUMBER
LEFT JOIN (SELECT db_id, SNAP_ID, page, string_agg(t, chr(10) ORDER BY n) FILTER (kind = 'a') AS sessions,
  string_agg(t, chr(10) ORDER BY n) FILTER (kind = 'w') AS waits, string_agg(t, chr(10) ORDER BY n) FILTER (kind = 's') AS sqls FROM (
  SELECT *, (n - 1) // {SNAPSHOT_PAGE} AS page FROM (
   SELECT db_id, SNAP_ID, 'a' AS kind, row_number() OVER (PARTITION BY db_id, SNAP_ID ORDER BY WAIT_CLASS) AS n,
    concat('- ', WAIT_CLASS, ': ', {num('AVG_SESS')}) AS t FROM v_aas
   UNION ALL SELECT db_id, SNAP_ID, 'w', row_number() OVER (PARTITION BY db_id, SNAP_ID ORDER BY EVENT_NAME), {WAIT_TEXT} FROM v_top_wait
   UNION ALL SELECT db_id, SNAP_ID, 's', row_number() OVER (PARTITION BY db_id, SNAP_ID ORDER BY ELAP_RANK, ELAP_S DESC, SQL_ID, l_orderkey, l_partkey),
    {SQL_TEXT} FROM v_top_sql) numbered) paged GROUP BY 1,2,3) p ON m.db_id = p.db_id AND m.snap = p.SNAP_ID
LEFT JOIN (SELECT db_id, SNAP_ID, {SUMMARY_TEXT} AS summary FROM (
  SELECT b.*, coalesce(x.MODULE, 'N/A') AS top_module FROM (
   SELECT db_id, SNAP_ID, count(distinct SQL_ID) AS unique_sql, count(distinct PARSING_SCHEMA_NAME) AS unique_schemas, sum(ELAP_S) AS elapsed,
    sum(CPU_T_S) AS cpu, sum(EXECS) AS execs, count(*) FILTER (PLAN_CHANGE > 0) AS changes,
    any_value(SQL_ID) FILTER (rn = 1) AS top_id, any_value(ELAP_S) FILTER (rn = 1) AS top_elapsed, any_value(CPU_T_S) FILTER (rn = 1) AS top_cpu,
    any_value(EXECS) FILTER (rn = 1) AS top_execs, any_value(BUFFER_GETS) FILTER (rn = 1) AS top_gets
   FROM (SELECT *, row_number() OVER (PARTITION BY db_id, SNAP_ID ORDER BY ELAP_RANK, ELAP_S DESC, SQL_ID) AS rn FROM v_top_sql) r GROUP BY 1,2) b
  LEFT JOIN (SELECT db_id, SNAP_ID, MODULE, row_number() OVER (PARTITION BY db_id, SNAP_ID ORDER BY count(*) DESC, MODULE) AS rn
   FROM v_top_sql WHERE MODULE IS NOT NULL GROUP BY 1,2,3) x ON b.db_id = x.db_id AND b.SNAP_ID = x.SNAP_ID AND x.rn = 1) s) s
 ON m.db_id = s.db_id AND m.snap = s.SNAP_ID,
LATERAL (SELECT concat('Snapshot ', m.snap, ', instance ', m.inst, ', database ', m.name,
 CASE WHEN coalesce(p.page, 0) > 0 THEN concat(', part ', p.page + 1) ELSE '' END) AS title) t
"""


@query("snapshot_docs", with_views(SNAPSHOT_DOCS, *ALL_VIEWS))
def snapshot_docs(spark, sf_dir):
    out = docs.snapshot_documents(*sections(spark, sf_dir), page_rows=SNAPSHOT_PAGE, sql_tie=SQL_TIE)
    return out.select("db_id", "snap_id", "instance", F.col("page").cast("bigint").alias("page"), "content")


HOURLY_PAGE = 3

HOURLY_DOCS = f"""
SELECT p.db_id, cast(p.hour as int) AS hour, p.page, replace(snaps, ', ', ',') AS snap_ids,
 CASE WHEN p.page = 0 THEN concat_ws(chr(10), title, 'Platform: ' || platform, 'Snapshots: ' || snaps, chr(10) || '[1] CPU and load',
  concat('Mean OS CPU: ', avg_os_cpu, ' %'), concat('Peak OS CPU: ', {num('max_os_cpu')}, ' %'), loads,
  chr(10) || '[2] Memory, mean per instance', coalesce(mems, 'No memory figures.'),
  chr(10) || '[3] Active sessions by wait class, mean', coalesce(sessions, 'No session figures.'),
  chr(10) || '[4] Main waits', coalesce(waits, 'No wait events.'),
  chr(10) || '[5] I/O, mean', 'Read MB/s: N/A', 'Write MB/s: N/A', 'Read IOPS: N/A', 'Write IOPS: N/A', 'Redo MB/s: N/A',
  chr(10) || '[6] Cluster cache, mean', 'CR blocks received per second: N/A', 'Current blocks received per second: N/A',
  chr(10) || '[7] Reading', 'Look for what this hour has in common on all days.')
 ELSE concat_ws(chr(10), title, 'Snapshots: ' || snaps, chr(10) || '[1] CPU and load' || chr(10) || loads,
  chr(10) || '[2] Memory, mean per instance' || chr(10) || mems, chr(10) || '[3] Active sessions by wait class, mean' || chr(10) || sessions,
  chr(10) || '[4] Main waits' || chr(10) || waits) END AS content
FROM (SELECT db_id, hour, page, string_agg(t, ', ' ORDER BY n) FILTER (kind = 'n') AS snaps,
  string_agg(t, chr(10) ORDER BY n) FILTER (kind = 'l') AS loads, string_agg(t, chr(10) ORDER BY n) FILTER (kind = 'm') AS mems,
  string_agg(t, chr(10) ORDER BY n) FILTER (kind = 'a') AS sessions, string_agg(t, chr(10) ORDER BY n) FILTER (kind = 'w') AS waits
 FROM (SELECT *, (n - 1) // {HOURLY_PAGE} AS page FROM (
  SELECT db_id, hour, 'n' AS kind, row_number() OVER (PARTITION BY db_id, hour ORDER BY SNAP_ID) AS n, cast(SNAP_ID as varchar) AS t FROM hours
  UNION ALL SELECT db_id, hour(end_ts), 'l', row_number() OVER (PARTITION BY db_id, hour(end_ts) ORDER BY snap, inst),
   concat('Snapshot ', snap, ', instance ', inst, ': OS CPU ', {num('os_cpu')}, ' % (peak ', {num('os_cpu_max')},
    ' %), DB time on CPU N/A %, waiting N/A %, sessions N/A, executions/s ', {num('exec_s')}, ', logons/s N/A') FROM v_main_metrics
  UNION ALL SELECT db_id, hour, 'm', row_number() OVER (PARTITION BY db_id, hour ORDER BY INSTANCE_NUMBER),
   concat('Instance ', INSTANCE_NUMBER, ': SGA ', sga, ' GB, PGA ', pga, ' GB') FROM (
   SELECT m.db_id, h.hour, INSTANCE_NUMBER, {mean_text('sum(SGA)')} AS sga, {mean_text('sum(PGA)')} AS pga
   FROM v_memory m JOIN hours h ON m.db_id = h.db_id AND m.SNAP_ID = h.SNAP_ID GROUP BY 1,2,3) mm
  UNION ALL SELECT db_id, hour, 'a', row_number() OVER (PARTITION BY db_id, hour ORDER BY WAIT_CLASS), concat('- ', WAIT_CLASS, ': ', s) FROM (
   SELECT m.db_id, h.hour, WAIT_CLASS, {mean_text('sum(AVG_SESS)')} AS s
   FROM v_aas m JOIN hours h ON m.db_id = h.db_id AND m.SNAP_ID = h.SNAP_ID GROUP BY 1,2,3) aa
  UNION ALL SELECT w.db_id, h.hour, 'w', row_number() OVER (PARTITION BY w.db_id, h.hour ORDER BY w.SNAP_ID, EVENT_NAME), {WAIT_TEXT}
   FROM v_top_wait w JOIN hours h ON w.db_id = h.db_id AND w.SNAP_ID = h.SNAP_ID) numbered) paged GROUP BY 1,2,3) p
JOIN (SELECT db_id, hour(end_ts) AS hour, {mean_text('sum(os_cpu)')} AS avg_os_cpu, max(os_cpu_max) AS max_os_cpu
 FROM v_main_metrics GROUP BY 1,2) r ON p.db_id = r.db_id AND p.hour = r.hour
JOIN (SELECT d.db_id, coalesce(db_name, 'N/A') AS name, coalesce(platform_name, 'N/A') AS platform FROM (SELECT DISTINCT db_id FROM v_main_metrics) d
 LEFT JOIN {OS_DIM} o ON d.db_id = o.db_id) o ON p.db_id = o.db_id,
LATERAL (SELECT concat('Hour ', lpad(cast(p.hour as varchar), 2, '0'), ':00 to ', lpad(cast(p.hour as varchar), 2, '0'), ':59, database ', name,
 CASE WHEN p.page > 0 THEN concat(', part ', p.page + 1) ELSE '' END) AS title) t
"""
HOURLY_SQL = with_views(HOURLY_DOCS, *ALL_VIEWS).replace(
    "\n\nSELECT p.db_id, cast(p.hour",
    ",\nhours AS (SELECT DISTINCT db_id, snap AS SNAP_ID, hour(end_ts) AS hour FROM v_main_metrics)\nSELECT p.db_id, cast(p.hour", 1)


@query("hourly_docs", HOURLY_SQL)
def hourly_docs(spark, sf_dir):
    m, memory, aas, waits, _, os_dim = sections(spark, sf_dir)
    out = docs.hourly_documents(m, memory, aas, waits, os_dim, page_rows=HOURLY_PAGE)
    return out.select(
        "db_id", "hour", F.col("page").cast("bigint").alias("page"),
        F.array_join(F.transform("snap_ids", lambda s: s.cast("string")), ",").alias("snap_ids"), "content",
    )


# ---- range texts ----------------------------------------------------------

# One range more than there is data for, so that the empty message occurs.
RANGES = """(SELECT db_id, period, 3001 + 12 * period AS lo, 3012 + 12 * period AS hi FROM (
 SELECT DISTINCT db_id, period FROM {yearly} UNION ALL SELECT DISTINCT db_id, 99 FROM v_top_sql) q)""".format(yearly=YEARLY)


def ranges(spark, sf_dir):
    sql = yearly(spark, sf_dir).select(*PERIOD).distinct()
    empty = sql.select("db_id", F.lit(99).alias("period")).distinct()
    low = F.lit(3001) + 12 * F.col("period")
    return sql.unionByName(empty).withColumns({"start_snap": low, "end_snap": low + 11})


TOP_LINE = f"""concat('- ', SQL_ID, ' (schema ', schema, ', module ', coalesce(module, 'N/A'), ', command ', command, '): in ', snaps,
 ' snapshots, elapsed ', {num('total_elapsed_s', 1)}, ' s, CPU ', {num('total_cpu_s', 1)}, ' s, executions ', total_execs, ', buffer gets ',
 total_buffer_gets, ', read ', {num('total_read_mb', 1)}, ' MB, I/O wait ', {num('total_io_wait_s', 1)}, ' s, physical read ',
 {num('total_physical_read_gb', 1)}, ' GB, direct write ', {num('total_direct_w_gb', 1)}, ' GB, plan changes ', max_plan_changes,
 ', plans ', plans_seen)"""

# Totals stay DECIMAL where they are only shown, so both engines round alike.
EXACT_TREND = TREND
for _c in ("CPU_T_S", "ELAP_S", "IO_WAIT", "PHY_READ_GB", "DIRECT_W_GB"):
    EXACT_TREND = EXACT_TREND.replace(f"cast(sum({_c}) as double)", f"sum({_c})")
PERIOD_TREND = EXACT_TREND.format(keys="db_id, period", source=YEARLY)


@query("trend_text", with_views(f"""
SELECT r.db_id, r.period, CASE WHEN n_sql IS NULL THEN concat('No SQL in snapshots ', lo, ' to ', hi, '.')
 ELSE concat_ws(chr(10), concat('SQL in snapshots ', lo, ' to ', hi, ':'), concat(n_sql, ' SQL in ', n, ' rows.'), body) END AS content
FROM {RANGES} r LEFT JOIN (
 SELECT db_id, period, count(*) AS n, count(distinct SQL_ID) AS n_sql, string_agg({TOP_LINE}, chr(10) ORDER BY rn) FILTER (rn <= 5) AS body
 FROM (SELECT *, row_number() OVER (PARTITION BY db_id, period ORDER BY total_elapsed_s DESC, SQL_ID) AS rn FROM ({PERIOD_TREND}) t) u
 GROUP BY 1,2) b ON r.db_id = b.db_id AND r.period = b.period""", "v_top_sql"))
def trend_text(spark, sf_dir):
    trend = analytics.sql_trend_over_range(yearly(spark, sf_dir), keys=PERIOD)
    return docs.trend_text(trend, ranges(spark, sf_dir), PERIOD)


EXACT_CHANGES = PLAN_CHANGES.replace("cast(sum(ELAP_S) as double)", "sum(ELAP_S)").replace("cast(sum(CPU_T_S) as double)", "sum(CPU_T_S)")
CHANGE_PAGE = 4


@query("plan_change_text", with_views(f"""
SELECT r.db_id, r.period, coalesce(page, 0) AS page, CASE WHEN n IS NULL THEN concat('No SQL with changing plans in snapshots ', lo, ' to ', hi, '.')
 ELSE concat_ws(chr(10), concat('SQL with changing plans in snapshots ', lo, ' to ', hi,
  CASE WHEN page > 0 THEN concat(', part ', page + 1) ELSE '' END, ':'), concat(n, ' SQL.'), body) END AS content
FROM {RANGES} r LEFT JOIN (
 SELECT db_id, period, n, page, string_agg(concat('- ', SQL_ID, ': schemas ', replace(schemas, ',', ', '), '; modules ', replace(modules, ',', ', '),
  '; plans ', replace(plan_hashes, ',', ', '), '; plans at once ', min_plans, ' to ', max_plans, '; largest change flag ', max_plan_change,
  '; in ', snaps, ' snapshots; elapsed ', {num('total_elapsed_s', 1)}, ' s; CPU ', {num('total_cpu_s', 1)}, ' s'), chr(10) ORDER BY rn) AS body
 FROM (SELECT *, (rn - 1) // {CHANGE_PAGE} AS page, count(*) OVER (PARTITION BY db_id, period) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY db_id, period ORDER BY SQL_ID) AS rn FROM ({EXACT_CHANGES.format(source=YEARLY)}) t) u) v
 GROUP BY 1,2,3,4) b ON r.db_id = b.db_id AND r.period = b.period""", "v_top_sql"))
def plan_change_text(spark, sf_dir):
    changes = analytics.detect_sql_plan_changes(yearly(spark, sf_dir), keys=PERIOD)
    out = docs.plan_change_text(changes, ranges(spark, sf_dir), PERIOD, page_rows=CHANGE_PAGE)
    return out.withColumn("page", F.col("page").cast("bigint"))


EXACT_LABELLED = LABELLED.replace(TREND.format(keys="db_id, period", source=YEARLY), PERIOD_TREND).replace(
    "total_cpu_s / total_elapsed_s", "cast(total_cpu_s as double) / cast(total_elapsed_s as double)"
)


@query("bottleneck_text", with_views(f"""
SELECT r.db_id, r.period, CASE WHEN dist IS NULL THEN concat('No SQL to label in snapshots ', lo, ' to ', hi, '.')
 ELSE concat_ws(chr(10), concat('Bottlenecks in snapshots ', lo, ' to ', hi, ':'), 'Labels: ' || dist, body) END AS content
FROM {RANGES} r LEFT JOIN (
 SELECT db_id, period, string_agg(concat('- ', SQL_ID, ' (', replace(bottleneck_class, ',', ', '), '): schema ', schema, ', module ',
  coalesce(module, 'N/A'), ', command ', command, ', in ', snaps, ' snapshots, elapsed ', {num('total_elapsed_s', 1)}, ' s, CPU ',
  {num('total_cpu_s', 1)}, ' s, executions ', total_execs, ', buffer gets ', total_buffer_gets, ', read ', {num('total_read_mb', 1)},
  ' MB, I/O wait ', {num('total_io_wait_s', 1)}, ' s'), chr(10) ORDER BY rn) AS body
 FROM (SELECT *, row_number() OVER (PARTITION BY db_id, period ORDER BY total_elapsed_s DESC, SQL_ID) AS rn FROM ({EXACT_LABELLED}) t) u
 WHERE rn <= 10 GROUP BY 1,2) b ON r.db_id = b.db_id AND r.period = b.period
LEFT JOIN (SELECT db_id, period, string_agg(concat(label, ': ', n), ', ' ORDER BY place) AS dist FROM (
  SELECT db_id, period, label, count(*) AS n, min(row(-total_elapsed_s, SQL_ID, pos)) AS place FROM (
   SELECT db_id, period, SQL_ID, total_elapsed_s, unnest(string_split(bottleneck_class, ',')) AS label,
    generate_subscripts(string_split(bottleneck_class, ','), 1) AS pos FROM ({EXACT_LABELLED}) x) y GROUP BY 1,2,3) z GROUP BY 1,2) d
 ON r.db_id = d.db_id AND r.period = d.period""", "v_top_sql"))
def bottleneck_text(spark, sf_dir):
    classified = analytics.classify_all_sql_in_range(yearly(spark, sf_dir), keys=PERIOD)
    return docs.bottleneck_text(classified, ranges(spark, sf_dir), PERIOD)


# ---- document shape -------------------------------------------------------


@query("doc_shape_normalize", """
SELECT doc_id, text AS content, concat(source, '|', CASE WHEN lang = 'en' THEN '' ELSE lang END) AS meta FROM documents""")
def doc_shape_normalize(spark, sf_dir):
    """Documents arriving under three content names, and a missing metadata value."""
    d = table(spark, sf_dir, "documents")
    english, french = F.col("lang") == "en", F.col("lang") == "fr"
    mixed = d.select(
        "doc_id", "source", F.when(~english, F.col("lang")).alias("lang"),
        F.when(english, F.col("text")).alias("text"),
        F.when(french, F.col("text")).alias("page_content"),
        F.when(~english & ~french, F.col("text")).alias("content"),
    )
    out = docs.normalize_documents(mixed).withColumn("metadata", docs.metadata_text(["source", "lang"]))
    return out.select("doc_id", "content", F.concat_ws("|", F.col("metadata")["source"], F.col("metadata")["lang"]).alias("meta"))


@query("doc_shape_validate", """
SELECT d.doc_id, CASE WHEN l.toxic = 1 AND l.quality IS NULL THEN 'missing content, missing metadata'
 WHEN l.toxic = 1 THEN 'missing content' ELSE 'missing metadata' END AS issue
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1 OR l.quality IS NULL""")
def doc_shape_validate(spark, sf_dir):
    """Toxic documents lose their content, unlabelled ones their metadata."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    shaped = d.select(
        "doc_id", F.when(F.coalesce(F.col("toxic") != 1, F.lit(True)), F.col("text")).alias("content"),
        F.when(F.col("quality").isNotNull(), docs.metadata_text(["source"])).alias("metadata"),
    )
    return docs.bad_documents(shaped).select("doc_id", "issue")


# ---- retrieval ------------------------------------------------------------

CENTROIDS = """(SELECT label, list(v ORDER BY i) AS q FROM (
 SELECT label, i, round(avg(x), 9) AS v FROM (
  SELECT label, unnest(cast(embedding as double[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) e GROUP BY 1,2) c GROUP BY 1)"""


def centroids(spark, sf_dir):
    """The mean vector of each label, as its query."""
    e = table(spark, sf_dir, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.round(F.avg(F.col("x").cast("double")), 9).alias("v")
    )
    gathered = F.sort_array(F.collect_list(F.struct("i", "v")))
    return parts.groupBy("label").agg(F.transform(gathered, lambda p: p["v"]).alias("query_embedding"))


@query("cosine_topk", f"""
SELECT * FROM (SELECT c.label AS query_id, e.vec_id, round(list_cosine_similarity(cast(e.embedding as double[]), c.q), 6) AS score,
 cast(row_number() OVER (PARTITION BY c.label ORDER BY round(list_cosine_similarity(cast(e.embedding as double[]), c.q), 6) DESC, e.vec_id) as int) AS rank
FROM embeddings e, {CENTROIDS} c) t WHERE rank <= 20""")
def cosine_topk(spark, sf_dir):
    queries = centroids(spark, sf_dir).withColumnRenamed("label", "query_id")
    return retrieval.top_similar(table(spark, sf_dir, "embeddings"), queries, 20, doc_id="vec_id")


@query("grid_topk", """
SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])), 6) AS score,
 cast(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])), 6) DESC, e.vec_id) as int) AS rank
FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) t WHERE rank <= 5""")
def grid_topk(spark, sf_dir):
    """Every twentieth vector asks all others, by the grid that serves very many queries."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = e.where("vec_id % 20 = 0").toDF("query_id", "query_embedding")
    return retrieval.top_similar(e, queries, 5, doc_id="vec_id", held_bytes=0)


@query("filtered_topk", f"""
SELECT * FROM (SELECT c.label AS query_id, e.vec_id, round(list_cosine_similarity(cast(e.embedding as double[]), c.q), 6) AS score,
 cast(row_number() OVER (PARTITION BY c.label ORDER BY round(list_cosine_similarity(cast(e.embedding as double[]), c.q), 6) DESC, e.vec_id) as int) AS rank
FROM embeddings e JOIN {CENTROIDS} c ON e.label = c.label) t WHERE rank <= 4""")
def filtered_topk(spark, sf_dir):
    queries = centroids(spark, sf_dir).withColumn("query_id", F.col("label"))
    return retrieval.top_similar_within(table(spark, sf_dir, "embeddings"), queries, 4, ["label"], doc_id="vec_id")


@query("range_topk", f"""
SELECT * FROM (SELECT c.label AS query_id, e.vec_id, round(list_cosine_similarity(cast(e.embedding as double[]), c.q), 6) AS score,
 cast(row_number() OVER (PARTITION BY c.label ORDER BY round(list_cosine_similarity(cast(e.embedding as double[]), c.q), 6) DESC, e.vec_id) as int) AS rank
FROM embeddings e JOIN {CENTROIDS} c ON e.label = c.label
JOIN (SELECT label, min(vec_id) AS lo, cast(floor((min(vec_id) + max(vec_id)) / 2) as bigint) AS hi FROM embeddings GROUP BY label) r ON r.label = c.label
WHERE e.vec_id BETWEEN lo AND hi) t WHERE rank <= 20""")
def range_topk(spark, sf_dir):
    """Each label is a database, each vector a snapshot; the range is its first half."""
    e = table(spark, sf_dir, "embeddings")
    ids = F.col("vec_id")
    halves = e.groupBy("label").agg(
        F.min(ids).alias("start_snap"), F.floor((F.min(ids) + F.max(ids)) / 2).alias("end_snap")
    )
    requests = centroids(spark, sf_dir).join(halves, "label").select(
        F.col("label").alias("query_id"), F.col("label").alias("db_id"), "start_snap", "end_snap", "query_embedding"
    )
    store_rows = e.select(
        ids.alias("doc_id"), F.col("label").alias("db_id"), ids.alias("snap_id"),
        F.lit(None).cast("array<bigint>").alias("snap_ids"), "embedding",
    )
    return retrieval.range_hits(store_rows, requests, 20).withColumnRenamed("doc_id", "vec_id")


PLACES = """(SELECT {id}, {kind} AS kind, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS w FROM {table})"""
HASHED = f"""
WITH words AS (SELECT doc_id AS id, kind, w FROM {PLACES.format(id='doc_id', kind="'d'", table='documents')} UNION ALL
  SELECT item_id, kind, w FROM {PLACES.format(id='item_id', kind="'q'", table='benchmark')}),
placed AS (SELECT kind, id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 512 AS place, count(*) AS n FROM words GROUP BY ALL),
weights AS (SELECT place, ln(((SELECT count(*) FROM documents) + 1.0)::DOUBLE / (count(*) + 1.0)::DOUBLE) AS weight FROM placed WHERE kind = 'd' GROUP BY place),
weighed AS (SELECT kind, id, place, n * coalesce(weight, ln(((SELECT count(*) FROM documents) + 1.0)::DOUBLE)) AS x FROM placed LEFT JOIN weights USING (place)),
lengths AS (SELECT kind, id, sqrt(sum(x * x)) AS length FROM weighed GROUP BY kind, id),
units AS (SELECT kind, id, place, (CASE WHEN length > 0 THEN x / length ELSE 0 END)::FLOAT::DOUBLE AS x FROM weighed JOIN lengths USING (kind, id)),
norms AS (SELECT kind, id, sqrt(sum(x * x)) AS norm FROM units GROUP BY kind, id),
dots AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.x * d.x) AS dot FROM units q JOIN units d ON q.place = d.place AND q.kind = 'q' AND d.kind = 'd' GROUP BY ALL),
scored AS (
  SELECT b.item_id AS query_id, c.doc_id, round(coalesce(CASE WHEN a.norm * e.norm > 0 THEN dot / a.norm / e.norm END, 0.0), 6) AS score
  FROM benchmark b CROSS JOIN documents c LEFT JOIN dots s ON s.query_id = b.item_id AND s.doc_id = c.doc_id
  LEFT JOIN norms a ON a.kind = 'q' AND a.id = b.item_id LEFT JOIN norms e ON e.kind = 'd' AND e.id = c.doc_id)
SELECT * FROM (SELECT query_id, doc_id, score, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS int) AS rank FROM scored) t WHERE rank <= 4"""


@query("hash_embed_topk", HASHED)
def hash_embed_topk(spark, sf_dir):
    """Each benchmark passage asks for the documents most like it."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    model = retrieval.fit_hashed_embedding(d)
    stored = retrieval.hashed_embedding(model, d)
    asked = retrieval.hashed_embedding(
        model, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("content")),
        vector="query_embedding",
    )
    return retrieval.top_similar(stored, asked, retrieval.SNAPSHOT_K)


LETTERS = "etaoinsr"
COUNTED = "[cast(len(text) - len(replace(text, c, '')) as double) FOR c IN string_split('e,t,a,o,i,n,s,r', ',')]"
USER_HITS = f"""(SELECT * FROM (SELECT b.item_id AS query_id, d.doc_id, d.text, round(list_cosine_similarity(d.v, b.v), 6) AS score,
 cast(row_number() OVER (PARTITION BY b.item_id ORDER BY round(list_cosine_similarity(d.v, b.v), 6) DESC, d.doc_id) as int) AS rank
FROM (SELECT doc_id, text, {COUNTED} AS v FROM documents WHERE length(regexp_replace(text, '[^{LETTERS}]', '', 'g')) > 0) d,
 (SELECT item_id, {COUNTED} AS v FROM benchmark) b) t WHERE rank <= 4)"""


def letter_vectors(spark, sf_dir):
    """Documents and benchmark passages with a user's own vectors: counts of eight letters."""
    def letters(texts):
        return [[float(t.count(c)) for c in LETTERS] for t in texts]

    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    stored = retrieval.embed(d, letters, batch_rows=50).filter(F.exists("embedding", lambda x: x > 0))
    asked = retrieval.embed(
        table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("content")),
        letters, vector="query_embedding",
    )
    return stored, asked


@query("user_embed_topk", f"SELECT query_id, doc_id, score, rank FROM {USER_HITS} h")
def user_embed_topk(spark, sf_dir):
    return retrieval.top_similar(*letter_vectors(spark, sf_dir), retrieval.SNAPSHOT_K)


@query("question_contexts", f"""
SELECT query_id, count(*) AS n_docs, string_agg(concat('[DOC ', rank, ']', chr(10),
 CASE WHEN length(text) > 5000 THEN text[1:5000] || chr(10) || '...[TRUNCATED]...' ELSE text END), chr(10) || chr(10) ORDER BY rank) AS context
FROM {USER_HITS} h GROUP BY query_id""")
def question_contexts(spark, sf_dir):
    """Each benchmark passage as a question, with its context."""
    return pipeline.question_contexts(*letter_vectors(spark, sf_dir), retrieval.SNAPSHOT_K)


# ---- contexts and prompts -------------------------------------------------

CUT = "CASE WHEN length(text) > 5000 THEN text[1:5000] || chr(10) || '...[TRUNCATED]...' ELSE text END"


@query("context_pack", f"""
SELECT source, count(*) AS n_docs, cast(sum(length(fitted)) as bigint) AS n_chars, string_agg(fitted, chr(10) || chr(10) ORDER BY rn) AS context FROM (
 SELECT *, CASE WHEN before + length(piece) > 40000 THEN piece[1:(40000 - before)] || chr(10) || '...[GLOBAL TRUNCATION]...' ELSE piece END AS fitted
 FROM (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY source ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
  SELECT source, {CUT} AS piece, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) AS rn FROM documents) a WHERE rn <= 8) b
 WHERE before < 40000) c GROUP BY source""")
def context_pack(spark, sf_dir):
    return context.pack_context(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], content="text")


@query("context_pack_long", f"""
SELECT source, count(*) AS n_docs, cast(sum(length(fitted)) as bigint) AS n_chars, string_agg(fitted, chr(10) || chr(10) ORDER BY rn) AS context FROM (
 SELECT *, CASE WHEN before + length(piece) > 40000 THEN piece[1:(40000 - before)] || chr(10) || '...[GLOBAL TRUNCATION]...' ELSE piece END AS fitted
 FROM (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY source ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
  SELECT source, {CUT} AS piece, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) AS rn FROM documents) a WHERE rn <= 100) b
 WHERE before < 40000) c GROUP BY source""")
def context_pack_long(spark, sf_dir):
    """A higher number of documents, so that the total budget cuts."""
    return context.pack_context(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], content="text", max_docs=100)


FORMATTED = f"""(SELECT source, count(*) AS n_docs, string_agg(concat('[DOC ', rn, ']', chr(10), {CUT}), chr(10) || chr(10) ORDER BY rn) AS context
FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) a WHERE rn <= 20 GROUP BY source)"""


def formatted(spark, sf_dir):
    """The twenty longest documents of each source as its hits."""
    from perfsnap.operators.ranking import first_rows

    d = table(spark, sf_dir, "documents")
    ids = first_rows(d.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 20, "rank")
    hits = ids.select("doc_id", "rank").join(d.select("doc_id", "source", "text"), "doc_id")
    return context.format_context(hits, ["source"], content="text")


@query("context_format", f"SELECT * FROM {FORMATTED} f")
def context_format(spark, sf_dir):
    return formatted(spark, sf_dir)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def levels(texts: dict[str, str], column: str, otherwise: str) -> str:
    whens = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in texts.items())
    return f"CASE {column} {whens} ELSE {quoted(texts[otherwise])} END"


PRESET_SQL = """CASE preset WHEN 'manager' THEN ['executive', 'high', 'id'] WHEN 'dba' THEN ['technical', 'medium', 'id']
 WHEN 'expert' THEN ['deepdive', 'expert', 'id'] WHEN 'balanced' THEN ['technical', 'medium', 'id']
 WHEN 'english' THEN [analysis_level, 'medium', 'en'] ELSE [analysis_level, 'medium', 'id'] END"""

PROMPTS = f"""
SELECT source, concat_ws(chr(10) || chr(10), {levels(prompts.LANGUAGE, 'l[3]', 'en')}, {levels(prompts.ANALYSIS, 'l[1]', 'deepdive')},
 {levels(prompts.RECOMMENDATION, 'l[2]', 'expert')}, {quoted(prompts.STYLE)}, {quoted(prompts.STRUCTURE)}, {quoted(prompts.TIME_RULES)}) AS system,
 concat('Snapshots ', lo, '-', hi, '. Documents:', chr(10), chr(10), context, chr(10), chr(10), 'Report on these snapshots as one period.') AS "user"
FROM (SELECT *, {PRESET_SQL} AS l FROM (
 SELECT source, min(doc_id) AS lo, max(doc_id) AS hi, 'deepest' AS analysis_level,
  CASE source WHEN 'src0' THEN 'manager' WHEN 'src1' THEN 'dba' WHEN 'src2' THEN 'expert' WHEN 'src3' THEN 'balanced' WHEN 'src4' THEN 'english' END AS preset
 FROM documents GROUP BY source) r) p JOIN {FORMATTED} f USING (source)"""


@query("prompt_table", PROMPTS)
def prompt_table(spark, sf_dir):
    """One request per source; five of them use a preset, the others an unknown level."""
    source = F.col("source")
    chosen = F.lit(None).cast("string")
    for i, name in enumerate(prompts.PRESETS):
        chosen = F.when(source == f"src{i}", name).otherwise(chosen)
    requests = (
        table(spark, sf_dir, "documents").groupBy("source")
        .agg(F.min("doc_id").alias("start_snap"), F.max("doc_id").alias("end_snap"))
        .withColumns({"preset": chosen, "analysis_level": F.lit("deepest")})
    )
    return prompts.range_prompts(requests, formatted(spark, sf_dir), ["source"])


@query("snapshot_prompt_table", f"""
SELECT source, {quoted(prompts.SNAPSHOT_ROLE + chr(10) + chr(10) + prompts.SNAPSHOT_OUTLINE)} AS system,
 concat('Snapshot ', lo, '. Documents:', chr(10), chr(10), context, chr(10), chr(10), 'Report on this snapshot.') AS "user"
FROM (SELECT source, min(doc_id) AS lo FROM documents GROUP BY source) r JOIN {FORMATTED} f USING (source)""")
def snapshot_prompt_table(spark, sf_dir):
    requests = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("snap_id"))
    return prompts.snapshot_prompts(requests, formatted(spark, sf_dir), ["source"])


HEADERS = f"""
SELECT r.db_id, concat_ws(chr(10), concat('# ', coalesce(db_name, 'not recorded'), ', snapshots ', s0, '-', s1),
 concat('Period: ', strftime(t0, '%Y-%m-%d %H:%M'), ' / ', strftime(t1, '%Y-%m-%d %H:%M')),
 concat('Database id ', coalesce(dbid, 'not recorded'), ', release ', coalesce(version, 'not recorded'), ', instances not recorded'),
 concat('Host: ', coalesce(platform_name, 'not recorded'), '; sockets not recorded, cores not recorded, threads ',
  coalesce(num_cpus, 'not recorded'), ', memory in GB not recorded')) AS header,
 concat_ws('_', coalesce(db_name, 'UNKNOWN'), coalesce(dbid, 'UNKNOWN'), strftime(t0, '%Y%m%d-%H%M'), strftime(t1, '%Y%m%d-%H%M'), 'report.txt') AS file_name
FROM (SELECT db_id, min(snap) AS s0, max(snap) AS s1, min(end_ts - INTERVAL 1 HOUR) AS t0, max(end_ts) AS t1 FROM v_main_metrics GROUP BY db_id) r
LEFT JOIN {OS_DIM} o ON r.db_id = o.db_id"""


@query("report_headers", with_views(HEADERS, "v_main_metrics", "v_os_info"))
def report_headers(spark, sf_dir):
    ranged = rollups.snap_range(metrics(spark, sf_dir))
    return prompts.report_headers(ranged, cleaning.os_wide(view(spark, sf_dir, "v_os_info")))


@query("final_reports", with_views(f"""
SELECT h.db_id, file_name, concat_ws(chr(10) || chr(10), header, concat('asked in ',
 length(concat('How did the database perform from SNAP_ID ', s0, ' to ', s1, ': CPU, waits, active sessions, I/O, heaviest SQL, changed plans?')),
 ' characters')) AS report
FROM ({HEADERS}) h JOIN (SELECT db_id, min(snap) AS s0, max(snap) AS s1 FROM v_main_metrics GROUP BY db_id) r ON h.db_id = r.db_id""",
    "v_main_metrics", "v_os_info"))
def final_reports(spark, sf_dir):
    """One report per database; the answer function tells how long its question was."""
    ranged = rollups.snap_range(metrics(spark, sf_dir))
    asked = ranged.select(
        "db_id", F.lit("").alias("system"), retrieval.range_question("start_snap", "end_snap").alias("user")
    )
    answered = prompts.answer(asked, lambda system, user: [f"asked in {len(u)} characters" for u in user])
    headers = prompts.report_headers(ranged, cleaning.os_wide(view(spark, sf_dir, "v_os_info")))
    return headers.join(answered.select("db_id", "answer"), "db_id").select(
        "db_id", "file_name", prompts.final_report().alias("report")
    )


@query("report_files", with_views(f"""
SELECT file_name, concat(header, chr(10), chr(10), 'asked', chr(10)) AS report FROM ({HEADERS}) h
UNION ALL SELECT 'summary.txt', concat(count(*), ' reports', chr(10)) FROM ({HEADERS}) g""", "v_main_metrics", "v_os_info"))
def report_files(spark, sf_dir):
    """Reports written as files twice, a further one added, and all read back."""
    path = scratch_path(spark, "reports")
    headers = prompts.report_headers(rollups.snap_range(metrics(spark, sf_dir)), cleaning.os_wide(view(spark, sf_dir, "v_os_info")))
    made = headers.withColumn("answer", F.lit("asked")).select("file_name", prompts.final_report().alias("report"))
    reports.write_reports(made.withColumn("report", F.lit("first version")), path)
    reports.write_reports(made, path)
    count = F.concat(F.count(F.lit(1)).cast("string"), F.lit(" reports")).alias("report")
    reports.write_reports(made.agg(count).select(F.lit("summary.txt").alias("file_name"), "report"), path)
    return spark.read.text(path, wholetext=True).select("file_name", F.col("value").alias("report"))


# ---- from documents to prompts through the store ---------------------------

ONE_PAGE = 10_000
SNAPSHOT_PROMPTS = f"""
SELECT concat_ws('-', db_id, snap_id, instance) AS request_id, {quoted(prompts.SNAPSHOT_ROLE + chr(10) + chr(10) + prompts.SNAPSHOT_OUTLINE)} AS system,
 concat('Snapshot ', snap_id, '. Documents:', chr(10), chr(10), '[DOC 1]', chr(10), {CUT.replace('text', 'content')}, chr(10), chr(10), 'Report on this snapshot.') AS "user"
FROM ({SNAPSHOT_DOCS.replace(f'// {SNAPSHOT_PAGE} AS page', f'// {ONE_PAGE} AS page')}) d"""


@query("snapshot_report_prompts", with_views(SNAPSHOT_PROMPTS, *ALL_VIEWS))
def snapshot_report_prompts(spark, sf_dir):
    """Snapshot documents stored with vectors, found again for each snapshot and instance, and made into prompts."""
    path = scratch_path(spark, "store")
    parts = sections(spark, sf_dir)
    built = written(docs.snapshot_documents(*parts, page_rows=ONE_PAGE, sql_tie=SQL_TIE), "built")
    pipeline.store_with_vectors(built, path)
    pipeline.store_with_vectors(built, path)
    stored, model = pipeline.open_store(spark, path)
    return pipeline.snapshot_report_prompts(stored, model, pipeline.snapshot_requests(parts[0]))


# ---- store ----------------------------------------------------------------


@query("upsert_idempotent", """
SELECT cast(doc_id as varchar) AS doc_id, CASE WHEN lang = 'en' THEN concat(text, ' v2') ELSE text END AS content, source FROM documents""")
def upsert_idempotent(spark, sf_dir):
    """The documents loaded twice, then the English ones in a new version."""
    path = scratch_path(spark, "documents")
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"), "source", "lang"
    )
    store.upsert_documents(d.drop("lang"), path)
    store.upsert_documents(d.drop("lang"), path)
    newer = d.filter(F.col("lang") == "en").withColumn("content", F.concat("content", F.lit(" v2")))
    store.upsert_documents(newer.drop("lang"), path)
    return store.read_documents(spark, path)
