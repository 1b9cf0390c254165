"""Registered queries that render tables as dumps and read them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfsnap.bindings import with_views
from perfsnap.operators import analytics, cleaning
from perfsnap.plans import pipeline
from perfsnap.registry import TREND, metrics, plain, query, table, top_sql, view
from perfsnap.registry_documents import ALL_VIEWS, HOURLY_SQL, SNAPSHOT_DOCS, SNAPSHOT_PAGE
from perfsnap.session import scratch_path, written
from perfsnap.sinks import sections as exports
from perfsnap.sources import dumps, render, schemas

SQL_WIDTHS = {
    "SNAP_ID": 10, "SQL_ID": 13, "PARSING_SCHEMA_NAME": 19, "MODULE": 12, "COMMAND_NAME": 12, "PLAN_HASH": 10,
    "PLAN_CHANGE": 11, "PLANS": 6, "ELAP_RANK": 9, "EXECS": 10, "BUFFER_GETS": 11, "ROWS_PROC": 10, "ELAP_S": 18,
    "CPU_T_S": 18, "IO_WAIT": 10, "READ_MB": 10, "PHY_READ_GB": 11, "DIRECT_W_GB": 11,
}


def kept_lines(lines: DataFrame) -> DataFrame:
    """Rendered lines as a table, a part of a dump in one piece, as files would be."""
    return written(lines.repartition("source_file", "split_start"), "lines")


def sql_lines(spark, sf_dir) -> DataFrame:
    """One dump per database; a part of it for every twenty thousand orders."""
    order = F.col("l_orderkey") * 8 + F.col("ELAP_RANK") + 10
    return render.section_lines(
        top_sql(spark, sf_dir), schemas.TOP_SQL, SQL_WIDTHS, F.col("db_id"), F.floor(F.col("l_orderkey") / 20000), order
    )


@query("dump_roundtrip_fixed", with_views("""
SELECT db_id AS source_file, cast(SNAP_ID as varchar) AS SNAP_ID, SQL_ID, PARSING_SCHEMA_NAME, coalesce(MODULE, '') AS MODULE,
 PLAN_HASH, cast(EXECS as varchar) AS EXECS, cast(ELAP_S as varchar) AS ELAP_S, cast(CPU_T_S as varchar) AS CPU_T_S, cast(NULL as varchar) AS ACTION
FROM v_top_sql""", "v_top_sql"))
def dump_roundtrip_fixed(spark, sf_dir):
    lines = kept_lines(sql_lines(spark, sf_dir))
    names = ["SNAP_ID", "SQL_ID", "PARSING_SCHEMA_NAME", "MODULE", "PLAN_HASH", "EXECS", "ELAP_S", "CPU_T_S", "ACTION"]
    return dumps.raw_section(lines, dumps.index_dumps(lines), schemas.TOP_SQL, names).drop("line_pos")


@query("dump_sql_trend", with_views(
    TREND.format(keys="db_id", source="v_top_sql").replace("min(MODULE)", "coalesce(min(coalesce(MODULE, '')), '')"), "v_top_sql"))
def dump_sql_trend(spark, sf_dir):
    """SQL totals from the dumps; the parsed DOUBLEs add up to the exact sums once rounded."""
    lines = kept_lines(sql_lines(spark, sf_dir))
    typed = dumps.read_section(lines, dumps.index_dumps(lines), schemas.TOP_SQL).withColumnRenamed("source_file", "db_id")
    trend = analytics.sql_trend_over_range(typed)
    places = {"total_cpu_s": 6, "total_elapsed_s": 6, "total_io_wait_s": 2, "total_physical_read_gb": 2, "total_direct_w_gb": 2}
    whole = {"total_execs": "bigint", "total_buffer_gets": "bigint", "total_read_mb": "bigint", "max_plan_changes": "int",
             "plans_seen": "int"}
    return trend.withColumns(
        {**{c: F.round(c, n) for c, n in places.items()}, **{c: F.col(c).cast(t) for c, t in whole.items()}}
    )


CUSTOMER_WIDTHS = {"C_KEY": 10, "C_NAME": 20, "C_SEGMENT": 12}


def customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("dump"),
        F.col("c_custkey").alias("C_KEY"), F.col("c_name").alias("C_NAME"), F.col("c_mktsegment").alias("C_SEGMENT"),
        "c_acctbal",
    )


def section(df: DataFrame, name: str, widths: dict[str, int], key: str, spaced: bool = False) -> DataFrame:
    return render.section_lines(
        df, name, widths, F.col("dump"), F.floor(F.col(key) / 1000), F.col(key) + 10, spaced=spaced
    )


@query("dump_roundtrip_ws", """
SELECT concat('N', cast(c_nationkey as varchar)) AS source_file, cast(c_custkey as varchar) AS C_KEY, c_name AS C_NAME,
 c_mktsegment AS C_SEGMENT FROM customer""")
def dump_roundtrip_ws(spark, sf_dir):
    lines = kept_lines(section(customers(spark, sf_dir), "CUSTOMERS", CUSTOMER_WIDTHS, "C_KEY", spaced=True))
    return dumps.read_any_section(lines, dumps.index_dumps(lines), "customers").drop("line_pos")


def three_sections(spark, sf_dir) -> DataFrame:
    """Customers, suppliers, then the customers in credit under the first name again."""
    c = customers(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("dump"), F.col("s_suppkey").alias("S_KEY"),
        F.col("s_name").alias("S_NAME"),
    )
    return render.stack_sections([
        section(c, "CUSTOMERS", CUSTOMER_WIDTHS, "C_KEY"),
        section(s, "SUPPLIERS", {"S_KEY": 10, "S_NAME": 20}, "S_KEY"),
        section(c.filter("c_acctbal >= 0"), "CUSTOMERS", CUSTOMER_WIDTHS, "C_KEY"),
    ])


BLOCKS = """
SELECT concat('N', cast(c_nationkey as varchar)) AS source_file, 'CUSTOMERS' AS section, 1 AS n, count(*) AS n_rows FROM customer GROUP BY 1
UNION ALL SELECT concat('N', cast(s_nationkey as varchar)), 'SUPPLIERS', 2, count(*) FROM supplier GROUP BY 1
UNION ALL SELECT concat('N', cast(c_nationkey as varchar)), 'CUSTOMERS', 3, count(*) FROM customer WHERE c_acctbal >= 0 GROUP BY 1"""


@query("block_catalog", f"SELECT source_file, section, count(*) AS n_blocks FROM ({BLOCKS}) b GROUP BY 1,2")
def block_catalog(spark, sf_dir):
    blocks = dumps.block_catalog(dumps.find_segments(kept_lines(three_sections(spark, sf_dir))))
    return blocks.groupBy("source_file", "section").agg(F.count(F.lit(1)).alias("n_blocks"))


@query("section_profile", f"SELECT source_file, section, arg_max(n_rows, n) AS n_rows FROM ({BLOCKS}) b GROUP BY 1,2")
def section_profile(spark, sf_dir):
    lines = kept_lines(three_sections(spark, sf_dir))
    return dumps.section_profile(dumps.parse_cells(lines, dumps.index_dumps(lines)))[0]


@query("section_preview", """
SELECT source_file, section, row_text FROM (
 SELECT concat('N', cast(s_nationkey as varchar)) AS source_file, 'SUPPLIERS' AS section, concat(s_suppkey, '|', s_name) AS row_text,
  row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier
 UNION ALL SELECT concat('N', cast(c_nationkey as varchar)), 'CUSTOMERS', concat(c_custkey, '|', c_name, '|', c_mktsegment),
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)
 FROM (SELECT *, max(CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey) AS again FROM customer) c
 WHERE c_acctbal >= 0 OR again = 0) t WHERE n <= 10""")
def section_preview(spark, sf_dir):
    lines = kept_lines(three_sections(spark, sf_dir))
    head = dumps.section_profile(dumps.parse_cells(lines, dumps.index_dumps(lines)), 10)[1]
    return head.select("source_file", "section", F.array_join("cells", "|").alias("row_text"))


@query("parse_status", f"""
SELECT f.source_file, f.n_lines, count(n) AS n_blocks, CASE WHEN count(*) FILTER (section = 'SUPPLIERS') = 0 THEN 'SUPPLIERS' ELSE '' END AS missing
FROM (SELECT source_file, cast(sum(n_rows + 4) as bigint) AS n_lines FROM ({BLOCKS}) b GROUP BY 1) f JOIN ({BLOCKS}) g ON f.source_file = g.source_file
GROUP BY 1,2""")
def parse_status(spark, sf_dir):
    lines = kept_lines(three_sections(spark, sf_dir))
    status = dumps.parse_status(dumps.index_dumps(lines, last_only=False), ["customers", "suppliers"])
    return status.select("source_file", "n_lines", "n_blocks", F.array_join("missing", ",").alias("missing"))


# ---- what becomes of lines ------------------------------------------------

# One line per event; some are blank, repeat the header, have a broken key or text after the last column.
KIND = """CASE WHEN event_type = 'error' THEN 'key' WHEN event_id % 7 = 0 THEN 'blank' WHEN event_id % 11 = 0 THEN 'cut'
 WHEN event_id % 13 = 0 THEN 'again' WHEN event_id % 17 = 0 THEN 'none' ELSE 'row' END"""
MEMORY_HEADER = f"{'SNAP_ID':>10} {'INSTANCE_NUMBER':>15} {'SGA':>8}"
MEMORY_RULE = f"{'-' * 10} {'-' * 15} {'-' * 8}"


def broken_lines(spark, sf_dir) -> DataFrame:
    """A memory section for each user with rows of every kind, and text around it."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("source_file"), "event_id", F.expr(KIND).alias("kind"), "value")
    row = F.concat_ws(" ", F.lpad(F.when(F.col("kind") == "key", F.lit("3x")).otherwise(F.lit("3000")), 10, " "), F.lpad(F.lit("1"), 15, " "), F.lpad(F.col("value").cast("int").cast("string"), 8, " "))
    line = (
        F.when(F.col("kind") == "blank", "   ").when(F.col("kind") == "again", MEMORY_HEADER).when(F.col("kind") == "none", f"{'':40}late")
        .when(F.col("kind") == "cut", F.concat(row, F.lit("  tail"))).otherwise(row)
    )
    last = 1 << 60
    around = [(0, "notes"), (1, "~~BEGIN-MEMORY~~"), (2, MEMORY_HEADER), (3, MEMORY_RULE), (last, "~~END-MEMORY~~"), (last + 1, "more")]
    parts = F.array(*[F.struct(F.lit(i).cast("bigint").alias("row_id"), F.lit(t).alias("line")) for i, t in around])
    body = e.select("source_file", (F.col("event_id") + 10).cast("bigint").alias("row_id"), line.alias("line"))
    every = body.unionByName(e.select("source_file").distinct().select("source_file", F.inline(parts)))
    return written(every.select("source_file", F.lit(0).cast("bigint").alias("split_start"), "row_id", "line"), "lines")


@query("row_accounting", f"""
SELECT concat('U', cast(user_id as varchar)) AS source_file, count(*) + 6 AS n_lines, 4 AS n_outside, 2 AS n_header,
 count(*) FILTER (k = 'blank') AS n_blank, count(*) FILTER (k IN ('key', 'again', 'none')) AS n_rejected, count(*) FILTER (k = 'cut') AS n_cut,
 count(*) FILTER (k = 'row') AS n_typed, true AS adds_up, count(*) FILTER (k IN ('key', 'again')) AS bad_keys, count(*) FILTER (k IN ('row', 'cut')) AS table_rows
FROM (SELECT user_id, {KIND} AS k FROM events) e GROUP BY user_id""")
def row_accounting(spark, sf_dir):
    """Lines by what becomes of them, beside the rows that the typed table holds."""
    lines = broken_lines(spark, sf_dir)
    index = dumps.index_dumps(lines)
    counts = dumps.account_lines(lines, index)
    total = sum((F.col(c) for c in counts.columns if c not in ("source_file", "n_lines")), F.lit(0))
    keys = dumps.rejects(dumps.line_status(lines, index)).groupBy("source_file").agg(F.count_if(F.startswith("reason", F.lit("key "))).alias("bad_keys"))
    rows = dumps.read_section(lines, index, schemas.MEMORY).groupBy("source_file").agg(F.count(F.lit(1)).alias("table_rows"))
    out = counts.withColumn("adds_up", total == F.col("n_lines")).join(keys, "source_file", "left").join(rows, "source_file", "left")
    return out.na.fill(0, ["bad_keys", "table_rows"])


# ---- whole dump files -----------------------------------------------------


def dump_lines(spark, sf_dir) -> DataFrame:
    """Dumps with all six sections, one per database, as lines."""
    m = metrics(spark, sf_dir).select(
        "db_id", "snap", F.date_format("end", "yy/MM/dd HH:mm").alias("end"), "dur_m", "inst", "os_cpu", "os_cpu_max", "exec_s"
    )
    mem = view(spark, sf_dir, "v_memory")
    aas, waits = view(spark, sf_dir, "v_aas"), view(spark, sf_dir, "v_top_wait")
    sql = top_sql(spark, sf_dir)
    used = m.select("db_id").unionByName(sql.select("db_id")).distinct()
    os_info = view(spark, sf_dir, "v_os_info").join(used, "db_id", "left_semi")
    # Wait classes and event names in alphabetical order inside a snapshot.
    letter = F.ascii("WAIT_CLASS") * 10
    name = letter + F.substr(F.col("EVENT_NAME"), F.lit(-1)).cast("int")
    chunk, db, snap = F.lit(0), F.col("db_id"), F.col("SNAP_ID") * 10000
    parts = [
        (os_info, schemas.OS_INFORMATION, {"STAT_NAME": 20, "STAT_VALUE": 30}, F.col("line_pos")),
        (mem, schemas.MEMORY, {"SNAP_ID": 10, "INSTANCE_NUMBER": 15, "SGA": 8, "PGA": 8, "TOTAL": 8}, snap + F.col("INSTANCE_NUMBER")),
        (m, schemas.MAIN_METRICS, {"snap": 10, "dur_m": 8, "end": 14, "inst": 5, "os_cpu": 12, "os_cpu_max": 12, "exec_s": 8},
         F.col("snap") * 10 + F.col("inst")),
        (aas, schemas.ACTIVE_SESSIONS, {"SNAP_ID": 10, "WAIT_CLASS": 20, "AVG_SESS": 14}, snap + letter),
        (waits, schemas.TIMED_EVENTS, {"SNAP_ID": 10, "WAIT_CLASS": 20, "EVENT_NAME": 30, "PCTDBT": 8, "TOTAL_TIME_S": 14}, snap + name),
    ]
    rendered = [render.section_lines(df, s, w, db, chunk, order) for df, s, w, order in parts]
    return render.stack_sections([*rendered, sql_lines(spark, sf_dir)])


def dump_files(spark, sf_dir) -> str:
    path = scratch_path(spark, "dumps")
    render.write_dumps(dump_lines(spark, sf_dir), path, "gzip")
    return path


@query("dump_files_metrics", with_views("""
SELECT replace(m.db_id, 'DB', '') AS db_id, snap, inst, cast(dur_m as bigint) AS dur_m, strftime(end_ts, '%Y-%m-%d %H:%M') AS "end",
 strftime(end_ts - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS start, cast(os_cpu as double) AS os_cpu, cast(os_cpu_max as double) AS os_cpu_max,
 cast(exec_s as double) AS exec_s, cast(NULL as double) AS read_mb_s FROM v_main_metrics m
WHERE m.db_id IN (SELECT db_id FROM v_os_info)""", "v_main_metrics", "v_os_info"))
def dump_files_metrics(spark, sf_dir):
    """Written to text files, read back, typed, and named by the database id in each file."""
    lines = dumps.read_dump_lines(spark, dump_files(spark, sf_dir))
    index = dumps.index_dumps(lines, [schemas.OS_INFORMATION, schemas.MAIN_METRICS])
    # One pass over the text for both sections.
    known = written(dumps.parse_known(lines, index, [schemas.OS_INFORMATION, schemas.MAIN_METRICS]), "cells")
    owner = cleaning.os_wide(dumps.from_known(known, schemas.OS_INFORMATION), ["source_file"])
    m = dumps.from_known(known, schemas.MAIN_METRICS)
    return plain(m.join(owner.select("source_file", F.col("dbid").alias("db_id")), "source_file").select(
        "db_id", "snap", "inst", "dur_m", "end", "start", "os_cpu", "os_cpu_max", "exec_s", "read_mb_s"
    ))


COMPLETE = "(SELECT db_id FROM v_top_sql INTERSECT SELECT db_id FROM v_memory INTERSECT SELECT db_id FROM v_os_info)"


# An empty cell is an empty text, not a missing one.
AS_PARSED = ("as varchar(20))) END AS MODULE", "as varchar(20))) ELSE '' END AS MODULE")
OWN = f"db_id IN ({with_views(f'SELECT db_id FROM {COMPLETE} c', *ALL_VIEWS)})"
NAMED = "SELECT * FROM v_os_info WHERE STAT_NAME = 'DB_NAME' AND db_id IN (SELECT db_id FROM v_main_metrics UNION SELECT db_id FROM v_top_sql)"


@query("dump_files_documents", f"""
SELECT 'os_info' AS doc_type, cast(NULL as int) AS hour, cast(NULL as int) AS instance, cast(0 as bigint) AS page, cast(NULL as bigint) AS snap_id,
 '' AS snap_ids, concat('Database: ', max(STAT_VALUE)) AS content FROM ({with_views(NAMED, *ALL_VIEWS)}) o GROUP BY db_id
UNION ALL SELECT 'snapshot_superdoc', NULL, instance, page, snap_id, '', content FROM ({with_views(SNAPSHOT_DOCS, *ALL_VIEWS)}) s WHERE {OWN}
UNION ALL SELECT 'hourly_superdoc', hour, NULL, page, NULL, coalesce(snap_ids, ''), split_part(content, chr(10), 1) FROM ({HOURLY_SQL}) h WHERE {OWN}
""".replace(*AS_PARSED))
def dump_files_documents(spark, sf_dir):
    """All documents built from the files; of environment and hourly ones a single line is compared."""
    tables = pipeline.read_tables(spark, dump_files(spark, sf_dir))
    built = pipeline.build_documents(tables, page_rows=SNAPSHOT_PAGE)
    kind, line = F.col("doc_type"), F.split("content", "\n")
    return built.select(
        "doc_type", "hour", "instance", F.col("page").cast("bigint").alias("page"), "snap_id",
        F.array_join(F.coalesce(F.transform("snap_ids", lambda s: s.cast("string")), F.array().cast("array<string>")), ",").alias("snap_ids"),
        F.when(kind == "os_info", line[1]).when(kind == "hourly_superdoc", line[0]).otherwise(F.col("content")).alias("content"),
    )


@query("dump_report_prompts")
def dump_report_prompts(spark, sf_dir):
    """From dump files to one prompt per database with the offline embedding."""
    tables = pipeline.read_tables(spark, dump_files(spark, sf_dir))
    documents = pipeline.build_documents(tables)
    path = scratch_path(spark, "built")
    documents.write.parquet(path)
    return pipeline.report_prompts(spark.read.parquet(path), pipeline.range_requests(tables))


@query("export_sections", f"""
SELECT 'CUSTOMERS' AS section, cast(c_custkey as varchar) AS key, c_name AS name FROM customer
UNION ALL SELECT 'SUPPLIERS', cast(s_suppkey as varchar), s_name FROM supplier""")
def export_sections(spark, sf_dir):
    """Two sections parsed, written as CSV folders and read again."""
    c = section(customers(spark, sf_dir), "CUSTOMERS", CUSTOMER_WIDTHS, "C_KEY")
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("dump"), F.col("s_suppkey").alias("S_KEY"),
        F.col("s_name").alias("S_NAME"),
    )
    lines = kept_lines(render.stack_sections([c, section(s, "SUPPLIERS", {"S_KEY": 10, "S_NAME": 20}, "S_KEY")]))
    index = dumps.index_dumps(lines)
    found = {n: dumps.read_any_section(lines, index, n) for n in ("CUSTOMERS", "SUPPLIERS")}
    written = exports.export_sections(found, scratch_path(spark, "sections"), "csv")

    def back(name: str, key: str, label: str) -> DataFrame:
        df = spark.read.option("header", True).csv(written[name])
        return df.select(F.lit(name).alias("section"), F.col(key).alias("key"), F.col(label).alias("name"))

    return back("CUSTOMERS", "C_KEY", "C_NAME").unionByName(back("SUPPLIERS", "S_KEY", "S_NAME"))


@query("export_formats", """
SELECT fmt, cast(s_suppkey as varchar) AS key, s_name AS name FROM supplier, (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS fmt) f""")
def export_formats(spark, sf_dir):
    """One section parsed, written in every format and read again."""
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("dump"), F.col("s_suppkey").alias("S_KEY"),
        F.col("s_name").alias("S_NAME"),
    )
    lines = kept_lines(section(s, "SUPPLIERS", {"S_KEY": 10, "S_NAME": 20}, "S_KEY"))
    found = {"SUPPLIERS": dumps.read_any_section(lines, dumps.index_dumps(lines), "SUPPLIERS")}
    back = []
    for fmt in sorted(exports.FORMATS):
        path = exports.export_sections(found, scratch_path(spark, "sections"), fmt)["SUPPLIERS"]
        df = spark.read.format(fmt).option("header", True).load(path)
        back.append(df.select(F.lit(fmt).alias("fmt"), F.col("S_KEY").cast("string").alias("key"), F.col("S_NAME").alias("name")))
    return reduce(DataFrame.unionByName, back)
