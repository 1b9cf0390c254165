"""Text documents from the section tables.

A document is one row of ``DOCUMENT_COLUMNS``. Lists inside a document (waits,
SQL, snapshots of an hour) have no bound in the data, so a list longer than
``page_rows`` goes on in further documents of the same subject: ``page`` 0 holds
the figures and the first part of every list, later pages the rest. Nothing is
left out and no row grows with the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfsnap.functions.text import lines, number_text, says, shown, shown_number
from perfsnap.operators import analytics, rollups
from perfsnap.operators.ranking import first_rows, grouped_row_number, has_large_group
from perfsnap.session import written
from perfsnap.sources.schemas import METRIC_NUMBERS

DB = ("db_id",)
PAGE_ROWS = 500

# Document kinds.
OS_INFO, SNAPSHOT, HOURLY = "os_info", "snapshot_superdoc", "hourly_superdoc"

DOCUMENT_COLUMNS = {
    "doc_id": "string", "content": "string", "doc_type": "string", "db_id": "string", "db_name": "string",
    "snap_id": "bigint", "instance": "int", "hour": "int", "page": "int", "snap_ids": "array<bigint>",
    "start_time": "timestamp", "end_time": "timestamp", "duration_min": "double",
}

NO_SQL = "No SQL was recorded for this snapshot."
NO_SESSIONS = "No session figures."
NO_WAITS = "No wait events."


def document_id(doc_type: Column | str, page: Column) -> Column:
    """The same subject always gets the same id, so a second load replaces the first."""
    parts = [F.lit(doc_type) if isinstance(doc_type, str) else doc_type]
    parts += [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("db_id", "snap_id", "instance", "hour")]
    return F.sha2(F.concat_ws("|", *parts, page.cast("string")), 256)


def as_documents(df: DataFrame, doc_type: str, extra: Sequence[str] = ()) -> DataFrame:
    """Fill up to the document columns and add the id."""
    have = {c.lower() for c in df.columns}
    filled = df.select(
        *[
            (F.col(c).cast(t) if c in have else F.lit(0 if c == "page" else None).cast(t)).alias(c)
            for c, t in DOCUMENT_COLUMNS.items()
            if c not in ("doc_id", "doc_type")
        ],
        *extra,
    )
    return filled.withColumn("doc_type", F.lit(doc_type)).withColumn("doc_id", document_id(doc_type, F.col("page"))).select(
        *DOCUMENT_COLUMNS, *extra
    )


# ---- paging ---------------------------------------------------------------


def _paged(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], text: Column, kind: str, page_rows: int, spread: bool,
    separator: str,
) -> DataFrame:
    """Texts of each group joined in order, at most ``page_rows`` to a page.

    Rows are numbered as they are and put into words afterwards, so figures are
    shuffled rather than sentences.
    """
    ranked = grouped_row_number(df, by, [*order, *[F.asc(c) for c in df.columns]], "_n", spread=spread)
    place = F.struct("_n", text.alias("text"))
    return (
        ranked.withColumn("page", F.floor((F.col("_n") - 1) / page_rows).cast("int"))
        .groupBy(*by, "page")
        .agg(F.sort_array(F.collect_list(place)).alias("_rows"))
        .select(
            *by, "page", F.array_join(F.transform("_rows", lambda r: r["text"]), separator).alias(kind)
        )
    )


def _side_by_side(parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Pages of several lists as columns, one row per page number."""
    return reduce(lambda left, right: left.join(right, [*by, "page"], "full"), parts)


def _lists_in_pages(lists: dict[str, tuple[DataFrame, Column]], by: Sequence[str], page_rows: int, separator: str) -> DataFrame:
    """Pages of several numbered lists as columns, one row per page number.

    Rows of all lists go through one grouping, so lists whose rows lie by ``by`` already
    are put together where they are and no text is shuffled.
    """
    rows = reduce(DataFrame.unionByName, [
        df.select(*by, F.floor((F.col("_n") - 1) / page_rows).cast("int").alias("page"), F.lit(kind).alias("_kind"), F.struct("_n", text.alias("text")).alias("_row"))
        for kind, (df, text) in lists.items()])
    held = rows.groupBy(*by, "page").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("_kind") == kind, F.col("_row")))).alias(kind) for kind in lists])
    joined = lambda kind: F.array_join(F.transform(kind, lambda r: r["text"]), separator)
    return held.select(*by, "page", *[F.when(F.size(kind) > 0, joined(kind)).alias(kind) for kind in lists])


def _file_order(df: DataFrame, otherwise: Sequence[str]) -> list[Column]:
    return [F.col("line_pos")] if "line_pos" in df.columns else [F.col(c) for c in otherwise]


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name.lower() in {c.lower() for c in df.columns} else F.lit(None).cast("string")


def _part(page: Column) -> Column:
    return F.when(page > 0, F.concat(F.lit(", part "), (page + 1).cast("string"))).otherwise("")


# ---- single parts ---------------------------------------------------------


def os_documents(os_dim: DataFrame) -> DataFrame:
    """One document per database from its wide environment row."""
    content = lines(
        "Environment",
        says("Database: ", shown("db_name")),
        says("Version: ", shown("version")),
        says("Instances: ", shown("instances")),
        says("Hosts: ", shown("hosts")),
        says("CPUs: ", shown("num_cpus")),
        says("CPU cores: ", shown("num_cpu_cores")),
        says("CPU sockets: ", shown("num_cpu_sockets")),
        says("Memory (GB): ", shown("physical_memory_gb")),
        says("Platform: ", shown("platform_name")),
    )
    return as_documents(os_dim.withColumn("content", content), OS_INFO)


def sql_text(df: DataFrame) -> Column:
    """One SQL of a snapshot with all its figures."""
    def n(name: str) -> Column:
        return shown_number(_field(df, name))

    return says(
        shown("ELAP_RANK") if "elap_rank" in {c.lower() for c in df.columns} else F.lit("-"),
        ". SQL ", shown("SQL_ID"),
        ": schema ", shown(_field(df, "PARSING_SCHEMA_NAME")),
        ", module ", shown(_field(df, "MODULE")),
        ", command ", shown(_field(df, "COMMAND_NAME")),
        ", executions ", n("EXECS"),
        ", buffer gets ", n("BUFFER_GETS"),
        ", rows ", n("ROWS_PROC"),
        ", CPU ", n("CPU_T_S"), " s",
        ", elapsed ", n("ELAP_S"), " s",
        ", read ", n("READ_MB"), " MB",
        ", I/O wait ", n("IO_WAIT"), " s",
        ", physical read ", n("PHY_READ_GB"), " GB",
        ", direct write ", n("DIRECT_W_GB"), " GB",
        ", PX servers ", n("PX_SERVERS_EXECS"),
        ", plan ", shown(_field(df, "PLAN_HASH")),
        ", plan changes ", n("PLAN_CHANGE"),
        ", plans ", n("PLANS"),
    )


def summary_text() -> Column:
    """Sentences on the columns of ``summarize_top_sql``; null without SQL."""
    one = lambda c: number_text(c, 1)
    whole = lambda c: F.floor(c).cast("string")
    return F.concat_ws(
        " ",
        F.concat(
            F.col("unique_sql").cast("string"), F.lit(" SQL took "), one("total_elapsed_s"), F.lit(" s, of it "),
            one("total_cpu_s"), F.lit(" s CPU."),
        ),
        F.concat(
            whole("total_execs"), F.lit(" executions from "), F.col("unique_schemas").cast("string"),
            F.lit(" schemas; usual module "), F.col("top_module"), F.lit("."),
        ),
        F.concat(
            F.lit("Heaviest: "), F.col("top_sql_id"), F.lit(" with "), one("top_elapsed_s"), F.lit(" s elapsed, "),
            one("top_cpu_s"), F.lit(" s CPU, "), whole("top_execs"), F.lit(" executions, "),
            whole("top_buffer_gets"), F.lit(" buffer gets."),
        ),
        F.when(
            F.col("plan_change_rows") > 0,
            F.concat(F.col("plan_change_rows").cast("string"), F.lit(" SQL changed plan.")),
        ),
    )


def wait_text() -> Column:
    return says(
        shown("EVENT_NAME"), " (", shown("WAIT_CLASS"), "): ", shown_number("PCTDBT"), " % of DB time, ",
        shown_number("TOTAL_TIME_S"), " s",
    )


def session_text(value: str) -> Column:
    return says("- ", shown("WAIT_CLASS"), ": ", shown_number(value))


# ---- snapshots ------------------------------------------------------------


def first_memory(memory: DataFrame, keys: Sequence[str] = DB) -> DataFrame:
    """The first memory row of each snapshot and instance."""
    order = F.struct("line_pos") if "line_pos" in memory.columns else F.struct("SGA", "PGA", "TOTAL")
    return (
        memory.groupBy(*keys, "SNAP_ID", "INSTANCE_NUMBER")
        .agg(F.min_by(F.struct("SGA", "PGA", "TOTAL"), order).alias("_m"))
        .select(*keys, "SNAP_ID", "INSTANCE_NUMBER", "_m.SGA", "_m.PGA", "_m.TOTAL")
    )


def with_memory(metrics: DataFrame, memory: DataFrame, keys: Sequence[str] = DB) -> DataFrame:
    """Metric rows with the memory of their instance, where known."""
    mem = first_memory(memory, keys).withColumnsRenamed({"SNAP_ID": "snap", "INSTANCE_NUMBER": "inst"})
    return metrics.join(mem, [*keys, "snap", "inst"], "left")


def snapshot_join(
    metrics: DataFrame, memory: DataFrame, sessions: DataFrame, waits: DataFrame, top_sql: DataFrame, os_dim: DataFrame,
    keys: Sequence[str] = DB,
) -> DataFrame:
    """What a snapshot document draws on, as columns: row counts and totals per section."""
    by = [*keys, "SNAP_ID"]
    aas = sessions.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("AVG_SESS").alias("sum_avg_sess"))
    tw = waits.groupBy(*by).agg(F.count(F.lit(1)).alias("n_waits"), F.sum("TOTAL_TIME_S").alias("sum_wait_s"))
    sql = top_sql.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sql_rows"), F.sum("ELAP_S").alias("sum_elapsed_s"))
    out = with_memory(metrics, memory, keys)
    for part in (aas, tw, sql):
        out = out.join(part.withColumnRenamed("SNAP_ID", "snap"), [*keys, "snap"], "left")
    return out.join(os_dim.select(*keys, "db_name", "platform_name"), list(keys), "left")


def snapshot_documents(
    metrics: DataFrame,
    memory: DataFrame,
    sessions: DataFrame,
    waits: DataFrame,
    top_sql: DataFrame,
    os_dim: DataFrame,
    keys: Sequence[str] = DB,
    page_rows: int = PAGE_ROWS,
    sql_tie: Sequence[str] = ("SQL_ID",),
) -> DataFrame:
    """One document per snapshot and instance, with further pages for long lists."""
    by = [*keys, "SNAP_ID"]
    # Rows without a key belong to no snapshot.
    sessions, waits, top_sql = (df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in by)) for df in (sessions, waits, top_sql))
    spread = has_large_group([(sessions, by), (waits, by), (top_sql, by)])

    def numbered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
        return grouped_row_number(df, by, [*order, *[F.asc(c) for c in df.columns]], "_n", spread=spread)

    ranked = numbered(top_sql, analytics.rank_order(top_sql, sql_tie))
    lists = {
        "sessions": (numbered(sessions, _file_order(sessions, ["WAIT_CLASS"])), session_text("AVG_SESS")),
        "waits": (numbered(waits, _file_order(waits, ["EVENT_NAME"])), wait_text()),
        "sqls": (ranked, sql_text(top_sql)),
    }
    pages = _lists_in_pages(lists, by, page_rows, "\n").withColumnRenamed("SNAP_ID", "snap")
    # Groups that fit a task are summed up where their lists were numbered.
    totals = analytics.summarize_top_sql(top_sql, keys) if spread else analytics.summarize_ranked(ranked, "_n", keys)
    summary = totals.select(*keys, F.col("SNAP_ID").alias("snap"), summary_text().alias("summary"))
    have = {c.lower() for c in metrics.columns}
    m = metrics.withColumns({c: F.lit(None).cast("double") for c in METRIC_NUMBERS if c not in have})
    joined = (
        with_memory(m, memory, keys)
        .join(os_dim.select(*keys, "db_name", "platform_name"), list(keys), "left")
        .join(summary, [*keys, "snap"], "left")
        .join(pages, [*keys, "snap"], "left")
        .withColumn("page", F.coalesce("page", F.lit(0)))
    )
    num, page = shown_number, F.col("page")
    title = says(
        "Snapshot ", shown("snap"), ", instance ", shown("inst"), ", database ", shown("db_name"), _part(page)
    )
    memory_line = F.coalesce(
        F.concat(F.lit("SGA "), number_text("SGA"), F.lit(" GB, PGA "), number_text("PGA"), F.lit(" GB, total "),
                 number_text("TOTAL"), F.lit(" GB")),
        F.lit("No memory figures."),
    )
    whole = lines(
        title,
        "\n[1] Snapshot",
        says("Database: ", shown("db_name")),
        says("Instance: ", shown("inst")),
        says("Platform: ", shown("platform_name")),
        says("Number: ", shown("snap")),
        says("From: ", shown(F.date_format("start", "yyyy-MM-dd HH:mm"))),
        says("To: ", shown(F.date_format("end", "yyyy-MM-dd HH:mm"))),
        says("Minutes: ", num("dur_m")),
        "\n[2] CPU and load",
        says("OS CPU: ", num("os_cpu"), " % (peak ", num("os_cpu_max"), " %)"),
        says("DB time on CPU: ", num("db_cpu_ratio"), " %"),
        says("DB time waiting: ", num("db_wait_ratio"), " %"),
        says("Average active sessions: ", num("aas")),
        says("Executions per second: ", num("exec_s")),
        says("Logons per second: ", num("logons_s")),
        says("SQL response (cs): ", num("sql_res_t_cs")),
        "\n[3] Memory",
        memory_line,
        "\n[4] Active sessions by wait class",
        F.coalesce("sessions", F.lit(NO_SESSIONS)),
        "\n[5] Main waits",
        F.coalesce("waits", F.lit(NO_WAITS)),
        "\n[6] Heaviest SQL",
        F.coalesce("sqls", F.lit(NO_SQL)),
        F.col("summary"),
        "\n[7] I/O",
        says("Read MB/s: ", num("read_mb_s")),
        says("Write MB/s: ", num("write_mb_s")),
        says("Read IOPS: ", num("read_iops")),
        says("Write IOPS: ", num("write_iops")),
        says("Redo MB/s: ", num("redo_mb_s")),
        "\n[8] Cluster cache",
        says("CR blocks received per second: ", num("gc_cr_rec_s")),
        says("Current blocks received per second: ", num("gc_cu_rec_s")),
        "\n[9] Reading",
        "Weigh load, waits, sessions, memory, cluster traffic and SQL together before naming a cause.",
    )
    more = lines(
        title,
        F.when(F.col("sessions").isNotNull(), lines("\n[4] Active sessions by wait class", F.col("sessions"))),
        F.when(F.col("waits").isNotNull(), lines("\n[5] Main waits", F.col("waits"))),
        F.when(F.col("sqls").isNotNull(), lines("\n[6] Heaviest SQL", F.col("sqls"))),
    )
    out = joined.select(
        *keys, "db_name", "page",
        F.when(page == 0, whole).otherwise(more).alias("content"),
        F.col("snap").alias("snap_id"), F.col("inst").alias("instance"),
        F.col("start").alias("start_time"), F.col("end").alias("end_time"), F.col("dur_m").alias("duration_min"),
    )
    return as_documents(out, SNAPSHOT, [k for k in keys if k != "db_id"])


# ---- hours ----------------------------------------------------------------


def hourly_documents(
    metrics: DataFrame,
    memory: DataFrame,
    sessions: DataFrame,
    waits: DataFrame,
    os_dim: DataFrame,
    keys: Sequence[str] = DB,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """One document per hour of the day over all days, with pages for long lists."""
    by = [*keys, "hour"]
    have = {c.lower() for c in metrics.columns}
    m = metrics.withColumns({c: F.lit(None).cast("double") for c in METRIC_NUMBERS if c not in have})
    timed = m.filter(F.col("end").isNotNull()).withColumn("hour", F.hour("end"))
    load_text = says(
        "Snapshot ", shown("snap"), ", instance ", shown("inst"), ": OS CPU ", shown_number("os_cpu"), " % (peak ",
        shown_number("os_cpu_max"), " %), DB time on CPU ", shown_number("db_cpu_ratio"), " %, waiting ",
        shown_number("db_wait_ratio"), " %, sessions ", shown_number("aas"), ", executions/s ",
        shown_number("exec_s"), ", logons/s ", shown_number("logons_s"),
    )
    load = timed.select(
        *by, "snap", "inst", "os_cpu", "os_cpu_max", "db_cpu_ratio", "db_wait_ratio", "aas", "exec_s", "logons_s"
    )
    snaps = rollups.hours_of_snaps(metrics, keys)
    timed_waits = waits.join(snaps, [*keys, "SNAP_ID"])
    memory_text = says(
        "Instance ", shown("INSTANCE_NUMBER"), ": SGA ", shown_number("avg_sga"), " GB, PGA ", shown_number("avg_pga"), " GB"
    )
    mem = rollups.hourly_memory(memory, metrics, keys)
    aas = rollups.hourly_active_sessions(sessions, metrics, keys)
    # Memory and session lists have one row per instance and wait class; the
    # others grow with the days covered.
    spread = has_large_group([(load, by), (timed_waits, by)])
    parts = [
        _paged(snaps, by, [F.col("SNAP_ID")], F.col("SNAP_ID").cast("string"), "snaps", page_rows, spread, ", "),
        _paged(load, by, [F.col("snap"), F.col("inst")], load_text, "load", page_rows, spread, "\n"),
        _paged(mem, by, [F.col("INSTANCE_NUMBER")], memory_text, "memory", page_rows, False, "\n"),
        _paged(aas, by, [F.col("WAIT_CLASS")], session_text("avg_sess"), "sessions", page_rows, False, "\n"),
        _paged(timed_waits, by, [F.col("SNAP_ID"), *_file_order(waits, ["EVENT_NAME"])], wait_text(), "waits", page_rows,
               spread, "\n"),
    ]
    pages = _side_by_side(parts, by)
    joined = (
        pages.join(rollups.hour_of_day_rollup(m, keys), by)
        .join(os_dim.select(*keys, "db_name", "platform_name"), list(keys), "left")
    )
    num, page = shown_number, F.col("page")
    hh = F.lpad(F.col("hour").cast("string"), 2, "0")
    title = says("Hour ", hh, ":00 to ", hh, ":59, database ", shown("db_name"), _part(page))
    named = F.when(F.col("snaps").isNotNull(), F.concat(F.lit("Snapshots: "), F.col("snaps")))
    whole = lines(
        title,
        says("Platform: ", shown("platform_name")),
        named,
        "\n[1] CPU and load",
        says("Mean OS CPU: ", num("avg_os_cpu"), " %"),
        says("Peak OS CPU: ", num("max_os_cpu"), " %"),
        F.col("load"),
        "\n[2] Memory, mean per instance",
        F.coalesce("memory", F.lit("No memory figures.")),
        "\n[3] Active sessions by wait class, mean",
        F.coalesce("sessions", F.lit(NO_SESSIONS)),
        "\n[4] Main waits",
        F.coalesce("waits", F.lit(NO_WAITS)),
        "\n[5] I/O, mean",
        says("Read MB/s: ", num("avg_read_mb_s")),
        says("Write MB/s: ", num("avg_write_mb_s")),
        says("Read IOPS: ", num("avg_read_iops")),
        says("Write IOPS: ", num("avg_write_iops")),
        says("Redo MB/s: ", num("avg_redo_mb_s")),
        "\n[6] Cluster cache, mean",
        says("CR blocks received per second: ", num("avg_gc_cr_rec_s")),
        says("Current blocks received per second: ", num("avg_gc_cu_rec_s")),
        "\n[7] Reading",
        "Look for what this hour has in common on all days.",
    )
    listed = {
        "load": "\n[1] CPU and load", "memory": "\n[2] Memory, mean per instance",
        "sessions": "\n[3] Active sessions by wait class, mean", "waits": "\n[4] Main waits",
    }
    more = lines(
        title, named, *[F.when(F.col(c).isNotNull(), lines(head, F.col(c))) for c, head in listed.items()]
    )
    ids = F.transform(F.split("snaps", ", "), lambda s: s.cast("bigint"))
    out = joined.select(
        *by, "db_name", "page", F.when(page == 0, whole).otherwise(more).alias("content"), ids.alias("snap_ids")
    )
    return as_documents(out, HOURLY, [k for k in keys if k != "db_id"])


# ---- range texts ----------------------------------------------------------
#
# Each text needs its aggregate more than once, so it is computed and kept first.


def _range_words() -> Column:
    return says("snapshots ", shown("start_snap"), " to ", shown("end_snap"))


def trend_text(trend: DataFrame, ranges: DataFrame, keys: Sequence[str] = DB, n: int = 5) -> DataFrame:
    """The heaviest SQL of each requested range in words; a range without SQL says so.

    ``ranges`` has one row per key with ``start_snap`` and ``end_snap``.
    """
    trend = written(trend, "trend")
    one = lambda c: number_text(c, 1)
    whole = lambda c: F.floor(c).cast("string")
    text = says(
        "- ", shown("SQL_ID"), " (schema ", shown("schema"), ", module ", shown("module"), ", command ", shown("command"),
        "): in ", shown("snaps"), " snapshots, elapsed ", one("total_elapsed_s"), " s, CPU ", one("total_cpu_s"),
        " s, executions ", whole("total_execs"), ", buffer gets ", whole("total_buffer_gets"), ", read ",
        one("total_read_mb"), " MB, I/O wait ", one("total_io_wait_s"), " s, physical read ",
        one("total_physical_read_gb"), " GB, direct write ", one("total_direct_w_gb"), " GB, plan changes ",
        shown_number("max_plan_changes"), ", plans ", shown_number("plans_seen"),
    )
    top = _ordered_text(analytics.heaviest(trend, n, keys, "_rank").withColumn("text", text), keys)
    body = lines(
        says("SQL in ", _range_words(), ":"),
        says(shown("n_sql"), " SQL in ", shown("n_entries"), " rows."),
        F.col("text"),
    )
    empty = says("No SQL in ", _range_words(), ".")
    return (
        ranges.join(analytics.aggregate_counts(trend, keys), list(keys), "left")
        .join(top, list(keys), "left")
        .select(*keys, F.when(F.col("n_sql").isNull(), empty).otherwise(body).alias("content"))
    )


def _ordered_text(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Few ranked texts per key as one."""
    gathered = F.sort_array(F.collect_list(F.struct("_rank", "text")))
    return df.groupBy(*keys).agg(F.array_join(F.transform(gathered, lambda r: r["text"]), "\n").alias("text"))


def plan_change_text(
    changes: DataFrame, ranges: DataFrame, keys: Sequence[str] = DB, page_rows: int = PAGE_ROWS
) -> DataFrame:
    """All SQL with plan changes in each range in words, in pages."""
    listed = lambda c: F.array_join(c, ", ")
    text = says(
        "- ", shown("SQL_ID"), ": schemas ", listed("schemas"), "; modules ", listed("modules"), "; plans ",
        listed("plan_hashes"), "; plans at once ", shown_number("min_plans"), " to ", shown_number("max_plans"),
        "; largest change flag ", shown_number("max_plan_change"), "; in ", shown("snaps"), " snapshots; elapsed ",
        number_text("total_elapsed_s", 1), " s; CPU ", number_text("total_cpu_s", 1), " s",
    )
    changes = written(changes, "changes")
    spread = has_large_group([(changes, keys)])
    pages = _paged(changes, keys, [F.col("SQL_ID")], text, "text", page_rows, spread, "\n")
    totals = changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_changed"))
    body = lines(
        says("SQL with changing plans in ", _range_words(), _part(F.col("page")), ":"),
        says(shown("n_changed"), " SQL."),
        F.col("text"),
    )
    empty = says("No SQL with changing plans in ", _range_words(), ".")
    return (
        ranges.join(totals, list(keys), "left")
        .join(pages, list(keys), "left")
        .select(
            *keys, F.coalesce("page", F.lit(0)).alias("page"),
            F.when(F.col("n_changed").isNull(), empty).otherwise(body).alias("content"),
        )
    )


def bottleneck_text(classified: DataFrame, ranges: DataFrame, keys: Sequence[str] = DB, n: int = 10) -> DataFrame:
    """Label counts and the heaviest SQL with their labels, in words."""
    classified = written(classified, "classified")
    spread = analytics.label_distribution(classified, keys).withColumnRenamed("seen_order", "_rank")
    counts = spread.withColumn("text", F.concat("label", F.lit(": "), F.col("n_sql").cast("string")))
    gathered = F.sort_array(F.collect_list(F.struct("_rank", "text")))
    dist = counts.groupBy(*keys).agg(
        F.array_join(F.transform(gathered, lambda r: r["text"]), ", ").alias("distribution")
    )
    one = lambda c: number_text(c, 1)
    text = says(
        "- ", shown("SQL_ID"), " (", F.array_join("bottleneck_class", ", "), "): schema ", shown("schema"), ", module ",
        shown("module"), ", command ", shown("command"), ", in ", shown("snaps"), " snapshots, elapsed ",
        one("total_elapsed_s"), " s, CPU ", one("total_cpu_s"), " s, executions ",
        F.floor("total_execs").cast("string"), ", buffer gets ", F.floor("total_buffer_gets").cast("string"), ", read ",
        one("total_read_mb"), " MB, I/O wait ", one("total_io_wait_s"), " s",
    )
    top = _ordered_text(first_rows(classified, keys, analytics.by_elapsed(), n, "_rank").withColumn("text", text), keys)
    body = lines(
        says("Bottlenecks in ", _range_words(), ":"), says("Labels: ", F.col("distribution")), F.col("text")
    )
    empty = says("No SQL to label in ", _range_words(), ".")
    return (
        ranges.join(dist, list(keys), "left")
        .join(top, list(keys), "left")
        .select(*keys, F.when(F.col("distribution").isNull(), empty).otherwise(body).alias("content"))
    )


# ---- shape ----------------------------------------------------------------

# Content columns in the order they are looked at.
CONTENT_NAMES = ("text", "page_content", "content")


def normalize_documents(df: DataFrame) -> DataFrame:
    """Content under one name, whichever of the three names it came with."""
    present = [c for c in CONTENT_NAMES if c in df.columns]
    if not present:
        raise ValueError(f"no content column among {df.columns}")
    content = F.coalesce(*[F.col(c) for c in present])
    return df.withColumn("_content", content).drop(*present).withColumnRenamed("_content", "content")


def bad_documents(df: DataFrame, required: Sequence[str] = ("content", "metadata")) -> DataFrame:
    """Documents that lack content or metadata, with what is missing."""
    issue = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required])
    return df.withColumn("issue", issue).filter(F.col("issue") != "")


def check_documents(df: DataFrame, required: Sequence[str] = ("content", "metadata")) -> DataFrame:
    """The documents, or an error naming the first ten bad ones."""
    bad = bad_documents(df, required).limit(10).collect()
    if bad:
        raise ValueError("invalid documents: " + "; ".join(r["issue"] for r in bad))
    return df


def metadata_text(columns: Sequence[str]) -> Column:
    """Typed columns as a map of texts; a missing value is an empty text."""
    pairs = [x for c in columns for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return F.create_map(*pairs)


def all_documents(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
