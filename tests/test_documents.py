import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from perfsnap.operators import cleaning, docs, rollups

METRICS = "db_id string, snap bigint, inst int, dur_m bigint, end timestamp, start timestamp, os_cpu double, os_cpu_max double, aas double"
END = dt.datetime(2020, 9, 1, 22, 0)


def metric(db="a", snap=3381, inst=1, end=END, cpu=8.3):
    return (db, snap, inst, 59, end, end and end - dt.timedelta(minutes=59), cpu, 42.7, 89.9)


@pytest.fixture(scope="module")
def build(spark):
    def make(metrics, memory=(), sessions=(), waits=(), sql=(), **kw):
        frames = (
            spark.createDataFrame(metrics, METRICS),
            spark.createDataFrame(list(memory), "db_id string, SNAP_ID bigint, INSTANCE_NUMBER int, SGA double, PGA double, TOTAL double, line_pos int"),
            spark.createDataFrame(list(sessions), "db_id string, SNAP_ID bigint, WAIT_CLASS string, AVG_SESS double, line_pos int"),
            spark.createDataFrame(list(waits), "db_id string, SNAP_ID bigint, EVENT_NAME string, WAIT_CLASS string, PCTDBT double, TOTAL_TIME_S double, line_pos int"),
            spark.createDataFrame(
                list(sql), "db_id string, SNAP_ID bigint, SQL_ID string, PARSING_SCHEMA_NAME string, MODULE string, PLAN_CHANGE double,"
                "ELAP_RANK int, ELAP_S double, CPU_T_S double, EXECS double, BUFFER_GETS double"),
        )
        os_dim = cleaning.os_wide(spark.createDataFrame(
            [("a", "DB_NAME", "OLD", 1), ("a", "DB_NAME", "SALES", 2), ("a", "!PLATFORM_NAME", "Solaris", 3), ("b", "DB_NAME", "HR", 1)],
            "db_id string, STAT_NAME string, STAT_VALUE string, line_pos int"))
        return frames, os_dim

    return make


def test_snapshot_document_shows_its_figures(build):
    frames, os_dim = build(
        [metric()],
        memory=[("a", 3381, 1, 10.0, 2.5, 12.5, 1), ("a", 3381, 1, 99.0, 99.0, 99.0, 2), ("b", 3381, 1, 7.0, 7.0, 7.0, 1)],
        sessions=[("a", 3381, "User I/O", 1.5, 2), ("a", 3381, "CPU", 0.5, 1), ("b", 3381, "wrong", 1.0, 1)],
        waits=[("a", 3381, "db file read", "User I/O", 12.0, 345.6, 1)],
        sql=[("a", 3381, "q1", "APP", "web", 1.0, 1, 9.25, 2.0, 3.0, 4.0)],
    )
    (d,) = docs.snapshot_documents(*frames, os_dim).collect()
    for part in (
        "Database: SALES", "Platform: Solaris", "Number: 3381", "From: 2020-09-01 21:01", "To: 2020-09-01 22:00", "Minutes: 59",
        "OS CPU: 8.3 % (peak 42.7 %)", "Average active sessions: 89.9", "SGA 10 GB, PGA 2.5 GB, total 12.5 GB",
        "- CPU: 0.5\n- User I/O: 1.5", "db file read (User I/O): 12 % of DB time, 345.6 s", "1. SQL q1: schema APP, module web",
        "1 SQL changed plan.", "Redo MB/s: N/A",
    ):
        assert part in d.content, part
    assert "wrong" not in d.content and len(re.findall(r"^\[\d\]", d.content, re.M)) == 9
    assert (d.doc_type, d.snap_id, d.instance, d.duration_min, d.end_time) == ("snapshot_superdoc", 3381, 1, 59.0, END)


def test_missing_sections_have_a_note_and_instances_share_lists(build):
    frames, os_dim = build([metric(inst=1), metric(inst=2), metric("b", 1)], sessions=[("a", 3381, "CPU", 0.5, 1)])
    got = {(d.db_id, d.instance): d.content for d in docs.snapshot_documents(*frames, os_dim).collect()}
    assert len(got) == 3 and all("- CPU: 0.5" in got["a", i] for i in (1, 2))
    for note in ("No memory figures.", "No session figures.", "No wait events.", "No SQL was recorded for this snapshot."):
        assert note in got["b", 1]


def test_long_lists_go_on_in_further_documents(build):
    sql = [("a", 3381, f"q{i:03}", "APP", None, 0.0, i, 1.0, 1.0, 1.0, 1.0) for i in range(1, 26)]
    frames, os_dim = build([metric()], sql=sql, sessions=[("a", 3381, f"w{i:02}", 1.0, i) for i in range(12)])
    pages = docs.snapshot_documents(*frames, os_dim, page_rows=10).orderBy("page").collect()
    assert [p.page for p in pages] == [0, 1, 2] and len({p.doc_id for p in pages}) == 3
    listed = [s for p in pages for s in re.findall(r"SQL (q\d+):", p.content)]
    assert listed == [s[2] for s in sql]
    assert "part 2" in pages[1].content and "w11" in pages[1].content and "[1] Snapshot" not in pages[1].content
    assert "[4]" not in pages[2].content


def test_lists_are_put_together_where_they_are_numbered(build):
    """Each section is dealt by snapshot once, SQL for lists and summary alike, and no text is shuffled (review F9)."""
    frames, os_dim = build([metric()])
    df = docs.snapshot_documents(*frames, os_dim)
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    union = next(i for i, line in enumerate(plan) if line.endswith("- Union") and "page" in plan[i + 1])
    above, level = [], depth(plan[union])
    for line in reversed(plan[:union]):
        if depth(line) < level:
            level = depth(line)
            above.append(line)
    assert any("collect_list" in line for line in above) and not any("Exchange" in line for line in above)
    listed = {line.split("Exchange ")[1].split(", [plan_id")[0].replace("#", " ").split(" ")[0] for line in plan[union:] if "Exchange " in line}
    assert sum("Exchange " in line for line in plan[union:]) == 3 and all(x.startswith("hashpartitioning(db_id") for x in listed)


def test_documents_are_the_same_when_groups_are_spread(build, monkeypatch):
    sql = [(db, snap, f"q{i % 7}", "AB"[i % 2], [None, "m", "n"][i % 3], float(i % 5 == 0), [None, 1, 2][i % 3] if snap == 1 else i, float(i % 4), 1.0, 2.0, float(i))
           for db, snap, n in (("a", 1, 20), ("a", 2, 7), ("b", 1, 3), (None, 1, 4), ("a", None, 4)) for i in range(n)]
    none = [("b", 2, None, None, None, None, None, None, None, None, None)]
    frames, os_dim = build(
        [metric(snap=1), metric(snap=1, inst=2), metric(snap=2), metric("b", 1), metric("b", 2), metric("b", 3), metric(None, 1)], sql=sql + none,
        sessions=[("a", 1, f"w{i}", 1.0, i) for i in range(9)] + [(None, 1, "w", 1.0, 1)], waits=[("b", 3, f"e{i}", "c", 1.0, 2.0, i) for i in range(7)])
    made = []
    for spread in (False, True):
        monkeypatch.setattr(docs, "has_large_group", lambda groups, spread=spread: spread)
        rows = docs.snapshot_documents(*frames, os_dim, page_rows=3, sql_tie=("SQL_ID", "BUFFER_GETS")).select("db_id", "snap_id", "instance", "page", "content").collect()
        made.append(sorted(rows, key=str))
    assert made[0] == made[1] and len(made[0]) == 7 + 7 + 3 + 1 + 1 + 3 + 1
    first = {(r.db_id, r.snap_id): r.content for r in made[0] if r.page == 0}
    assert "7 SQL took" in first["a", 2] and all("from 2 schemas; usual module m." in first[key] for key in (("a", 1), ("a", 2), ("b", 1)))


def test_hourly_documents(build):
    day = dt.timedelta(days=1)
    rows = [metric(snap=1, cpu=10.0), metric(snap=1, inst=2, cpu=20.0), metric(snap=2, end=END + day, cpu=60.0), metric(snap=3, end=None)]
    frames, os_dim = build(rows, memory=[("a", 1, 1, 10.0, 1.0, 11.0, 1), ("a", 2, 1, 20.0, 2.0, 22.0, 2)],
                           sessions=[("a", 1, "CPU", 1.0, 1), ("a", 2, "CPU", 2.0, 2)])
    m, memory, sessions, waits, _ = frames
    (d,) = docs.hourly_documents(m, memory, sessions, waits, os_dim).collect()
    assert (d.hour, d.snap_ids, d.snap_id) == (22, [1, 2], None)
    for part in ("Snapshots: 1, 2", "Mean OS CPU: 30 %", "SGA 15 GB, PGA 1.5 GB", "- CPU: 1.5", "No wait events.",
                 "CR blocks received per second: N/A"):
        assert part in d.content, part
    memory_rows = rollups.with_hours(memory, m).count()
    assert memory_rows == 2  # two instances in one snapshot do not double its rows


def test_range_texts_for_an_empty_range(spark):
    ranges = spark.createDataFrame([("a", 1, 9)], "db_id string, start_snap int, end_snap int")
    trend = spark.createDataFrame([], "db_id string, SQL_ID string, schema string, module string, command string, snaps bigint, total_execs double,"
                                  "total_cpu_s double, total_elapsed_s double, total_buffer_gets double, total_read_mb double, total_io_wait_s double,"
                                  "total_physical_read_gb double, total_direct_w_gb double, max_plan_changes double, plans_seen double")
    assert docs.trend_text(trend, ranges).first().content == "No SQL in snapshots 1 to 9."


def test_shapes(spark):
    df = spark.createDataFrame([("t", "p", "c"), (None, "p", "c"), (None, None, "c"), (None, None, None)], "text string, page_content string, content string")
    shaped = docs.normalize_documents(df)
    assert [r.content for r in shaped.collect()] == ["t", "p", "c", None]
    with pytest.raises(ValueError):
        docs.normalize_documents(spark.range(1))
    with pytest.raises(ValueError, match="missing content"):
        docs.check_documents(shaped, ["content"])
    meta = spark.range(1).select(F.lit(None).cast("int").alias("a"), F.lit(3).alias("b"), F.lit(True).alias("c"))
    assert meta.select(docs.metadata_text(["a", "b", "c"])).first()[0] == {"a": "", "b": "3", "c": "true"}
