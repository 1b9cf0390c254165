"""Range blocks and metric relations against the direct way and a plain version."""

import random

import numpy as np
import pytest

import compare
from perfsnap.operators import analytics, health, ranges
from test_analytics import frame, row

ASKED = "request_id string, db_id string, start_snap bigint, end_snap bigint"


def test_blocks_make_up_each_range(spark):
    rng = random.Random(2)
    asked = [(f"r{i}", "a", s, s + rng.choice([0, 1, 2, 7, 30, 100]) - rng.choice([0, 0, 1])) for i, s in enumerate(rng.randint(-70, 90) for _ in range(120))]
    requests = spark.createDataFrame(asked, ASKED)
    top = ranges.levels_for(requests)
    covered = {}
    for r in ranges.range_blocks(requests, top).collect():
        covered.setdefault(r.request_id, []).append(range(r.block << r.level, (r.block + 1) << r.level))
    for name, _, low, high in asked:
        parts = covered.get(name, [])
        assert sorted(s for p in parts for s in p) == list(range(low, high + 1))
        assert len(parts) <= 2 * max(high - low + 1, 1).bit_length()
    assert ranges.levels_for(requests.limit(0)) == -1


@pytest.fixture(scope="module")
def sql_rows(spark):
    rng = random.Random(7)
    rows = [row(rng.choice("ab"), rng.randint(-5, 60), rng.choice([None, "s", "t", "u"]), rng.choice(["x", "y", None]), rng.choice(["m", None]),
                rng.choice(["p", "q"]) if rng.random() < 0.1 else "p", float(rng.random() < 0.05), 1.0 + (rng.random() < 0.05), 1, float(rng.randint(1, 9)), i) for i in range(900)]
    return frame(spark, rows + rows[:40])


def asked_ranges(spark):
    return spark.createDataFrame([("all", "a", -5, 60), ("one", "a", 7, 7), ("part", "b", 3, 44), ("none", "b", 70, 99), ("back", "a", 9, 4), ("other", "c", 1, 9), ("part2", "a", 3, 44)], ASKED)


@pytest.mark.parametrize("way", ["trend", "plans"])
def test_requests_as_by_reading_rows(spark, sql_rows, way):
    requests = asked_ranges(spark)
    rows = analytics.rows_in_requests(sql_rows, requests).drop("start_snap", "end_snap")
    keys = ("request_id", "db_id")
    if way == "trend":
        got, want = ranges.sql_trend_in_requests(sql_rows, requests), analytics.sql_trend_over_range(rows, keys=keys)
    else:
        got, want = ranges.plan_changes_in_requests(sql_rows, requests), analytics.detect_sql_plan_changes(rows, keys=keys)
    assert want.count() > 3
    assert not compare.differences(compare.spark_rows(got), compare.spark_rows(want))


def test_no_requests_and_no_rows(spark, sql_rows):
    assert ranges.sql_trend_in_requests(sql_rows, asked_ranges(spark).limit(0)).count() == 0
    assert ranges.sql_trend_in_requests(sql_rows.limit(0), asked_ranges(spark)).count() == 0


def test_distinct_counts_by_sketch(spark):
    rows = frame(spark, [row("a", s, f"q{(s * 37 + i) % 5000}", f"x{i % 3}") for s in range(32) for i in range(400)])
    requests = spark.createDataFrame([("all", "a", 0, 31), ("few", "a", 3, 9), ("one", "a", 5, 5)], ASKED)
    for r in ranges.distinct_in_requests(rows, requests).collect():
        low, high = {"all": (0, 31), "few": (3, 9), "one": (5, 5)}[r.request_id]
        exact = len({(s * 37 + i) % 5000 for s in range(low, high + 1) for i in range(400)})
        assert abs(r.distinct_sql - exact) <= 0.02 * exact and r.distinct_schemas == 3


def test_relations_as_by_numpy(spark):
    rng = np.random.default_rng(3)
    snaps = 60
    cpu, aas = rng.integers(0, 90, snaps), rng.integers(0, 40, snaps)
    waits = aas * 2 + rng.integers(0, 5, snaps)
    metrics = spark.createDataFrame([("d", int(s), 1, float(c)) for s, c in enumerate(cpu)] + [("d", 0, 2, 0.0), ("d", None, 1, 5.0)], "db_id string, snap bigint, inst int, os_cpu double")
    sessions = spark.createDataFrame([("d", s, "User I/O", float(v)) for s, v in enumerate(aas)] + [("d", s, "Idle", 1.0) for s in range(snaps)], "db_id string, SNAP_ID bigint, WAIT_CLASS string, AVG_SESS double")
    events = spark.createDataFrame([("d", s, "read", float(v)) for s, v in enumerate(waits) if s % 2] + [("d", 1, None, 4.0)], "db_id string, SNAP_ID bigint, EVENT_NAME string, TOTAL_TIME_S double")
    got = {(r.series_a, r.series_b): (r.n_snaps, r.correlation) for r in health.series_relations(health.metric_series(metrics, sessions, events)).collect()}
    assert len(got) == 6 and got["aas Idle", "cpu"] == (snaps, None)
    odd = slice(1, None, 2)
    for pair, x, y in ((("aas User I/O", "cpu"), aas, cpu), (("aas User I/O", "wait read"), aas[odd], waits[odd]), (("cpu", "wait read"), cpu[odd], waits[odd])):
        assert got[pair][0] == len(x) and abs(got[pair][1] - np.corrcoef(x, y)[0, 1]) < 1e-9


def test_sums_are_copied_to_asked_blocks_only(spark):
    """Levels are unfolded on snapshots, not on the sums of every SQL (reviews F6, F8)."""
    sql = spark.range(1).selectExpr(
        "'d' AS db_id", "5L AS SNAP_ID", "'q' AS SQL_ID", "'s' AS PARSING_SCHEMA_NAME", "'m' AS MODULE", "'c' AS COMMAND_NAME", "'p' AS PLAN_HASH",
        "0 AS PLAN_CHANGE", "1 AS PLANS", *[f"1 AS {c}" for c in analytics.TREND_SUMS.values()])
    asked = spark.createDataFrame([("r", "d", 1, 8)], "request_id string, db_id string, start_snap bigint, end_snap bigint")
    found = ranges.sql_trend_in_requests(sql, asked)
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    below = [plan[i + 1] for i, line in enumerate(plan[:-1]) if "Generate explode" in line]
    assert below and not any("total_execs" in line for line in below)
    assert [(r.request_id, r.snaps, r.total_execs) for r in found.collect()] == [("r", 1, 1)]


def test_rows_of_requests_are_totalled_where_the_join_puts_them(spark):
    """One sorted pass after the join: no totals held in maps, no second join or shuffle for names (review F12)."""
    from perfsnap import registry

    plan = registry.sql_trend_requests(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Join")]
    assert plan.count("Join ") == 1 and "Exchange" not in above and "HashAggregate" not in above
    assert plan.count("FileScan") == 2
