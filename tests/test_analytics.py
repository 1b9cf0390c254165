import random

import pytest
from pyspark.sql import functions as F

from perfsnap.operators import analytics, ranking

COLUMNS = (
    "db_id string, SNAP_ID bigint, SQL_ID string, PARSING_SCHEMA_NAME string, MODULE string, COMMAND_NAME string, PLAN_HASH string,"
    "PLAN_CHANGE double, PLANS double, ELAP_RANK int, EXECS double, BUFFER_GETS double, READ_MB double, IO_WAIT double,"
    "PHY_READ_GB double, DIRECT_W_GB double, CPU_T_S double, ELAP_S double, line_pos int"
)


def row(db="a", snap=1, sql="s", schema="x", module="m", plan="p", change=0.0, plans=1.0, rank=1, elapsed=1.0, line=0):
    return (db, snap, sql, schema, module, "SELECT", plan, change, plans, rank, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.5, elapsed, line)


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_same_snapshot_number_in_two_databases(spark):
    df = frame(spark, [row("a", elapsed=1.0), row("b", elapsed=5.0)])
    got = {r.db_id: r.total_elapsed_s for r in analytics.sql_trend_over_range(df).collect()}
    assert got == {"a": 1.0, "b": 5.0}


def test_range_is_closed_and_first_names_skip_nulls(spark):
    df = frame(spark, [
        row(snap=1, schema="z", module="out", line=1), row(snap=2, schema="y", module=None, line=2),
        row(snap=3, schema="b", module="late", line=3), row(snap=3, schema="a", module="early", line=4),
        row(snap=4, module="out", line=5), row(snap=3, sql=None, line=6),
    ])
    ordered = analytics.sql_trend_over_range(df, 2, 3, order=["line_pos"]).collect()
    assert [(r.SQL_ID, r.schema, r.module, r.snaps, r.total_elapsed_s) for r in ordered] == [("s", "y", "late", 2, 3.0)]
    smallest = analytics.sql_trend_over_range(df, 2, 3).first()
    assert (smallest.schema, smallest.module) == ("a", "early")
    assert analytics.sql_trend_over_range(df, 9, 9).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trend_deals_rows_once(spark, tmp_path):
    """Figures and names come from one shuffle of one reading (review F10)."""
    frame(spark, [row(snap=i % 5, sql=f"q{i % 3}") for i in range(60)]).write.parquet(f"{tmp_path}/t")
    plan = plan_of(analytics.sql_trend_over_range(spark.read.parquet(f"{tmp_path}/t")))
    assert plan.count("Exchange ") == 1 and plan.count("FileScan") == 1 and "Join" not in plan


def test_trend_is_the_same_dealt_or_not(spark):
    rng = random.Random(4)
    rows = [row(rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3]), rng.choice(["s", "t", None]), rng.choice(["x", "y", None]), rng.choice(["m", "n", None]),
                plans=float(rng.randint(1, 3)), elapsed=float(rng.randint(1, 9)), line=i) for i in range(200)]
    for order in (None, ["line_pos"]):
        got = [sorted(analytics.sql_trend_over_range(frame(spark, rows), order=order, spread=s).collect()) for s in (None, False, True)]
        assert got[0] == got[1] == got[2] and {(r.db_id, r.SQL_ID) for r in got[0]} == {(d, s) for d in "ab" for s in "st"}
        for r in got[0]:
            mine = [x for x in rows if (x[0], x[2]) == (r.db_id, r.SQL_ID)]
            first = (lambda v: v[0]) if order else min
            assert r.schema == first([x[3] for x in mine if x[3]]) and r.module == first([x[4] for x in mine if x[4]])
            assert r.snaps == len({x[1] for x in mine} - {None}) and r.total_elapsed_s == sum(x[17] for x in mine)


def test_large_groups_are_noticed(spark):
    df = frame(spark, [row(sql="q", line=i) for i in range(30)] + [row(db=f"d{i}", sql="q") for i in range(30)])
    large = lambda keys, n: ranking.may_have_large_group(df, keys, n)
    assert large(["db_id"], 29) and not large(["db_id"], 30)
    assert large(["SQL_ID"], 59) and large(["SQL_ID", "db_id"], 29) and not large(["SQL_ID", "db_id"], 30)
    assert not large(["line_pos", "db_id"], 31) and not ranking.may_have_large_group(df.limit(0), ["db_id"], 0)


def test_plan_changes_by_each_sign(spark):
    df = frame(spark, [
        row(sql="flag", change=1.0), row(sql="plans", plans=2.0), row(sql="hash", plan="p"), row(sql="hash", plan="q", module=None),
        row(sql="quiet"), row(sql="quiet", snap=2),
    ])
    got = {r.SQL_ID: r for r in analytics.detect_sql_plan_changes(df).collect()}
    assert set(got) == {"flag", "plans", "hash"}
    assert got["hash"].plan_hashes == ["p", "q"] and got["hash"].modules == ["m"]


def test_summary_ties_and_missing_modules(spark):
    df = frame(spark, [
        row(sql="b", module="y", rank=10, elapsed=9.0), row(sql="a", module="x", rank=2, elapsed=1.0), row(sql="c", module=None, rank=None),
        row(snap=2, module=None),
    ])
    got = {r.SNAP_ID: r for r in analytics.summarize_top_sql(df).collect()}
    assert got[1].top_module == "x" and got[1].top_sql_id == "a" and got[1].unique_sql == 3
    assert got[2].top_module == "N/A"
    unranked = {r.SNAP_ID: r.top_sql_id for r in analytics.summarize_top_sql(df.drop("ELAP_RANK")).collect()}
    assert unranked[1] == "b"


def test_ranks_are_numbers_not_text(spark):
    df = frame(spark, [row(sql=f"s{i}", rank=i) for i in range(1, 13)])
    got = analytics.sql_snapshots_ranked(df).orderBy("sql_rank").collect()
    assert [r.SQL_ID for r in got] == [f"s{i}" for i in range(1, 13)]


def test_a_huge_group_is_numbered_over_many_tasks(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(100), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    order = [F.desc("v"), F.asc("i")]
    plain = ranking.grouped_row_number(df, ["k"], order, "n", spread=False)
    spread = ranking.grouped_row_number(df, ["k"], order, "n", max_group_rows=100)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, spread.collect()))
    assert "_local" not in spread.columns and "_piece" not in spread.columns


def test_only_the_first_rows_of_a_key_are_shuffled(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    top = ranking.first_rows(df, ["k"], [F.desc("id")], 2, "rank")
    assert top._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
    assert sorted((r.k, r.id) for r in top.collect()) == [(0, 996), (0, 999), (1, 994), (1, 997), (2, 995), (2, 998)]


@pytest.mark.parametrize("chunk", [1, 7, 1024])
def test_lag_does_not_notice_chunks(spark, chunk):
    rng = random.Random(chunk)
    rows = [(db, s, s * 1.5) for db in "abc" for s in sorted(rng.sample(range(-50, 400), 60))]
    df = spark.createDataFrame(rows, "db_id string, snap bigint, v double")
    got = {(r.db_id, r.snap): (r.prev_snap, r.prev_v) for r in ranking.lag_within(df, ["db_id"], "snap", ["v"], chunk=chunk).collect()}
    last = {}
    for db, s, v in rows:
        assert got[db, s] == last.get(db, (None, None))
        last[db] = (s, v)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_filter_and_columns_reach_the_scan(spark, folder):
    frame(spark, [row(snap=s) for s in range(20)]).write.parquet(f"{folder}/sql")
    stored = spark.read.parquet(f"{folder}/sql")
    plan = plan_of(analytics.sql_trend_over_range(stored, 5, 9))
    assert "GreaterThanOrEqual(SNAP_ID,5)" in plan and "LessThanOrEqual(SNAP_ID,9)" in plan
    assert "PLAN_HASH" not in plan and "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
