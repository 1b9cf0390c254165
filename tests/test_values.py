import datetime as dt

from pyspark.sql import functions as F

from perfsnap.functions import labels, text, values
from perfsnap.operators import analytics, cleaning, health


def test_numbers(spark):
    given = ["1,234", "12%", "1d", "1f", "0x10", "nan", "inf", "-inf", "", "########", " 7 ", "1e3", ".5", "+2.", " 3\t", None, "1 2"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    got = [r.v for r in cleaning.sanitize_numeric(df, ["V", "absent"]).orderBy("i").collect()]
    inf = float("inf")
    assert got == [0, 0, 0, 0, 0, 0, inf, -inf, 0, 0, 7, 1000, 0.5, 2, 3, 0, 0]


def test_whole_numbers(spark):
    df = spark.createDataFrame([("3381",), ("3381.0",), ("3381.5",), ("x",)], "v string")
    assert [r[0] for r in df.select(values.to_whole("v")).collect()] == [3381, 3381, None, None]


def test_snapshot_times(spark):
    given = ["20/09/02 02:59", "20/9/2 2:59", "69/01/01 00:00", "99/12/31 23:59", "68/01/01 00:00", "20/13/02 02:59", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string").orderBy("i")
    got = [r[0] for r in df.select(values.to_snapshot_time("v").cast("string")).collect()]
    assert got == [
        "2020-09-02 02:59:00", "2020-09-02 02:59:00", "1969-01-01 00:00:00", "1999-12-31 23:59:00", "2068-01-01 00:00:00",
        None, None,
    ]
    free = spark.createDataFrame([("2020-09-02 02:59:01",), ("9/2/2020 2:59",), ("never",)], "v string")
    got = [r[0] for r in free.select(values.to_any_time("v").cast("string")).collect()]
    assert got == ["2020-09-02 02:59:01", "2020-09-02 02:59:00", None]


def test_metrics_with_a_bad_end_keep_their_row(spark):
    df = spark.createDataFrame([("1", "20/09/01 22:00", "59", "1"), ("2", "bad", "60", "1")], "SNAP_ID string, END string, DUR_M string, INSTANCE_NUMBER string")
    got = cleaning.type_metrics(df).orderBy("snap").collect()
    assert got[0].start == dt.datetime(2020, 9, 1, 21, 1) and got[1].end is None and got[1].start is None


def test_text(spark):
    df = spark.createDataFrame([("a b/c:d_e-f", 12.0)], "s string, n double")
    row = df.select(
        text.safe_name("s"), text.number_text("n"), text.shown(F.lit(None)), text.cut("s", 3, "..."), text.cut("s", 11, "..."),
        text.number_text(F.lit(0.0)), text.number_text(F.lit(100.125)), text.number_text(F.lit(1e12)),
    ).first()
    assert tuple(row) == ("a-b-c-d_e-f", "12", "N/A", "a b...", "a b/c:d_e-f", "0", "100.125", "1000000000000")


def trend_row(**given):
    names = ["total_cpu_s", "total_elapsed_s", "total_io_wait_s", "total_read_mb", "total_physical_read_gb",
             "total_direct_w_gb", "max_plan_changes", "plans_seen", "total_execs"]
    return tuple(float(given.get(n.replace("total_", ""), 0)) for n in names), names


def test_labels_are_strict_at_their_limits(spark):
    cases = [
        (dict(cpu_s=11, elapsed_s=15), ["CPU-bound"]),
        (dict(cpu_s=14, elapsed_s=20), ["Mixed/Other"]),                      # ratio exactly 0.7
        (dict(cpu_s=10, elapsed_s=10), ["Mixed/Other"]),                      # CPU and elapsed at their limits
        (dict(io_wait_s=10, read_mb=1000, elapsed_s=10), ["Mixed/Other"]),
        (dict(io_wait_s=11, read_mb=100, physical_read_gb=1, elapsed_s=50), ["Mixed/Other"]),
        (dict(io_wait_s=11, read_mb=100, physical_read_gb=1.1, elapsed_s=50), ["IO-bound"]),
        (dict(direct_w_gb=5, elapsed_s=50), ["Mixed/Other"]),
        (dict(direct_w_gb=5.1, elapsed_s=50), ["PX-intensive"]),
        (dict(max_plan_changes=1, elapsed_s=50), ["Plan-change-risk"]),
        (dict(plans_seen=2, elapsed_s=50), ["Plan-change-risk"]),
        (dict(elapsed_s=9.9, cpu_s=4.9, execs=9), ["Low-impact"]),
        (dict(elapsed_s=9.9, cpu_s=4.9, execs=10), ["Mixed/Other"]),
        (dict(cpu_s=20, elapsed_s=21, io_wait_s=11, read_mb=101, direct_w_gb=6, plans_seen=2),
         ["CPU-bound", "IO-bound", "PX-intensive", "Plan-change-risk"]),
    ]
    rows = [(i, *trend_row(**given)[0]) for i, (given, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} double" for n in trend_row()[1]))
    got = [r.bottleneck_class for r in analytics.classify_bottlenecks(df).orderBy("i").collect()]
    assert got == [want for _, want in cases]
    # A table with few of the columns counts the others as zero.
    few = df.select("i", "total_direct_w_gb").filter("i = 7")
    assert analytics.classify_bottlenecks(few).first().bottleneck_class == ["PX-intensive", "Low-impact"]


def test_health_limits(spark):
    df = spark.createDataFrame([(80.0, 90.0), (80.1, 89.9), (90.0, 95.0), (90.1, None), (None, 1.0)], "os_cpu double, cache_hit double")
    got = [(r.cpu_status, r.cache_status) for r in health.health_status(df).collect()]
    assert got == [("healthy", "healthy"), ("warning", "memory issue"), ("warning", "healthy"), ("critical", None), (None, "memory issue")]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 5.0), ("a", 2.0, 4.0, 5.0), ("b", 1.0, 1.0, 1.0)], "db_id string, x double, y double, z double")
    got = {r.db_id: (r.corr_x_y, r.corr_x_z) for r in health.metric_correlation(df, [("x", "y"), ("x", "z")]).collect()}
    assert abs(got["a"][0] - 1) < 1e-12 and got["a"][1] is None and got["b"] == (None, None)
