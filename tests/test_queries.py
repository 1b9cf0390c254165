"""Every registered query with SQL gives the same rows as DuckDB."""

import pytest

import __spark_entry__ as entry_points
import compare
from perfsnap import registry

SF = "/root/testdata/sf0.001"
ORACLES = entry_points.oracle_sql()
# Queries with user functions or the similarity product; all others stay in the JVM.
PYTHON = {"cosine_topk", "grid_topk", "hash_embed_topk", "user_embed_topk", "question_contexts", "final_reports"}


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    df = entry_points.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name in registry.QUERIES:
        assert ("Python" in plan or "InArrow" in plan or "MapInPandas" in plan) == (name in PYTHON)
    got = compare.spark_rows(df)
    want = compare.duck_rows(con, ORACLES[name])
    assert len(want[1]) > 0
    assert not compare.differences(got, want)


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert entry_points.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_label_occurs(spark):
    rows = entry_points.queries()["bottleneck_distribution"](spark, SF).select("label").distinct().collect()
    assert {r[0] for r in rows} == {
        "CPU-bound", "IO-bound", "PX-intensive", "Plan-change-risk", "Low-impact", "Mixed/Other"
    }
