"""Every query against its SQL, and plans of a few."""

import os

import duckdb
import pytest

import __spark_entry__ as e
from parallaxis.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def clean(row):
    return tuple(x + 0.0 if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert rows
    if name in ORACLES:
        result = con.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        want = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
        key = lambda r: tuple((x is None, str(x)) for x in r)
        assert [clean(r) for r in sorted(rows, key=key)] == [clean(r) for r in sorted(want, key=key)]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_scans_read_what_they_need(spark):
    text = plan(QUERIES["stage_metrics"](spark, SF))
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in text
    text = plan(QUERIES["fallback_last_good"](spark, SF))
    assert "ReadSchema: " in text and "props" not in text.split("== Physical Plan ==")[1]


def test_core_operators_stay_in_the_jvm(spark):
    for name in ("disparity_map", "stereo_row_splat", "hole_fill", "render_sbs", "scene_cut", "strict_admission", "temporal_jitter"):
        assert "Python" not in plan(QUERIES[name](spark, SF)) and "Pandas" not in plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in plan(QUERIES[name](spark, SF))


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
