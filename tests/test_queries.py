"""Every registered query against its DuckDB SQL, on the smallest tables."""

import pytest

from laminar.plans.registry import ORACLE_SQL, QUERIES

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert compare(df, con, ORACLE_SQL[name]) is None
    else:
        assert df.count() > 0


def test_same_result_under_other_partitions(spark, con):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "33"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            for name in ("msk_components", "trc_thickness_by_scan", "map_subfield_stats"):
                assert compare(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["msk_neighbour_count", "map_nearest_fill", "ves_distance_map", "roi_area_and_index", "trc_perpendicular_foot"])
def test_no_cartesian_plan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
