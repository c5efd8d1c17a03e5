"""Every registered query against DuckDB on the smallest data."""

import pytest

from fixture.oracle import oracle_sql
from fixture.registry import queries
from tests.compare import connect, difference
from tests.conftest import SMALL

QUERIES, SQL = queries(), oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees(spark, con, name):
    assert difference(spark, con, SMALL, QUERIES[name], SQL[name]) is None


# Results that list every taxon of the grid, or of a short list, in every group.
PAIRED = {
    "abundance_overall", "abundance_region", "abundance_status", "complete_counts", "grid_rows", "top_species_overall",
    "top_species_region", "top_species_overall_status", "top_species", "top_species_check", "top_species_view",
    "top_species_view_status",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_product_and_no_python(spark, name):
    execution = QUERIES[name](spark, SMALL)._jdf.queryExecution()
    plan = execution.toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert word not in plan
    # Groups are paired with taxa only where the result lists them.
    assert ("Generate explode(scalar-subquery" in execution.analyzed().toString()) == (name in PAIRED)


def test_top_k_is_pushed_into_the_window(spark):
    from fixture.bindings import Survey
    from shoalkit.operators import abundance

    plan = abundance.top_by_region(Survey(spark, SMALL).cube)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_scan_reads_only_needed_columns(spark):
    plan = QUERIES["metric_total_abundance"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", [
    "depth_hist", "length_hist", "length_density", "metric_timeseries", "metric_mean_se", "metric_map", "region_kpis",
    "metrics_long", "region_stats",
])
def test_building_a_query_runs_no_job(spark, name):
    spark.sparkContext.setJobGroup(f"build-{name}", name)
    QUERIES[name](spark, SMALL)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"build-{name}")) == 0


@pytest.mark.parametrize("name", ["bubble_map", "species_map"])
def test_points_of_a_bubble_map_are_computed_once(spark, name, monkeypatch):
    from shoalkit import scaling

    written = []
    monkeypatch.setattr(scaling, "cut_lineage", lambda df: written.append(df) or spark.createDataFrame(df.collect(), df.schema))
    result = QUERIES[name](spark, SMALL)
    # One table is written; what is left reads it and has neither a join nor a second plan.
    assert len(written) == 1
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") == 1 and "CollectMetrics" in plan
    rest = result._jdf.queryExecution().toString()
    assert "Join" not in rest and "scalar-subquery" not in rest and "Subquery" not in rest


def test_served_map_is_one_pruned_scan_without_join(spark):
    plan = QUERIES["served_metric_map"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "metric#" in plan.split("PartitionFilters")[1]
    assert "EqualTo(bioregion,West)" in plan
