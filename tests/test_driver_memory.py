import pytest

import __spark_entry__ as entry
from strandloom.plans import queries


@pytest.mark.parametrize("name", ["anti_background", "region_runs", "homology_free_regions", "numbered_regions", "annotated_records"])
def test_no_k_mer_set_is_gathered_by_the_driver(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_free_positions_are_counted_without_a_row_for_each(spark):
    folder = "/root/testdata/sf0.001"
    got = entry.queries()["anti_background"](spark, folder)
    single = queries._free(spark, folder).groupBy("rec_id").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, single.collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_region_runs_are_found_without_a_row_for_each_window(spark):
    folder = "/root/testdata/sf0.001"
    got = entry.queries()["region_runs"](spark, folder)
    single = queries.regions.runs(queries._free(spark, folder), queries.K, queries.THRESHOLD)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, single.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
