"""What the physical plans must look like for the passes to hold at scale."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from colmetry import profile, profile_columns, validate
from colmetry.operators.views import missing_matrix
from colmetry.sources.files import staged

LINEITEM = "/root/testdata/sf0.001/lineitem.parquet"


def plan_of(frame, mode="formatted"):
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain(mode)
    return out.getvalue()


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(LINEITEM)


def test_condition_and_columns_reach_the_scan(lineitem):
    plan = plan_of(profile_columns(lineitem.select("l_quantity", "l_returnflag", "l_tax"), where="l_quantity > 40"))
    assert "GreaterThan(l_quantity,40.0)" in plan
    schemas = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert schemas == [
        "ReadSchema: struct<l_quantity:double,l_tax:double>",
        "ReadSchema: struct<l_quantity:double,l_returnflag:string>",
    ]


def test_every_column_is_scanned_once_however_many_dimensions(lineitem):
    frame = profile_columns(lineitem, ["l_shipdate", "l_returnflag", "l_linestatus"])
    frame.collect()
    final = plan_of(frame, "simple").split("Initial Plan")[0]
    scans = [line for line in final.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and sum("l_quantity" in scan for scan in scans) == 1
    # Overall is rolled up from the slices of the first dimension, read from the same exchange.
    assert "ReusedExchange" in final


def test_aggregates_are_hash_based_and_free_of_pairs(lineitem):
    plan = plan_of(profile_columns(lineitem, ["l_returnflag", "l_linestatus"]))
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    for costly in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastExchange", "Window", "Python", "Join"):
        assert costly not in plan


def string_exchanges(plan):
    """Exchanges that strings of the rows go through."""
    return [line for line in plan.splitlines() if line.startswith("Arguments: hashpartitioning(_cell") and "_text" in line]


def test_strings_are_combined_before_the_shuffle_and_spread_by_value(lineitem):
    plan = plan_of(profile_columns(lineitem.select("l_returnflag", "l_linestatus"), ["l_linestatus"]))
    # By dimension, and what is left of them for Overall.
    assert len(string_exchanges(plan)) == 2 and "partial_count(1)" in plan
    assert plan.count("ReadSchema") == 1


def test_rows_become_strings_of_their_dimensions_only(lineitem):
    strings = lineitem.select("l_returnflag", "l_linestatus", "l_shipdate")
    lines = plan_of(profile_columns(strings, ["l_shipdate", "l_linestatus"]).where("column_type = 'STRING'"), "simple").splitlines()
    (over_rows,) = [line for line in lines if "Generate inline" in line and "_c0" in line]
    # Cells of two columns by two dimensions; those of Overall would be 0 and 1.
    assert sorted(set(re.findall(r"_cell, (\d+)", over_rows))) == ["2", "3", "4", "5"]


def test_the_guard_counts_strings_that_overall_reads_again(lineitem):
    found = profile(lineitem.select("l_returnflag", "l_linestatus"), ["l_linestatus"])
    plan = plan_of(found.metrics)
    staged = [line for line in plan.splitlines() if line.startswith("ReadSchema") and "_rows" in line]
    assert len(staged) == 1 and len(string_exchanges(plan)) == 2
    # Only the column that is no dimension is rolled up from the rows' groups.
    assert found.metrics.where("column_name = 'l_linestatus' and dimension_name is null").first().distinct_count == 2


def test_collated_strings_group_by_slots_in_one_exchange(spark, lineitem):
    mixed = lineitem.selectExpr("l_returnflag", "l_linestatus COLLATE UTF8_LCASE AS l_linestatus")
    assert len(string_exchanges(plan_of(profile_columns(mixed, ["l_returnflag"])))) == 2


def test_checks_read_metrics_and_relations_once_each_way(spark, lineitem):
    metrics = staged(profile_columns(lineitem, ["l_returnflag"]).withColumn("unique_id", F.lit("r")))
    relation = spark.createDataFrame(
        [("r", [("l_tax", "FLOAT64")], ["l_returnflag"], True)],
        "unique_id string, columns array<struct<name:string,data_type:string>>, dimensions array<string>, treat_empty_string_as_null boolean")
    plan = plan_of(validate(metrics, relation))
    assert plan.count("ReadSchema") == 1
    for costly in ("NestedLoop", "Cartesian", "Window"):
        assert costly not in plan


def test_matrix_reads_the_metrics_through_one_exchange(lineitem):
    metrics = staged(profile_columns(lineitem, ["l_returnflag"]).withColumn("unique_id", F.lit("r")).withColumn(
        "treat_empty_string_as_null", F.lit(False)))
    frame = missing_matrix(metrics)
    assert frame.count() == 3 * len({c.column_name for c in metrics.collect()})
    frame.collect()
    final = plan_of(frame, "simple").split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
