"""Sorted and summarised views over a small stored result with known answers."""

import pytest
from pyspark.sql import functions as F

from colmetry.operators import views

SCHEMA = (
    "unique_id string, dimension_name string, dimension_value string, record_count bigint, column_order int, column_name string, "
    "column_type string, null_rate double, missing_rate double, distinct_count bigint, true_count bigint, null_count bigint, "
    "missing_count bigint, min_value string, max_value string, profile_order int"
)


def row(order, dimension, value, records, place, name, kind, low=None, high=None, distinct=None, trues=None, missing=0):
    rate = missing / records if records else 0.0
    return ("e", dimension, value, records, place, name, kind, rate, rate, distinct, trues, missing, missing, low, high, order)


@pytest.fixture(scope="module")
def metrics(spark):
    rows = []
    for order, (dimension, value, records, score, amount, flag, kinds) in enumerate([
        (None, None, 12, ("-2.5", "10.0"), ("-10.5", "100"), 6, 3),
        ("day", None, 2, ("7.0", "8.0"), ("-10.5", "-9.05"), 0, 1),
        ("day", "2026-08-31", 4, ("-2.5", "1e+16"), ("2", "10"), 1, 3),
        ("day", "2026-09-01", 6, ("3.0", "4.0"), ("9", "100"), 3, 2),
        ("day", "2026-09-02", 0, (None, None), (None, None), 0, 0),
        ("service", "web", 12, ("-2.5", "10.0"), ("-10.5", "100"), 6, 3),
    ]):
        rows += [
            row(order, dimension, value, records, 0, "score", "FLOAT64", *score, missing=1 if records else 0),
            row(order, dimension, value, records, 1, "amount", "NUMERIC", *amount),
            row(order, dimension, value, records, 2, "ok", "BOOL", trues=flag),
            row(order, dimension, value, records, 3, "kind", "STRING", distinct=kinds),
        ]
    return spark.createDataFrame(rows, SCHEMA)


def order_of(metrics, column, key, descending=True):
    rows = views.of_dimension(metrics, "day").where(F.col("column_name") == column)
    return [r.dimension_value for r in views.breakdown(rows, key, descending).collect()]


def test_breakdown_by_min_keeps_null_last(metrics):
    assert order_of(metrics, "score", "min") == [None, "2026-09-01", "2026-08-31", "2026-09-02"]
    assert order_of(metrics, "score", "min", False) == ["2026-08-31", "2026-09-01", None, "2026-09-02"]
    assert order_of(metrics, "score", "max") == ["2026-08-31", None, "2026-09-01", "2026-09-02"]


def test_breakdown_compares_decimals_by_value(metrics):
    assert order_of(metrics, "amount", "max", False) == [None, "2026-08-31", "2026-09-01", "2026-09-02"]
    assert order_of(metrics, "amount", "min", True) == ["2026-09-01", "2026-08-31", None, "2026-09-02"]


def test_breakdown_by_other_keys(metrics):
    assert order_of(metrics, "score", "dimension") == ["2026-09-02", "2026-09-01", "2026-08-31", None]
    assert order_of(metrics, "score", "dimension", False) == ["2026-08-31", "2026-09-01", "2026-09-02", None]
    assert order_of(metrics, "score", "rows")[0] == "2026-09-01"
    assert order_of(metrics, "score", "missing") == [None, "2026-08-31", "2026-09-01", "2026-09-02"]
    assert order_of(metrics, "ok", "true")[0] == "2026-09-01"
    assert order_of(metrics, "kind", "distinct") == ["2026-08-31", "2026-09-01", None, "2026-09-02"]
    with pytest.raises(ValueError):
        order_of(metrics, "kind", "colour")


def test_unsorted_unless_temporal(metrics):
    rows = views.of_dimension(metrics, "day").where("column_name = 'score'")
    assert [r.dimension_value for r in views.breakdown(rows, temporal=True).collect()] == ["2026-09-02", "2026-09-01", "2026-08-31", None]
    assert views.breakdown(rows) is rows


def test_slice_order(metrics):
    rows = views.in_slice_order(metrics.where("column_order = 0")).collect()
    assert [(r.dimension_name, r.dimension_value) for r in rows] == [
        (None, None), ("day", None), ("day", "2026-08-31"), ("day", "2026-09-01"), ("day", "2026-09-02"), ("service", "web")]
    newest = views.newest_first(views.of_dimension(metrics, "day").where("column_order = 0")).collect()
    assert [r.dimension_value for r in newest] == ["2026-09-02", "2026-09-01", "2026-08-31", None]


def test_range_summary(metrics):
    found = {(r.dimension_name, r.column_name): r for r in views.range_summary(metrics).collect()}
    day = {name: found["day", name] for name in ("score", "amount", "ok", "kind")}
    assert (day["score"].min_value, day["score"].max_value, day["score"].slices) == ("-2.5", "1e+16", 4)
    assert (day["amount"].min_value, day["amount"].max_value) == ("-10.5", "100")
    assert (day["ok"].min_true_rate, day["ok"].max_true_rate, day["ok"].min_value) == (0.0, 0.5, None)
    assert (day["kind"].min_distinct, day["kind"].max_distinct) == (0, 3)


def test_latest_slice_and_temporal_detection(metrics):
    assert {r.dimension_name: r.temporal for r in views.temporal_dimensions(metrics).collect()} == {"day": True, "service": False}
    latest = views.latest_slice(metrics.where("NOT (dimension_value <=> '2026-09-02')")).collect()
    assert [(r.dimension_name, r.dimension_value, r.record_count) for r in latest] == [("day", "2026-09-01", 6)]
    only_null = metrics.where("dimension_name = 'day' AND dimension_value IS NULL")
    assert [r.temporal for r in views.temporal_dimensions(only_null).collect()] == [False]


def test_row_share_has_a_floor_of_one(metrics):
    shares = {(r.dimension_name, r.dimension_value): r.row_share for r in views.row_share(metrics).collect()}
    assert shares["day", "2026-09-01"] == 1.0 and shares["day", "2026-09-02"] == 0.0 and shares["service", "web"] == 1.0
    empty = metrics.where("dimension_value = '2026-09-02'")
    assert [(r.max_records, r.row_share) for r in views.row_share(empty).collect()] == [(1, 0.0)]


def test_false_counts_are_never_negative(metrics):
    broken = metrics.where("column_name = 'ok'").withColumn("true_count", F.lit(50))
    assert {r.false_count for r in views.boolean_counts(broken).collect()} == {0}


def test_dimension_names_in_first_seen_order(metrics):
    assert [r.dimension_name for r in views.dimension_names(metrics).collect()] == ["day", "service"]
    assert {r.dimension_name: r["values"] for r in views.values_per_dimension(metrics).collect()} == {"day": 4, "service": 1}


def test_families(metrics):
    assert {r.column_name for r in views.of_family(metrics, "numeric").collect()} == {"score", "amount"}
    assert views.of_family(metrics, "all").count() == metrics.count() and views.of_family(metrics, "date").count() == 0
    with pytest.raises(ValueError):
        views.of_family(metrics, "geo")
