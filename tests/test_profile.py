import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from colmetry import Metric, ProfileError, StringMetric, guard_dimensions, profile, profile_columns, validate
from colmetry.schema import resolve_columns

BOUNDARY = "event_date date, processed_date date, category string, amount bigint, ratio double, active boolean, " \
    "precise_amount decimal(38,9), large_amount string"
HUGE = "123456789012345678901234567890.12345678901234567890123456789012345678"
TINY = "0." + "0" * 37 + "1"
ROWS = [
    (date(2026, 9, 1), date(2026, 9, 1), "alpha", 1, 1.5, True, Decimal("12345678901234567890.123456789"), HUGE),
    (None, date(2026, 9, 2), "", 2, 2.5, False, Decimal("-12345678901234567890.123456789"), "-" + HUGE),
    (date(2026, 9, 2), None, None, None, None, None, None, None),
    (None, None, "omega", 4, 4.5, True, Decimal("0.000000001"), TINY),
]
DECLARED = [(n, t, "") for n, t in [
    ("event_date", "DATE"), ("processed_date", "DATE"), ("category", "STRING"), ("amount", "INTEGER"), ("ratio", "FLOAT"),
    ("active", "BOOLEAN"), ("precise_amount", "NUMERIC"), ("large_amount", "BIGNUMERIC"),
]]


def by_slice(metrics):
    found = {}
    for r in metrics.collect():
        found.setdefault((r.dimension_name, r.dimension_value), {})[r.column_name] = r
    return found


def test_boundary_table(spark):
    table = spark.createDataFrame(ROWS, BOUNDARY)
    result = by_slice(profile(table, ["event_date", "processed_date"], columns=DECLARED).metrics)
    overall = result[None, None]
    assert {c.record_count for c in overall.values()} == {4}
    assert overall["precise_amount"].min_value == "-12345678901234567890.123456789"
    assert overall["precise_amount"].max_value == "12345678901234567890.123456789"
    assert overall["large_amount"].min_value == "-" + HUGE and overall["large_amount"].max_value == HUGE
    assert (overall["category"].null_count, overall["category"].empty_string_count, overall["category"].distinct_count) == (1, 1, 3)
    assert overall["active"].true_count == 2 and overall["amount"].max_value == "4" and overall["ratio"].min_value == "1.5"
    for name in ("event_date", "processed_date"):
        buckets = {value: cols["amount"].record_count for (dim, value), cols in result.items() if dim == name}
        assert buckets == {None: 2, "2026-09-01": 1, "2026-09-02": 1}
    assert result["event_date", None]["large_amount"].max_value == TINY
    assert [c.column_order for c in overall.values()] != [] and sorted(c.column_order for c in overall.values()) == list(range(8))


def test_empty_table_has_one_overall_slice(spark):
    table = spark.createDataFrame([], BOUNDARY)
    result = by_slice(profile(table, ["event_date", "category"], columns=DECLARED).metrics)
    assert set(result) == {(None, None)}
    rows = result[None, None].values()
    assert len(rows) == 8
    assert all(r.record_count == 0 and r.null_rate == 0 and r.missing_rate == 0 and r.min_value is None for r in rows)
    assert result[None, None]["category"].distinct_count == 0 and result[None, None]["category"].distinct_ratio == 0


def test_null_bucket_differs_from_overall_and_empty_string(spark):
    table = spark.createDataFrame([(None, 1), ("", 2), (" ", 3), ("a", 4), ("a", 5)], "k string, n int")
    result = by_slice(profile(table, ["k"], treat_empty_string_as_null=True).metrics)
    assert {key: cols["n"].record_count for key, cols in result.items()} == {
        (None, None): 5, ("k", None): 1, ("k", ""): 1, ("k", " "): 1, ("k", "a"): 2,
    }
    k = result[None, None]["k"]
    assert (k.null_count, k.empty_string_count, k.missing_count, k.distinct_count) == (1, 1, 2, 2)
    assert result["k", ""]["k"].distinct_count == 0 and result["k", ""]["k"].missing_rate == 1.0


def test_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(
        rng.choice([None, "", "x", "y", "long " * 40 + str(rng.randint(0, 5))]), rng.choice([None, 1, 2, 3]),
        rng.choice([None, 0.5, -1.25, 1e20]), rng.choice([None, True, False]),
        rng.choice([None, date(2024, 1, 1), date(2024, 2, 1)]), rng.choice([None, "", "p", "q"]),
    ) for _ in range(700)]
    names = ["s", "i", "f", "b", "d", "t"]
    table = spark.createDataFrame(rows, "s string, i int, f double, b boolean, d date, t string").repartition(5)
    for flag in (False, True):
        result = by_slice(profile(table, ["d", "t"], treat_empty_string_as_null=flag).metrics)
        groups = {(None, None): rows}
        for row in rows:
            groups.setdefault(("d", row[4] and str(row[4])), []).append(row)
            groups.setdefault(("t", row[5]), []).append(row)
        assert set(result) == set(groups)
        for key, members in groups.items():
            for place, name in enumerate(names):
                values = [m[place] for m in members]
                present = [v for v in values if v is not None]
                got = result[key][name]
                assert (got.record_count, got.null_count) == (len(members), len(values) - len(present))
                if name in "st":
                    empty = present.count("")
                    folded = [v for v in present if v != ""] if flag else present
                    assert (got.empty_string_count, got.distinct_count) == (empty, len(set(folded)))
                    assert got.missing_count == got.null_count + (empty if flag else 0)
                    assert got.distinct_ratio == got.distinct_count / len(members)
                elif name == "b":
                    assert got.true_count == present.count(True)
                else:
                    assert got.min_value == (str(min(present)) if present else None)
                    assert got.max_value == (str(max(present)) if present else None)


def test_columns_split_over_passes_give_the_same_result(spark):
    table = spark.range(50).selectExpr("id % 3 AS k", *[f"id * {i} AS c{i}" for i in range(7)], "cast(id % 4 AS string) AS s")
    key = ["dimension_order", "dimension_value", "column_order"]
    one = profile_columns(table, ["s"]).orderBy(*key).collect()
    assert profile_columns(table, ["s"], columns_per_pass=2).orderBy(*key).collect() == one


def test_long_strings_are_counted_exactly_with_and_without_digest(spark):
    table = spark.range(300).selectExpr("concat(repeat('w', 200), id % 37) AS t", "cast(id % 2 AS string) AS k")
    digest, plain = (
        {(r.dimension_value, r.column_name): r.distinct_count for r in profile(table, ["k"], digest_strings=on).metrics.collect()}
        for on in (True, False)
    )
    assert digest == plain and digest[None, "t"] == 37


def test_one_value_holding_most_rows(spark):
    table = spark.range(20000).selectExpr(
        "CASE WHEN id % 10 < 8 THEN 'hot' ELSE concat('k', id % 50) END AS k", "concat('u', id) AS u", "id AS n"
    ).repartition(6)
    result = by_slice(profile(table, ["k"]).metrics)
    assert result["k", "hot"]["u"].distinct_count == 16000 and result[None, None]["u"].distinct_count == 20000
    assert sum(c["n"].record_count for (dim, _), c in result.items() if dim) == 20000


def test_column_names_with_dots_quotes_and_backticks(spark):
    table = spark.createDataFrame([("a", 1, True), ("a", 2, None)], ["it's `odd`.name", "x.y", "déjà vu"])
    result = by_slice(profile(table, ["it's `odd`.name"]).metrics)
    assert result["it's `odd`.name", "a"]["x.y"].max_value == "2" and result[None, None]["déjà vu"].true_count == 1


def test_unsupported_columns_are_reported(spark):
    table = spark.sql("SELECT 1 AS a, array(1) AS b, map('k', 1) AS c, named_struct('x', 1) AS d, binary('q') AS e")
    result = profile(table)
    assert result.skipped_columns == ("b", "c", "d", "e") and result.metrics.count() == 1
    with pytest.raises(ProfileError, match="no supported columns"):
        profile(table.select("b"))


def test_parameterised_declared_types_are_skipped(spark):
    profiled, skipped = resolve_columns(
        spark.sql("SELECT 1 AS a, 2BD AS b"), [("a", "integer", "key"), ("b", "NUMERIC(10,2)", ""), ("gone", "JSON", "")])
    assert [(c.name, c.data_type, c.description) for c in profiled] == [("a", "INT64", "key")] and skipped == ["b", "gone"]


@pytest.mark.parametrize("dimension, message", [("amount", "must be DATE"), ("nope", "not found")])
def test_dimension_must_be_temporal_or_string(spark, dimension, message):
    with pytest.raises(ProfileError, match=message):
        profile(spark.createDataFrame(ROWS, BOUNDARY), [dimension])


@pytest.mark.parametrize("where", ["", "  \n ", 7])
def test_blank_conditions_are_refused(spark, where):
    with pytest.raises(ProfileError, match="where"):
        profile(spark.range(1).toDF("a"), where=where)


def test_condition_cannot_escape_its_place(spark):
    with pytest.raises(Exception):
        profile(spark.range(1).toDF("a"), where="a > 0) OR (1 = 1").metrics.collect()


def test_guard_counts_like_overall(spark):
    table = spark.createDataFrame([("a",), ("b",), ("",), (None,)], "k string")
    assert guard_dimensions(table, ["k"], max_dimension_values=2)[1][0].distinct_values == 3
    kept, skipped = guard_dimensions(table, ["k"], max_dimension_values=2, treat_empty_string_as_null=True)
    assert kept == ["k"] and not skipped
    assert guard_dimensions(table, ["k"], max_dimension_values=2, where="k <> 'b'")[0] == ["k"]
    result = profile(table, ["k"], max_dimension_values=1)
    assert result.dimensions == () and "distinct values; maximum allowed is 1" in result.skipped_dimensions[0].reason
    with pytest.raises(ProfileError):
        guard_dimensions(table, ["k"], max_dimension_values=0)


def test_timestamps_keep_microseconds_and_offset(spark):
    table = spark.sql("SELECT timestamp_micros(1757388896123456) AS t, TIMESTAMP_NTZ'2026-09-09 12:34:56.123456' AS d")
    result = by_slice(profile(table, ["t"]).metrics)
    assert result[None, None]["t"].min_value == "2025-09-09 03:34:56.123456+00"
    assert ("t", "2025-09-09 03:34:56.123456+00") in result
    assert result[None, None]["d"].max_value == "2026-09-09 12:34:56.123456"


def test_added_metrics_roll_up(spark):
    table = spark.createDataFrame([("a", 1.0), ("a", -2.0), ("b", -3.0)], "k string, v double")
    total = Metric("sum_value", ("FLOAT64",), F.sum, F.sum, output="double")
    rows = {(r.dimension_value, r.column_name): r.sum_value for r in profile(table, ["k"], added_metrics=[total]).metrics.collect()}
    assert rows == {(None, "v"): -4.0, ("a", "v"): -1.0, ("b", "v"): -3.0, (None, "k"): None, ("a", "k"): None, ("b", "k"): None}
    with pytest.raises(ValueError):
        Metric("x", ("STRING",), F.count, F.sum)
    with pytest.raises(ValueError):
        Metric("x", ("JSON",), F.count, F.sum)


def test_string_metrics_measure_each_distinct_string_once(spark):
    rows = [("a", "x1", 1), ("a", "x1", 2), ("a", "", 3), ("b", "long", 4), ("b", None, 5), (None, "x1", 6), (None, "é" * 5000, 7)]
    table = spark.createDataFrame(rows, "k string, s string, v int").withColumn("w", F.col("v").cast("string"))
    longest = StringMetric("longest", lambda text, _: F.length(text), F.max)
    total = StringMetric("total", lambda text, n: F.length(text) * n, F.sum)
    negative = Metric("negative", ("INT64",), lambda c: F.count_if(c < 0), F.sum)
    for guarded in (profile, lambda *a, **k: None):
        made = guarded(table, ["k", "w", "k"], added_metrics=[longest, negative, total])
        metrics = made.metrics if made else profile_columns(table, ["k", "w", "k"], added_metrics=[longest, negative, total])
        found = {(r.dimension_order, r.dimension_value): r for r in metrics.where("column_name = 's'").collect()}
        got = {key: (r.longest, r.total, r.negative) for key, r in found.items() if r.dimension_order != 2}
        own = {"a": (2, 4, None), "b": (4, 4, None), None: (5000, 5002, None)}
        assert got == {(0, None): (5000, 5010, None)} | {(place, k): row for place in (1, 3) for k, row in own.items()}
        assert found[2, "5"].longest is None and found[2, "3"].longest == 0
        assert metrics.where("column_name = 'v'").selectExpr("max(longest)", "max(negative)").first() == (None, 0)
    missing = profile(table, added_metrics=[longest, total], where="v = 3", treat_empty_string_as_null=True).metrics
    assert missing.where("column_name = 's'").select("longest", "total").first() == (None, None)
    none = profile(table.limit(0), ["k"], added_metrics=[longest]).metrics
    assert {r.longest for r in none.collect()} == {None} and none.count() == 4
    with pytest.raises(ProfileError, match="no strings"):
        profile(table, added_metrics=[longest], digest_strings=True)
    with pytest.raises(ProfileError, match="'s'"):
        profile(table.withColumn("s", F.collate("s", "UTF8_LCASE")), added_metrics=[longest])


def test_sound_results_have_no_violations(spark):
    table = spark.createDataFrame(ROWS, BOUNDARY)
    result = profile(table, ["event_date", "category"], columns=DECLARED)
    relation = spark.createDataFrame(
        [("m", [{"name": n, "data_type": t} for n, t in result.columns], list(result.dimensions), False)],
        "unique_id string, columns array<struct<name:string,data_type:string>>, dimensions array<string>, treat_empty_string_as_null boolean")
    metrics = result.metrics.withColumn("unique_id", F.lit("m"))
    assert validate(metrics, relation).count() == 0
    no_bucket = metrics.where("NOT (dimension_name <=> 'event_date' AND dimension_value IS NULL)")
    assert [r.check for r in validate(no_bucket, relation).collect()] == ["reconciliation"]
    wrong = metrics.withColumn("null_rate", F.expr("if(column_name = 'amount' AND dimension_name IS NULL, 1.5, null_rate)"))
    assert {r.check for r in validate(wrong, relation).collect()} == {"rates", "ranges"}
    twice = metrics.unionByName(metrics.where("column_name = 'ratio' AND dimension_name IS NULL"))
    assert {r.check for r in validate(twice, relation).collect()} == {"columns"}


def test_checks_of_relations_without_results_and_results_without_relation(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n bigint")
    metrics = profile(table, ["k"]).metrics
    both = metrics.withColumn("unique_id", F.lit("known")).unionByName(metrics.withColumn("unique_id", F.lit("stranger")))
    columns = [("k", "STRING"), ("n", "INT64")]
    relations = spark.createDataFrame(
        [("known", columns, ["k"], False), ("absent", columns, ["k"], False)],
        "unique_id string, columns array<struct<name:string,data_type:string>>, dimensions array<string>, treat_empty_string_as_null boolean")
    found = sorted((r.unique_id, r.check, r.dimension_name or "") for r in validate(both, relations).collect())
    assert found == [("absent", "overall", ""), ("stranger", "unexpected_dimension", ""), ("stranger", "unexpected_dimension", "k")]
    # Each wrong row is a violation of its own, copies too.
    wrong = both.where("unique_id = 'known'").withColumn("missing_rate", F.expr("if(column_name = 'n' AND dimension_value = 'a', 0.5, missing_rate)"))
    copies = wrong.unionByName(wrong.where("dimension_value = 'a'"))
    found = sorted((r.unique_id, r.check, r.dimension_value or "", r.column_name or "") for r in validate(copies, relations).collect())
    assert found == [("absent", "overall", "", ""), ("known", "columns", "a", ""), ("known", "rates", "a", "n"), ("known", "rates", "a", "n")]


def test_dimensions_are_found_in_any_case(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "Status string, n bigint")
    found = profile(table, ["STATUS"], columns=[("status", "STRING", ""), ("n", "INT64", "")])
    assert found.dimensions == ("status",) and {r.dimension_name for r in found.metrics.collect()} == {None, "status"}
    assert guard_dimensions(table, ["sTATUS"], max_dimension_values=1)[1][0].dimension == "Status"
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        with pytest.raises(ProfileError):
            profile(table, ["STATUS"])
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_strings_keep_the_equality_of_their_column(spark):
    table = spark.createDataFrame([("a", "x", "É", 1), ("A", "X", "é", 2), ("b", "x", None, 3), (None, "", "e", 4)], "k string, p string, u string, n int")
    mixed = table.selectExpr("k COLLATE UTF8_LCASE AS k", "p", "u COLLATE UNICODE_CI AS u", "n")
    found = by_slice(profile(mixed, ["k", "p"]).metrics)
    assert {c: found[None, None][c].distinct_count for c in "kpu"} == {"k": 2, "p": 3, "u": 2}
    # A slice is named by its least value, the same for strings and numbers.
    assert found["k", "A"]["p"].distinct_count == 2 and found["k", "A"]["u"].distinct_count == 1 and found["k", "A"]["n"].max_value == "2"
    assert set(found) == {(None, None), ("k", "A"), ("k", "b"), ("k", None), ("p", "x"), ("p", "X"), ("p", "")}
    assert found["p", "x"]["k"].distinct_count == 2
    # With two dimensions under a collation, and none.
    assert by_slice(profile(mixed, ["u", "k"]).metrics)["u", "É"]["k"].distinct_count == 1
    assert by_slice(profile(mixed).metrics)[None, None]["u"].distinct_count == 2


def test_datetime_dimension(spark):
    table = spark.createDataFrame([(datetime(2024, 1, 1, 5),), (datetime(2024, 1, 1, 5),), (None,)], "t timestamp_ntz")
    assert {k: c["t"].record_count for k, c in by_slice(profile(table, ["t"]).metrics).items()} == {
        (None, None): 3, ("t", None): 1, ("t", "2024-01-01 05:00:00"): 2}
