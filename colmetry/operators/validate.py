"""Checks over metric rows. Any violation means the result must not be saved.

The checks are plain predicates and counts over the (already aggregated) metric rows, made in one chain
of aggregates; the answer is a DataFrame of violations, empty for a sound result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colmetry.operators.aggregate import rate
from colmetry.schema import SUPPORTED_TYPES

SLICE = ("unique_id", "dimension_name", "dimension_value")
VIOLATION_COLUMNS = ("check", *SLICE, "column_name")


def differs(actual: Column, expected: Column) -> Column:
    """Not within 1e-6 relative or 1e-9 absolute of each other; a NULL never matches."""
    scale = F.greatest(F.abs(actual), F.abs(expected))
    near = F.abs(actual - expected) <= F.greatest(scale * 1e-6, F.lit(1e-9))
    return ~F.coalesce(near, F.lit(False))


def _row_checks(flag: Column) -> dict[str, Column]:
    """Conditions under which a metric row is wrong: count identities, rates and ranges."""
    records, nulls, empties = F.col("record_count"), F.col("null_count"), F.col("empty_string_count")
    missing, distinct, trues = F.col("missing_count"), F.col("distinct_count"), F.col("true_count")
    folded = flag & (F.col("column_type") == "STRING")
    counts = ("record_count", "null_count", "empty_string_count", "missing_count")
    rates = ("null_rate", "missing_rate")
    optional = [F.coalesce(distinct, F.lit(0)), F.coalesce(trues, F.lit(0))]
    ratio = F.coalesce(F.col("distinct_ratio"), F.lit(0.0))
    return {
        "missing_count": missing != nulls + F.when(folded, empties).otherwise(0),
        "count_bounds": (nulls + empties > records)
        | (nulls + optional[1] > records)
        | (optional[0] > records - missing),
        "rates": differs(F.col("null_rate"), rate(nulls, records))
        | differs(F.col("missing_rate"), rate(missing, records)),
        "distinct_ratio": distinct.isNotNull() & differs(F.col("distinct_ratio"), rate(distinct, records)),
        "ranges": _any(
            [F.col(c).isNull() | (F.col(c) < 0) for c in counts]
            + [F.col(r).isNull() | ~F.col(r).between(0, 1) for r in rates]
            + [c < 0 for c in optional]
            + [~ratio.between(0, 1), F.col("column_type").isNull() | ~F.col("column_type").isin(*SUPPORTED_TYPES)]
        ),
        "overall_value": F.col("dimension_name").isNull() & F.col("dimension_value").isNotNull(),
    }


def dimension_totals(metrics: DataFrame) -> DataFrame:
    """Slices and records per relation and dimension (NULL name for Overall)."""
    slices = metrics.groupBy(*SLICE).agg(F.max("record_count").alias("_records"))
    return slices.groupBy("unique_id", "dimension_name").agg(
        F.count(F.lit(1)).alias("slices"), F.sum("_records").alias("records")
    )


# What travels up the chain: violations found so far (with a check) and, without one, what is known of a slice, dimension or relation.
_PLACE = (*SLICE, "column_name", "check")


def _nothing() -> Column:
    return F.lit(None).cast("string")


def validate(metrics: DataFrame, relations: DataFrame) -> DataFrame:
    """All violations of a result.

    ``relations`` has one row per profiled relation: ``unique_id``, its declared ``columns``, the
    ``dimensions`` that ran and ``treat_empty_string_as_null``.

    One chain of aggregates goes from rows to slices, dimensions and relations. What fails on a level
    becomes a violation, which is handed on, and what the next level needs is summed up, so the metrics
    are read once and joined to the facts of their relations once.
    """
    facts = relations.select(
        "unique_id", F.coalesce("treat_empty_string_as_null", F.lit(False)).alias("_flag"), _supported(F.col("columns")).alias("_expected"))
    rows = metrics.join(facts, "unique_id", "left")
    known = F.col("_expected").isNotNull()
    column = F.struct(F.col("column_name").alias("name"), F.col("column_type").alias("data_type"))

    # Rows: one entry for the slice and one per failed check. Results of relations that are not asked for have no rules to meet.
    failed = _failed({name: known & F.coalesce(bad, F.lit(True)) for name, bad in _row_checks(F.col("_flag")).items()})
    of_row = F.struct(
        F.col("dimension_value"), _nothing().alias("column_name"), _nothing().alias("check"), F.col("record_count").alias("_records"),
        F.when(known & F.array_contains("_expected", column), F.col("column_name")).alias("_match"), F.size("_expected").alias("_wanted"))
    wrong = F.transform(failed, lambda name: F.struct(
        F.col("dimension_value"), F.col("column_name"), name.alias("check"), F.lit(None).cast("bigint").alias("_records"),
        _nothing().alias("_match"), F.lit(None).cast("int").alias("_wanted")))
    entries = rows.select("unique_id", "dimension_name", F.inline(F.concat(F.array(of_row), wrong)))
    slices = entries.groupBy(*_PLACE).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_records").alias("_records"), (F.min("_records") != F.max("_records")).alias("_uneven"),
        # At most as many names as the relation has columns.
        F.size(F.collect_set("_match")).alias("_found"), F.max("_wanted").alias("_wanted"),
    )

    # Slices: missing, repeated or mistyped columns, and more than one record count.
    is_slice = F.col("check").isNull()
    failed = _failed({
        "columns": is_slice & ((F.col("_n") != F.col("_wanted")) | (F.col("_found") != F.col("_wanted"))),
        "record_count": is_slice & F.col("_wanted").isNotNull() & F.col("_uneven"),
    })
    itself = F.struct(
        F.when(~is_slice, F.col("dimension_value")).alias("dimension_value"), F.col("column_name"), F.col("check"), F.col("_n"),
        F.when(is_slice, F.coalesce("_records", F.lit(0))).alias("_records"))
    wrong = F.transform(failed, lambda name: F.struct(
        F.col("dimension_value"), _nothing().alias("column_name"), name.alias("check"), F.lit(1).cast("bigint").alias("_n"),
        F.lit(None).cast("bigint").alias("_records")))
    dimensions = slices.select("unique_id", "dimension_name", F.inline(F.concat(F.array(itself), wrong))).groupBy(*_PLACE).agg(
        F.sum("_n").alias("_n"), F.sum("_records").alias("_records"))

    # Relations: Overall there, no dimension that was not asked for, and as many records in each as Overall has.
    asked = relations.select(
        "unique_id", *[_nothing().alias(name) for name in _PLACE[1:]], F.lit(0).cast("bigint").alias("_n"), F.lit(None).cast("bigint").alias("_records"),
        F.array_distinct(F.concat(F.array(_nothing()), "dimensions")).alias("_dimensions"))
    met = dimensions.withColumn("_dimensions", F.lit(None).cast("array<string>")).unionByName(asked)
    found = F.when(F.col("check").isNull() & F.col("_dimensions").isNull(), F.struct("dimension_name", "_records"))
    # Violations stay rows of their own; a relation gathers its dimensions, at most one entry each.
    lower = [F.when(F.col("check").isNotNull(), F.col(name)).alias(name) for name in _PLACE[1:]]
    relation = met.select("unique_id", *lower, "_n", "_dimensions", found.alias("_found")).groupBy(*_PLACE).agg(
        F.sum("_n").alias("_n"), F.collect_list("_found").alias("_found"), F.first("_dimensions", ignorenulls=True).alias("_wanted"))
    itself = F.when(F.col("check").isNotNull(), F.transform(F.sequence(F.lit(1).cast("bigint"), "_n"), lambda _: F.struct(
        "check", "dimension_name", "dimension_value", "column_name")))
    return relation.select("unique_id", F.inline(F.coalesce(itself, _dimension_violations()))).select(*VIOLATION_COLUMNS)


def _dimension_violations() -> Column:
    """Entries (check, dimension_name, ...) from the dimensions found (name, records) and those wanted."""
    found = F.col("_found")
    overall = F.filter(found, lambda d: d["dimension_name"].isNull())
    names = F.transform(found, lambda d: d["dimension_name"])
    records = F.aggregate(overall, F.lit(0).cast("bigint"), lambda acc, d: acc + d["_records"])
    wanted = F.coalesce("_wanted", F.array().cast("array<string>"))

    def violation(check: str, name: Column) -> Column:
        return F.struct(
            F.lit(check).alias("check"), name.alias("dimension_name"), _nothing().alias("dimension_value"), _nothing().alias("column_name"))

    unexpected = F.filter(names, lambda name: ~F.exists(wanted, lambda other: other.eqNullSafe(name)))
    uneven = F.filter(wanted, lambda name: name.isNotNull() & (F.aggregate(
        F.filter(found, lambda d: d["dimension_name"] == name), F.lit(0).cast("bigint"), lambda acc, d: acc + d["_records"]) != records))
    return F.concat(
        F.transform(unexpected, lambda name: violation("unexpected_dimension", name)),
        F.when((F.size(overall) == 0) & F.col("_wanted").isNotNull(), F.array(violation("overall", _nothing()))).otherwise(F.array()),
        F.when(F.size(overall) > 0, F.transform(uneven, lambda name: violation("reconciliation", name))).otherwise(F.array()),
    )


def _failed(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail, as an array."""
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda name: name.isNotNull())


def _supported(columns: Column) -> Column:
    pairs = F.transform(columns, lambda c: F.struct(c["name"].alias("name"), c["data_type"].alias("data_type")))
    return F.filter(pairs, lambda c: c["data_type"].isin(*SUPPORTED_TYPES))


def _any(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result
