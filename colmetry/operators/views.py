"""Tables derived from stored metric rows: ranges, shares, latest slices and sorted breakdowns.

Input is the long metric table of any number of relations, keyed by ``unique_id``. Everything is a
partial aggregate or an equi-join; totals per dimension are joined back rather than computed in a
window, so a dimension holding most of the rows is not gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colmetry.functions.text import decimal_order_key, decode_double, decode_int, float_text
from colmetry.operators.aggregate import rate
from colmetry.schema import TEMPORAL_TYPES, TYPE_FAMILIES

DIMENSION = ("unique_id", "dimension_name")
SLICE = (*DIMENSION, "dimension_value")


# -- projections and filters -----------------------------------------------------------------------


def of_family(metrics: DataFrame, family: str) -> DataFrame:
    """Rows of one type family: all, string, numeric, boolean or date."""
    if family not in TYPE_FAMILIES:
        raise ValueError(f"unknown type family: {family}")
    return metrics.where(F.col("column_type").isin(*TYPE_FAMILIES[family]))


def of_dimension(metrics: DataFrame, dimension: str | None) -> DataFrame:
    """Rows of one dimension, or of Overall for None."""
    return metrics.where(F.col("dimension_name").eqNullSafe(F.lit(dimension)))


def metric_kind(column_type: Column) -> Column:
    """How a column's metrics are shown: distinct counts, true share or a range."""
    return (
        F.when(column_type == "STRING", F.lit("string"))
        .when(column_type == "BOOL", F.lit("boolean"))
        .otherwise(F.lit("range"))
    )


def effective_missing(metrics: DataFrame) -> DataFrame:
    """Adds the missing count and rate to show: missing_* when '' counts as missing, else null_*."""
    flag = F.col("treat_empty_string_as_null")
    return metrics.withColumns({
        "effective_count": F.when(flag, F.col("missing_count")).otherwise(F.col("null_count")),
        "effective_rate": F.when(flag, F.col("missing_rate")).otherwise(F.col("null_rate")),
    })


def boolean_counts(metrics: DataFrame) -> DataFrame:
    """True and false counts and rates of BOOL rows; false is never negative."""
    records, trues = F.col("record_count"), F.coalesce("true_count", F.lit(0))
    falses = F.greatest(F.lit(0), records - F.col("null_count") - trues)
    return metrics.where("column_type = 'BOOL'").withColumns({
        "false_count": falses,
        "true_rate": rate(trues, records),
        "false_rate": rate(falses, records),
    })


def decoded(metrics: DataFrame) -> DataFrame:
    """Adds typed minima and maxima for INT64 and FLOAT64 rows."""
    kind = F.col("column_type")
    return metrics.withColumns({
        "min_int": decode_int(F.col("min_value"), kind),
        "max_int": decode_int(F.col("max_value"), kind),
        "min_double": decode_double(F.col("min_value"), kind),
        "max_double": decode_double(F.col("max_value"), kind),
    })


def with_descriptions(metrics: DataFrame, columns: DataFrame) -> DataFrame:
    """Metric rows with the declared description of their column, '' if there is none."""
    declared = columns.select("unique_id", F.col("name").alias("column_name"), F.col("description").alias("_declared"))
    return (
        metrics.drop("column_description")
        .join(declared, ["unique_id", "column_name"], "left")
        .withColumn("column_description", F.coalesce("_declared", F.lit("")))
        .drop("_declared")
    )


# -- summaries over the slices of a dimension --------------------------------------------------------


def range_summary(metrics: DataFrame, family: str = "all") -> DataFrame:
    """Per column of a family and dimension, the spread of its metric over the slices, and the number of slices of the dimension.

    STRING: least and greatest distinct count. BOOL: least and greatest true rate, 0 for an empty
    slice. Otherwise the least minimum and greatest maximum as text, NULLs ignored: integers and
    floats compared as numbers, decimals exactly, dates and times in text order.
    """
    kind = F.col("column_type")
    whole = F.when(kind == "INT64", F.lit(True))
    real = F.when(kind == "FLOAT64", F.lit(True))
    decimal = F.when(kind.isin("NUMERIC", "BIGNUMERIC"), F.lit(True))
    temporal = F.when(kind.isin(*TEMPORAL_TYPES), F.lit(True))

    def extreme(name: str, best, best_by) -> Column:
        text = F.col(name)
        # One slot per family; only the slot of the row's own type is ever filled.
        return F.coalesce(
            best(F.when(whole, decode_int(text, kind))).cast("string"),
            float_text(best(F.when(real, decode_double(text, kind)))),
            best_by(F.when(decimal, text), F.when(decimal, decimal_order_key(text))),
            best(F.when(temporal, text)),
        )

    true_rate = F.when(kind == "BOOL", rate(F.coalesce("true_count", F.lit(0)), F.col("record_count")))
    spread = of_family(metrics, family).where("dimension_name IS NOT NULL").groupBy(
        *DIMENSION, "column_order", "column_name", "column_type"
    ).agg(
        F.min("distinct_count").alias("min_distinct"),
        F.max("distinct_count").alias("max_distinct"),
        F.min(true_rate).alias("min_true_rate"),
        F.max(true_rate).alias("max_true_rate"),
        extreme("min_value", F.min, F.min_by).alias("min_value"),
        extreme("max_value", F.max, F.max_by).alias("max_value"),
    )
    # Slices of the dimension, also those that lack the column.
    return spread.join(values_per_dimension(metrics).withColumnRenamed("values", "slices"), list(DIMENSION))


def slices(metrics: DataFrame) -> DataFrame:
    """One row per slice with its record count."""
    return metrics.groupBy(*SLICE).agg(F.max("record_count").alias("record_count"))


def temporal_dimensions(metrics: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Per dimension, whether it is temporal.

    It is when every non-NULL value looks like a date and there is one, or when the declared column
    (``columns``: unique_id, name, data_type) has a temporal type.
    """
    return _temporal(metrics, columns).drop("_latest")


def _temporal(metrics: DataFrame, columns: DataFrame | None) -> DataFrame:
    """Per dimension, whether it is temporal and its greatest non-NULL value with the record count, in one aggregate."""
    value = F.col("dimension_value")
    found = metrics.where("dimension_name IS NOT NULL").groupBy(*DIMENSION).agg(
        F.coalesce(F.bool_and(value.rlike(r"^\d{4}-\d{2}-\d{2}$")), F.lit(False)).alias("temporal"),
        F.max(F.when(value.isNotNull(), F.struct("dimension_value", "record_count"))).alias("_latest"),
    )
    if columns is None:
        return found
    declared = columns.where(F.col("data_type").isin(*TEMPORAL_TYPES)).select(
        "unique_id", F.col("name").alias("dimension_name"), F.lit(True).alias("_declared")
    ).distinct()
    return found.join(declared, list(DIMENSION), "left").select(
        *DIMENSION, (F.col("temporal") | F.coalesce("_declared", F.lit(False))).alias("temporal"), "_latest"
    )


def latest_slice(metrics: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """The greatest non-NULL value of each temporal dimension, with its record count."""
    return _temporal(metrics, columns).where("temporal AND _latest IS NOT NULL").select(*DIMENSION, "_latest.*")


def row_share(metrics: DataFrame) -> DataFrame:
    """Slices with their record count relative to the largest slice of the dimension (at least 1)."""
    found = slices(metrics)
    largest = metrics.groupBy(*DIMENSION).agg(F.greatest(F.lit(1), F.max("record_count")).alias("max_records"))
    named = F.coalesce("dimension_name", F.lit("")), F.col("dimension_name").isNotNull()
    keyed = {"_name": named[0], "_named": named[1]}
    return (
        found.withColumns(keyed)
        .join(largest.withColumns(keyed).drop("dimension_name"), ["unique_id", "_name", "_named"])
        .select(*SLICE, "record_count", "max_records",
                (F.col("record_count") / F.col("max_records")).alias("row_share"))
    )


def values_per_dimension(metrics: DataFrame) -> DataFrame:
    """Number of slices of each dimension."""
    return slices(metrics.where("dimension_name IS NOT NULL")).groupBy(*DIMENSION).agg(
        F.count(F.lit(1)).alias("values")
    )


def dimension_names(metrics: DataFrame, order: str = "profile_order") -> DataFrame:
    """Distinct dimensions of each relation, first seen first."""
    return (
        metrics.where("dimension_name IS NOT NULL")
        .groupBy(*DIMENSION).agg(F.min(order).alias("first_seen"))
        .orderBy("unique_id", "first_seen")
    )


# -- cells -------------------------------------------------------------------------------------------


def column_by_slice(metrics: DataFrame, column: str) -> DataFrame:
    """Every slice with the metrics of one column; ``has_data`` is false where it has none."""
    # The column is looked up while the slice is grouped, so no join of the table with itself.
    wanted = F.col("column_name") == column
    kept = [c for c in metrics.columns if c not in (*SLICE, "record_count", "profile_order", "dimension_order", "schema_version")]
    return metrics.groupBy(*SLICE).agg(
        F.max("record_count").alias("record_count"),
        F.coalesce(F.bool_or(wanted), F.lit(False)).alias("has_data"),
        F.first(F.when(wanted, F.struct(*kept)), ignorenulls=True).alias("_metrics"),
    ).select(*SLICE, "record_count", "has_data", "_metrics.*")


def missing_matrix(metrics: DataFrame) -> DataFrame:
    """Effective missing rate of every column in every slice of a dimension, one row per cell.

    Columns are those of any slice of the dimension; a cell whose slice lacks the column has
    ``has_data`` false and no rate. Input needs ``treat_empty_string_as_null``.
    """
    cells = effective_missing(metrics.where("dimension_name IS NOT NULL"))
    # One entry per column of the relation. Slices and the dimension's columns both come from these groups, through one exchange.
    by_slice = cells.groupBy(*SLICE).agg(
        F.collect_list(F.struct("column_order", "column_name", "effective_rate")).alias("_cells")
    )
    columns = by_slice.select(*DIMENSION, F.inline("_cells")).groupBy(*DIMENSION).agg(
        F.array_sort(F.collect_set(F.struct("column_order", "column_name"))).alias("_columns")
    )
    rates = F.map_from_entries(F.transform("_cells", lambda c: F.struct(c["column_name"], c["effective_rate"])))
    return (
        by_slice.join(columns, list(DIMENSION))
        .select(*SLICE, rates.alias("_rates"), F.inline("_columns"))
        .select(*SLICE, "column_order", "column_name",
                F.map_contains_key("_rates", F.col("column_name")).alias("has_data"),
                F.try_element_at("_rates", F.col("column_name")).alias("missing_rate"))
    )


def nest_slices(metrics: DataFrame) -> DataFrame:
    """One row per slice with its columns in order, as the hierarchical form has them."""
    order = ["profile_order"] if "profile_order" in metrics.columns else []
    inside = [c for c in metrics.columns if c not in (*SLICE, "record_count", "schema_version", "profile_order", "dimension_order")]
    inside = ["column_order", *[c for c in inside if c != "column_order"]]
    return metrics.groupBy(*order, *SLICE).agg(
        F.max("record_count").alias("record_count"),
        F.array_sort(F.collect_list(F.struct(*inside))).alias("columns"),
    )


# -- orders ------------------------------------------------------------------------------------------


def in_slice_order(metrics: DataFrame) -> DataFrame:
    """Overall first, then by dimension and value with NULL as '', then by column."""
    first = [F.col("unique_id")] if "unique_id" in metrics.columns else []
    return metrics.orderBy(
        *first, F.col("dimension_name").isNotNull(), F.coalesce("dimension_name", F.lit("")),
        F.coalesce("dimension_value", F.lit("")), F.col("dimension_value").isNotNull(), "column_order",
    )


def newest_first(metrics: DataFrame) -> DataFrame:
    """Temporal slices from the latest back, the NULL slice last."""
    return metrics.orderBy(F.desc_nulls_last("dimension_value"), F.col("column_order"))


BREAKDOWN_KEYS = ("dimension", "rows", "missing", "distinct", "true", "min", "max")


def breakdown(metrics: DataFrame, key: str | None = None, descending: bool = True, temporal: bool = False) -> DataFrame:
    """Slices of one column and dimension sorted by a metric, NULL last in both directions, equal ones in slice order.

    Minima and maxima sort by value: numbers as numbers, decimals exactly, other types as text. With
    no key a temporal dimension is newest first and any other keeps its order.
    """
    if key is None:
        if not temporal:
            return metrics
        key, descending = "dimension", True
    if key not in BREAKDOWN_KEYS:
        raise ValueError(f"unknown sort key: {key}")
    kind = F.col("column_type")
    true_rate = F.coalesce(F.try_divide(F.coalesce("true_count", F.lit(0)).cast("double"), F.col("record_count")), F.lit(0.0))
    if key in ("min", "max"):
        text = F.col(f"{key}_value")
        numeric = kind.isin("INT64", "FLOAT64")
        by = [
            decode_int(text, kind), decode_double(text, kind),
            F.when(kind.isin("NUMERIC", "BIGNUMERIC"), F.coalesce(decimal_order_key(text), text)),
            F.when(~numeric, text),
        ]
    else:
        by = [{
            "dimension": F.col("dimension_value"),
            "rows": F.col("record_count"),
            "missing": F.when(F.col("treat_empty_string_as_null"), F.col("missing_rate")).otherwise(F.col("null_rate"))
            if "treat_empty_string_as_null" in metrics.columns else F.col("missing_rate"),
            "distinct": F.col("distinct_count"),
            "true": true_rate,
        }[key]]
    ties = F.coalesce("dimension_value", F.lit("")), F.col("dimension_value").isNotNull()
    return metrics.orderBy(*[c.desc_nulls_last() if descending else c.asc_nulls_last() for c in by], *ties)
