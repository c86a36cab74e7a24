"""The profile itself: Overall plus one slice per dimension value, one row per (slice, column).

Two kinds of pass run over the table and each reads its own columns only, so a columnar table is
read about once however many dimensions are asked for:

* the *row pass* covers non-string columns. It is one aggregate over all dimensions whose buffers have
  fixed width, so every task emits one small row per slice. Overall is rolled up from the slices of
  the first dimension, out of the same exchange.
* the *string pass* covers string columns in a rollup of two levels. Rows become (dimension value,
  column, string) groups with a count, which are deduplicated by a partial aggregate before they are
  shuffled; the groups of the first dimension are then merged to Overall's (column, string) groups. From
  both come the distinct, null and empty counts at once. The shuffle key holds the string itself, so one
  dimension value or one string holding a large part of the table still spreads over all tasks.

Strings keep the equality of their column's collation: a group has a slot for each collation among the
columns, NULL in all but its own. A slice of a collated dimension is named by the least of its values in
binary order.

Asking Spark for ``count(DISTINCT)`` beside the other metrics would instead copy the row once per
string column and carry every buffer of the row along with each distinct string.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from colmetry.errors import ProfileError
from colmetry.functions.text import (
    decimal_from_key, decimal_order_key, decimal_text, distinct_key, float_text, timestamp_text, value_text,
)
from colmetry.operators.metrics import Metric, StringMetric, metrics_for
from colmetry.schema import ProfiledColumn, resolve_columns, resolve_dimension

# Partial aggregates with more output fields than spark.sql.codegen.maxFields (100) lose whole-stage
# code generation; thirty columns with three buffers each stay below it.
COLUMNS_PER_PASS = 30
# Strings a row is turned into by one pass over string columns: columns times dimensions.
CELLS_PER_PASS = 60

SLICE_KEYS = ("dimension_order", "dimension_name", "dimension_value")
METRIC_COLUMNS = (
    *SLICE_KEYS, "record_count", "column_order", "column_name", "column_type", "column_description",
    "null_count", "null_rate", "empty_string_count", "missing_count", "missing_rate",
    "distinct_count", "distinct_ratio", "min_value", "max_value", "true_count",
)


def row_scope(df: DataFrame, where: str | None) -> DataFrame:
    """The rows to profile: all, or those meeting a condition given without the WHERE keyword."""
    if where is None:
        return df
    if not isinstance(where, str) or not where.strip():
        raise ProfileError(f"where is a SQL condition without the word WHERE, not {where!r}")
    return df.where(F.expr(where.strip()))


def profile_columns(
    df: DataFrame,
    dimensions: Sequence[str] = (),
    *,
    columns: Iterable[tuple[str, str, str]] | None = None,
    where: str | None = None,
    treat_empty_string_as_null: bool = False,
    added_metrics: Sequence[Metric | StringMetric] = (),
    columns_per_pass: int = COLUMNS_PER_PASS,
    digest_strings: bool = False,
    overall_groups: StringGroups | None = None,
) -> DataFrame:
    """Metrics of every supported column, Overall and by each dimension, as a lazy DataFrame.

    ``dimension_order`` is 0 for Overall and the position of the dimension otherwise; a NULL
    dimension value is a slice of its own. An empty table has one Overall slice of count 0 and no
    others. No dimension guard applies here, see :func:`colmetry.profile`. ``overall_groups`` are groups
    of some string columns over the same rows that are known already.
    """
    profiled, _ = resolve_columns(df, columns)
    keys = [resolve_dimension(df, profiled, name) for name in dimensions]
    source = row_scope(df, where)

    passes: list[DataFrame] = []
    narrow = [c for c in profiled if c.data_type != "STRING" and not c.text_decimal]
    wide = [c for c in profiled if c.text_decimal]
    strings = [c for c in profiled if c.data_type == "STRING"]
    for start in range(0, len(narrow), columns_per_pass):
        passes.append(_row_pass(source, keys, narrow[start:start + columns_per_pass], added_metrics))
    if wide:
        # Text buffers rule out hash aggregation, so these stay out of the other columns' pass.
        passes.append(_row_pass(source, keys, wide, added_metrics))
    strings_per_pass = max(1, CELLS_PER_PASS // max(1, len(_distinct(keys))))
    for start in range(0, len(strings), strings_per_pass):
        passes.append(_string_pass(
            source, keys, strings[start:start + strings_per_pass], treat_empty_string_as_null, added_metrics,
            digest_strings, overall_groups,
        ))
    return reduce(DataFrame.unionByName, passes)


# -- row pass --------------------------------------------------------------------------------------


def _row_pass(
    df: DataFrame, keys: Sequence[ProfiledColumn], columns: Sequence[ProfiledColumn], added: Sequence[Metric | StringMetric]
) -> DataFrame:
    source = df.select(
        *[k.value.alias(f"_d{i}") for i, k in enumerate(_distinct(keys))],
        *[c.value.alias(f"_c{c.order}") for c in columns],
        *[decimal_order_key(c.value).alias(f"_k{c.order}") for c in columns if c.text_decimal],
    )
    plan = [(c, m, f"_c{c.order}_{m.name}") for c in columns for m in metrics_for(c, added)]
    aggregates = [F.count(F.lit(1)).alias("record_count")]
    merges = [F.sum("record_count").alias("record_count"), *[m.merge(F.col(name)).alias(name) for _, m, name in plan]]
    for c, m, name in plan:
        # Decimals kept as text are compared by their order key, which spells the number out again.
        by_key = c.text_decimal and m.name != "non_null"
        aggregates.append(m.aggregate(F.col(f"_{'k' if by_key else 'c'}{c.order}")).alias(name))
    if not keys:
        slices = source.agg(*aggregates)
        return _row_metrics(_as_overall(slices), columns, added)

    grouped, place = _group(source, _distinct(keys), aggregates, merges)
    # Every row is in exactly one slice of the first dimension, so merging those slices gives
    # Overall; the condition sits inside the aggregates to leave the grouped plan as it is, which
    # lets both branches read one exchange.
    first = place == 0
    merged = [F.coalesce(F.sum(F.when(first, F.col("record_count"))), F.lit(0)).alias("record_count")]
    merged += [m.merge(F.when(first, F.col(name))).alias(name) for _, m, name in plan]
    overall = _as_overall(grouped.agg(*merged))
    by_value = _name_slices(grouped, keys, place, ["record_count", *[name for *_, name in plan]])
    return _row_metrics(overall.unionByName(by_value), columns, added)


def _row_metrics(slices: DataFrame, columns: Sequence[ProfiledColumn], added: Sequence[Metric | StringMetric]) -> DataFrame:
    """One row per slice and column from one wide row per slice."""
    no_text, no_double, no_count = (F.lit(None).cast(kind) for kind in ("string", "double", "bigint"))
    zero = F.lit(0).cast("bigint")
    rows = []
    for c in columns:
        found = {m.name: F.col(f"_c{c.order}_{m.name}") for m in metrics_for(c, added)}
        low, high = found.get("min_value"), found.get("max_value")
        double = c.data_type == "FLOAT64"
        ranged = low is not None and not double
        text = (
            decimal_from_key if c.text_decimal
            else timestamp_text if c.data_type == "TIMESTAMP"
            else lambda value: value.cast("string")
        )
        rows.append(F.struct(
            *_identity(c),
            F.coalesce(found["non_null"], zero).alias("_non_null"),
            (text(low) if ranged else no_text).alias("_low"),
            (text(high) if ranged else no_text).alias("_high"),
            (low if double else no_double).alias("_low_double"),
            (high if double else no_double).alias("_high_double"),
            (F.coalesce(found["true_count"], zero) if "true_count" in found else no_count).alias("true_count"),
            *[
                (m.finish(found[m.name], c.data_type) if m.name in found else F.lit(None)).cast(m.output).alias(m.name)
                for m in added
            ],
        ))
    long = slices.select(*SLICE_KEYS, "record_count", F.inline(F.array(*rows)))
    # Text that takes more than a cast is made once for all columns, on the long rows.
    decimal = F.col("column_type").isin("NUMERIC", "BIGNUMERIC")
    nulls = F.col("record_count") - F.col("_non_null")
    return _with_rates(long.withColumns({
        "null_count": nulls,
        "empty_string_count": zero,
        "missing_count": nulls,
        "distinct_count": no_count,
        **{
            f"{name}_value": F.when(decimal, decimal_text(F.col(f"_{end}")))
            .when(F.col("column_type") == "FLOAT64", float_text(F.col(f"_{end}_double")))
            .otherwise(F.col(f"_{end}"))
            for name, end in (("min", "low"), ("max", "high"))
        },
    }), added)


# -- string pass -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class StringGroups:
    """(column, string) groups of some string columns with their number of rows, over a whole table.

    ``rows`` has the place of the column in ``columns`` (``_cell``), the slots and ``_rows``.
    """

    columns: tuple[ProfiledColumn, ...]
    rows: DataFrame
    digest_strings: bool

    def distinct_counts(self, treat_empty_string_as_null: bool) -> dict[str, int]:
        """Exact distinct counts by column name: one number per column comes to the driver."""
        held = _Slots(self.columns, self.digest_strings)
        counted = self.rows.groupBy("_cell").agg(F.count_if(held.present(treat_empty_string_as_null)).alias("n")).collect()
        found = {r["_cell"]: r["n"] for r in counted}
        return {c.name: found.get(i, 0) for i, c in enumerate(self.columns)}


class _Slots:
    """Slots that hold the string of a cell, one for each collation among some columns, NULL in all but the column's own."""

    def __init__(self, columns: Sequence[ProfiledColumn], digest_strings: bool):
        self.digest_strings = digest_strings
        self.types = sorted({self._type(c) for c in columns})
        self.names = [f"_text{k}" for k in range(len(self.types))]

    def _type(self, column: ProfiledColumn) -> str:
        return "string" if self.digest_strings or not column.collation else f"string collate {column.collation}"

    def of(self, column: ProfiledColumn, value: Column) -> list[Column]:
        """The slots of a cell of ``column``."""
        own = self._type(column)
        return [(value if kind == own else F.lit(None).cast(kind)).alias(name) for kind, name in zip(self.types, self.names)]

    def empty(self) -> list[Column]:
        return [F.lit(None).cast(kind).alias(name) for kind, name in zip(self.types, self.names)]

    def read(self, value: Column) -> Column:
        return distinct_key(value) if self.digest_strings else value

    def text(self) -> Column:
        """The string of a cell, whatever its slot."""
        return F.coalesce(*[F.col(name).cast("string") for name in self.names])

    def is_null(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(name).isNull() for name in self.names])

    def is_empty(self) -> Column:
        return reduce(lambda a, b: a | b, [F.coalesce(F.col(name) == "", F.lit(False)) for name in self.names])

    def present(self, treat_empty_string_as_null: bool) -> Column:
        return ~self.is_null() & ~self.is_empty() if treat_empty_string_as_null else ~self.is_null()


def string_groups(df: DataFrame, columns: Sequence[ProfiledColumn], digest_strings: bool = False) -> StringGroups:
    """Groups of a few string columns over the whole table, lazily."""
    held = _Slots(columns, digest_strings)
    source = df.select(*[held.read(c.value).alias(f"_c{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(i).alias("_cell"), *held.of(c, F.col(f"_c{i}"))) for i, c in enumerate(columns)]
    rows = source.select(F.inline(F.array(*cells))).groupBy("_cell", *held.names).agg(F.count(F.lit(1)).alias("_rows"))
    return StringGroups(tuple(columns), rows, digest_strings)


def _string_pass(
    df: DataFrame,
    keys: Sequence[ProfiledColumn],
    columns: Sequence[ProfiledColumn],
    treat_empty_string_as_null: bool,
    added: Sequence[Metric | StringMetric],
    digest_strings: bool,
    known: StringGroups | None,
) -> DataFrame:
    slots, distinct = _Slots(columns, digest_strings), _distinct(keys)
    measured = [m for m in added if isinstance(m, StringMetric)]
    _refuse_unreadable(measured, columns, digest_strings)
    present = slots.present(treat_empty_string_as_null)
    ready = [] if known is None or known.digest_strings != digest_strings else [c for c in columns if c in known.columns]
    kinds = df.select(*[k.value for k in distinct]).schema.fields
    # Cells 0 to n - 1 are Overall's columns, the next n those of the first dimension, and so on.
    keyed = ["_cell", *[f"_d{i}" for i in range(len(distinct))]]
    absent = [F.lit(None).cast(kind.dataType).alias(f"_d{i}") for i, kind in enumerate(kinds)]
    absent += [F.lit(None).cast("string").alias(f"_n{i}") for i, k in enumerate(distinct) if k.collation]
    measures = [F.when(present, m.measure(slots.text(), F.col("_rows"))).alias(f"_m{k}") for k, m in enumerate(measured)]
    # A type for measures that are not made yet.
    blank = df.sparkSession.range(0).select(*slots.empty(), F.lit(0).cast("bigint").alias("_rows")).select(*measures).schema
    unmeasured = [F.lit(None).cast(field.dataType).alias(field.name) for field in blank]
    uncounted = [*[F.lit(None).cast("bigint").alias(name) for name in _COUNTS], *unmeasured]
    counted = [  # of a group, whose string then is not needed any more
        F.when(slots.is_null(), F.col("_rows")).otherwise(0).alias("_nulls"),
        F.when(slots.is_empty(), F.col("_rows")).otherwise(0).alias("_empties"),
        present.cast("bigint").alias("_present"),
    ]

    def overall(groups: StringGroups, wanted: Sequence[ProfiledColumn]) -> DataFrame:
        """Overall's groups of some columns."""
        own = _Slots(groups.columns, digest_strings)
        by_kind, place = dict(zip(own.types, own.names)), {groups.columns.index(c): columns.index(c) for c in wanted}
        cell = reduce(lambda acc, at: acc.when(F.col("_cell") == at, F.lit(place[at])), place, F).alias("_cell")
        return groups.rows.where(F.col("_cell").isin(list(place))).select(cell, *absent, *[
            (F.col(by_kind[kind]) if kind in by_kind else F.lit(None).cast(kind)).alias(name)
            for kind, name in zip(slots.types, slots.names)
        ], "_rows", *uncounted)

    parts = [overall(known, ready)] if ready else []
    if keys:
        groups = _dimension_groups(df, distinct, columns, slots)
        names = [f"_n{i}" for i, k in enumerate(distinct) if k.collation]
        # A group becomes its slice's counts and, from the first dimension, Overall's string; one more aggregate adds up both.
        of_slice = F.struct(*keyed, *names, *slots.empty(), "_rows", *counted, *measures)
        of_overall = F.struct((F.col("_cell") - len(columns)).alias("_cell"), *absent, *slots.names, "_rows", *uncounted)
        rolled = [len(columns) + i for i, c in enumerate(columns) if c not in ready]
        both = F.when(F.col("_cell").isin(rolled), F.array(of_slice, of_overall)).otherwise(F.array(of_slice))
        parts.append(groups.select(F.inline(both)).groupBy(*keyed, *slots.names).agg(
            *[F.min(name).alias(name) for name in names], F.sum("_rows").alias("_rows"), *[F.sum(name).alias(name) for name in _COUNTS],
            *[m.merge(F.col(f"_m{k}")).alias(f"_m{k}") for k, m in enumerate(measured)]))
    elif len(ready) < len(columns):
        left = [c for c in columns if c not in ready]
        parts.append(overall(string_groups(df, left, digest_strings), left))
    # A group of no rows per column keeps the Overall slice of an empty table.
    parts.append(df.sparkSession.range(len(columns), numPartitions=1).select(
        F.col("id").cast("int").alias("_cell"), *absent, *slots.empty(), F.lit(0).cast("bigint").alias("_rows"), *uncounted))
    slices = reduce(DataFrame.unionByName, parts).groupBy(*keyed).agg(
        F.sum("_rows").alias("record_count"),
        *[F.sum(F.coalesce(name, count)).alias(to) for name, count, to in zip(
            _COUNTS, counted, ("null_count", "empty_string_count", "distinct_count"))],
        *[m.merge(F.coalesce(F.col(f"_m{k}"), made)).alias(m.name) for k, (m, made) in enumerate(zip(measured, measures))],
        *[F.min(f"_n{i}").alias(f"_n{i}") for i, k in enumerate(distinct) if k.collation],
    )
    counts = ["record_count", "null_count", "empty_string_count", "distinct_count", *[m.name for m in measured]]
    place = F.floor(F.col("_cell") / len(columns)) - 1
    named = _name_slices(slices, keys, place, ["_cell", *counts], with_overall=True)
    column = F.element_at(F.array(*[F.struct(*_identity(c)) for c in columns]), F.col("_cell") % len(columns) + 1)
    missing = F.col("null_count")
    if treat_empty_string_as_null:
        missing = missing + F.col("empty_string_count")
    described = named.withColumn("_identity", column).select(
        *SLICE_KEYS, "record_count", "_identity.*", "null_count", "empty_string_count",
        missing.alias("missing_count"), "distinct_count",
        *[F.lit(None).cast("string").alias(name) for name in ("min_value", "max_value")],
        F.lit(None).cast("bigint").alias("true_count"),
        *[(m.finish(F.col(m.name), "STRING") if m in measured else F.lit(None)).cast(m.output).alias(m.name) for m in added],
    )
    return _with_rates(described, added)


def _refuse_unreadable(measured: Sequence[StringMetric], columns: Sequence[ProfiledColumn], digest_strings: bool) -> None:
    """Raise where the groups do not hold the strings that a metric is to measure."""
    if measured and digest_strings:
        raise ProfileError(f"digest_strings leaves no strings for {measured[0].name!r} to measure")
    collated = [c.name for c in columns if c.collation]
    if measured and collated:
        raise ProfileError(f"{measured[0].name!r} measures strings as they are, but equal strings of {collated[0]!r} may differ")


_COUNTS = ("_nulls", "_empties", "_present")


def _dimension_groups(
    df: DataFrame, distinct: Sequence[ProfiledColumn], columns: Sequence[ProfiledColumn], slots: _Slots
) -> DataFrame:
    """(dimension value, column, string) groups, all dimensions in one aggregate over the rows."""
    held = [f"_d{i}" for i in range(len(distinct))]
    source = df.select(
        *[k.value.alias(name) for k, name in zip(distinct, held)],
        *[slots.read(c.value).alias(f"_c{i}") for i, c in enumerate(columns)],
    )
    # One cell per dimension and column: which one it is (as a number, so that keys stay narrow), the value of that dimension and
    # the string.
    absent = {name: F.lit(None).cast(source.schema[name].dataType) for name in held}
    cells = [
        F.struct(
            F.lit((place + 1) * len(columns) + i).alias("_cell"),
            *[(F.col(name) if k == place else absent[name]).alias(name) for k, name in enumerate(held)],
            *slots.of(c, F.col(f"_c{i}")),
        )
        for place in range(len(held)) for i, c in enumerate(columns)
    ]
    return source.select(F.inline(F.array(*cells))).groupBy("_cell", *held, *slots.names).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.min(F.col(f"_d{i}").cast("string")).alias(f"_n{i}") for i, k in enumerate(distinct) if k.collation])


# -- shared ----------------------------------------------------------------------------------------


def _distinct(keys: Sequence[ProfiledColumn]) -> list[ProfiledColumn]:
    return list(dict.fromkeys(keys))


def _group(
    df: DataFrame, dimensions: Sequence[ProfiledColumn], aggregates: Sequence[Column], merges: Sequence[Column]
) -> tuple[DataFrame, Column]:
    """Group by each dimension in turn, all in one aggregate.

    Returns the groups and an expression for the place of the dimension a group belongs to. Rows are
    repeated by a generator rather than by grouping sets, as two uses of the latter do not share
    their exchange. Values of a collated dimension are grouped by their bytes, which hashes, and their
    few groups are then merged under the collation.
    """
    held = [f"_d{i}" for i in range(len(dimensions))]
    collated = {name: k.collation for name, k in zip(held, dimensions) if k.collation}
    if collated:
        plain = df.withColumns({name: F.col(name).cast("string") for name in collated})
        groups, place = _group(plain, [replace(k, spark_type=T.StringType()) if k.collation else k for k in dimensions], aggregates, merges)
        named = groups.withColumns({f"_n{name[2:]}": F.col(name) for name in collated}).withColumns(
            {name: F.collate(F.col(name), collation) for name, collation in collated.items()})
        by = held if len(dimensions) == 1 else ["_place", *held]
        return named.groupBy(*by).agg(*merges, *[F.min(f"_n{name[2:]}").alias(f"_n{name[2:]}") for name in collated]), place
    if len(dimensions) == 1:
        return df.groupBy(*held).agg(*aggregates), F.lit(0)
    measured = [name for name in df.columns if name not in held]
    sets = [
        F.struct(F.lit(place).alias("_place"), *[
            (F.col(name) if i == place else F.lit(None).cast(df.schema[name].dataType)).alias(name)
            for i, name in enumerate(held)
        ])
        for place in range(len(dimensions))
    ]
    repeated = df.select(*measured, F.inline(F.array(*sets)))
    return repeated.groupBy("_place", *held).agg(*aggregates), F.col("_place")


def _as_overall(row: DataFrame) -> DataFrame:
    return row.select(
        F.lit(0).alias("dimension_order"),
        F.lit(None).cast("string").alias("dimension_name"),
        F.lit(None).cast("string").alias("dimension_value"),
        *row.columns,
    )


def _name_slices(
    groups: DataFrame, keys: Sequence[ProfiledColumn], place: Column, kept: Sequence[str], with_overall: bool = False
) -> DataFrame:
    """Replace typed dimension columns by order, name and value text.

    A dimension asked for twice is grouped once and repeated here.
    """
    distinct = _distinct(keys)
    nothing = F.lit(None).cast("string")

    def naming(order: int, name: Column, value: Column) -> Column:
        return F.struct(
            F.lit(order).alias("dimension_order"), name.alias("dimension_name"), value.alias("dimension_value")
        )

    choices: list[tuple[int, Column]] = [(-1, F.array(naming(0, nothing, nothing)))] if with_overall else []
    for i, key in enumerate(distinct):
        text = F.col(f"_n{i}") if key.collation else value_text(F.col(f"_d{i}"), key.data_type)
        choices.append((i, F.array(*[
            naming(order, F.lit(key.name), text) for order, k in enumerate(keys, start=1) if k == key
        ])))
    if len(choices) == 1:
        return groups.select(F.inline(choices[0][1]), *kept)
    chosen = reduce(lambda acc, choice: acc.when(place == choice[0], choice[1]), choices, F)
    return groups.select(F.inline(chosen), *kept)


def _identity(column: ProfiledColumn) -> list[Column]:
    return [
        F.lit(column.order).alias("column_order"),
        F.lit(column.name).alias("column_name"),
        F.lit(column.data_type).alias("column_type"),
        F.lit(column.description).alias("column_description"),
    ]


def rate(count: Column, total: Column) -> Column:
    """count / total, 0 for an empty slice; NULL stays NULL."""
    return F.when(count.isNotNull(), F.coalesce(F.try_divide(count.cast("double"), total), F.lit(0.0)))


def _with_rates(df: DataFrame, added: Sequence[Metric | StringMetric]) -> DataFrame:
    total = F.col("record_count")
    return df.withColumns({
        "null_rate": rate(F.col("null_count"), total),
        "missing_rate": rate(F.col("missing_count"), total),
        "distinct_ratio": rate(F.col("distinct_count"), total),
    }).select(*METRIC_COLUMNS, *[m.name for m in added])
