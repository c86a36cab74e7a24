"""What is measured per column, as aggregates that can be merged.

A metric is given in three parts: the aggregate over rows, the aggregate that merges partial results
of disjoint row sets, and an expression on the merged value. Because every metric merges, the Overall
slice is rolled up from the slices of a dimension and costs no second pass over the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, functions as F

from colmetry.schema import RANGE_TYPES, SUPPORTED_TYPES, ProfiledColumn


@dataclass(frozen=True)
class Metric:
    """A mergeable aggregate for columns of some types.

    ``finish`` gets the merged value and the type label. ``output`` is the Spark type of the result
    column, which is NULL for columns of other types.
    """

    name: str
    types: tuple[str, ...]
    aggregate: Callable[[Column], Column]
    merge: Callable[[Column], Column]
    finish: Callable[[Column, str], Column] = lambda value, _label: value
    output: str = "bigint"

    def __post_init__(self) -> None:
        unknown = set(self.types) - set(SUPPORTED_TYPES)
        if unknown:
            raise ValueError(f"unknown column types: {sorted(unknown)}")
        if "STRING" in self.types:
            # Strings are counted as (value, count) groups, see operators.aggregate.
            raise ValueError("strings are measured by a StringMetric, not by a Metric")


@dataclass(frozen=True)
class StringMetric:
    """A mergeable metric of string columns, measured once for each distinct string of a slice.

    ``measure`` gets a string and the number of rows that hold it, ``merge`` adds up the measures of disjoint groups; it is applied more
    than once. Missing strings (NULL, and '' where it counts as missing) are not measured; a slice without a measured string gives
    ``finish`` a NULL. ``output`` is the Spark type of the result column, which is NULL for columns of other types.

    Strings reach ``measure`` byte for byte, so columns with a collation of their own and profiles of digests are refused.
    """

    name: str
    measure: Callable[[Column, Column], Column]
    merge: Callable[[Column], Column]
    finish: Callable[[Column, str], Column] = lambda value, _label: value
    output: str = "bigint"
    types: ClassVar[tuple[str, ...]] = ("STRING",)


NON_NULL = Metric("non_null", tuple(t for t in SUPPORTED_TYPES if t != "STRING"), F.count, F.sum)
MIN_VALUE = Metric("min_value", RANGE_TYPES, F.min, F.min)
MAX_VALUE = Metric("max_value", RANGE_TYPES, F.max, F.max)
TRUE_COUNT = Metric("true_count", ("BOOL",), F.count_if, F.sum)

# Metrics every profile reports beside the counts derived from NON_NULL.
STANDARD = (MIN_VALUE, MAX_VALUE, TRUE_COUNT)


def metrics_for(column: ProfiledColumn, added: Iterable[Metric | StringMetric] = ()) -> list[Metric]:
    """The metrics computed for one non-string column."""
    if column.text_decimal:
        return [NON_NULL, MIN_VALUE, MAX_VALUE]
    return [m for m in (NON_NULL, *STANDARD, *added) if column.data_type in m.types]
