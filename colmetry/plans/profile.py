"""Profile one table: choose the dimensions that may run, then build the lazy result."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from colmetry.errors import ProfileError
from colmetry.operators.aggregate import COLUMNS_PER_PASS, StringGroups, profile_columns, row_scope, string_groups
from colmetry.operators.metrics import Metric, StringMetric
from colmetry.schema import resolve_columns, resolve_dimension
from colmetry.sources import files

MAX_DIMENSION_VALUES = 10_000


@dataclass(frozen=True)
class DimensionSkip:
    """A string dimension left out because it has too many values."""

    dimension: str
    distinct_values: int
    maximum_allowed: int

    @property
    def reason(self) -> str:
        return f"dimension has {self.distinct_values:,} distinct values; maximum allowed is {self.maximum_allowed:,}"


@dataclass(frozen=True)
class Profile:
    """A profile: its metric rows, the columns (name, type) and dimensions in it, and what was left out."""

    metrics: DataFrame
    columns: tuple[tuple[str, str], ...]
    dimensions: tuple[str, ...]
    skipped_columns: tuple[str, ...]
    skipped_dimensions: tuple[DimensionSkip, ...]


def guard_dimensions(
    df: DataFrame,
    dimensions: Sequence[str],
    *,
    columns: Iterable[tuple[str, str, str]] | None = None,
    where: str | None = None,
    treat_empty_string_as_null: bool = False,
    max_dimension_values: int = MAX_DIMENSION_VALUES,
    digest_strings: bool = False,
) -> tuple[list[str], list[DimensionSkip]]:
    """Dimensions to run and string dimensions to skip for having too many distinct values.

    Reads the string dimensions only and brings one number per dimension to the driver. As in the
    Overall profile NULL, and '' when it counts as missing, are no values of their own.
    """
    kept, skipped, _ = _guard(
        df, dimensions, None if columns is None else list(columns), where, treat_empty_string_as_null, max_dimension_values, digest_strings, False)
    return kept, skipped


def _guard(
    df: DataFrame, dimensions: Sequence[str], columns: list[tuple[str, str, str]] | None, where: str | None,
    treat_empty_string_as_null: bool, max_dimension_values: int, digest_strings: bool, keep: bool,
) -> tuple[list[str], list[DimensionSkip], StringGroups | None]:
    """Dimensions kept and skipped, by their columns' names, and with ``keep`` the groups that were counted, written for further use."""
    if max_dimension_values <= 0:
        raise ProfileError(f"max_dimension_values is {max_dimension_values}, which leaves no dimension")
    profiled, _ = resolve_columns(df, columns)
    resolved = [resolve_dimension(df, profiled, name) for name in dimensions]
    names = [c.name for c in resolved]
    strings = list(dict.fromkeys(c for c in resolved if c.data_type == "STRING"))
    if not strings:
        return names, [], None
    groups = string_groups(row_scope(df, where), strings, digest_strings)
    if keep:
        groups = replace(groups, rows=files.staged(groups.rows))
    over = {name: n for name, n in groups.distinct_counts(treat_empty_string_as_null).items() if n > max_dimension_values}
    kept = [name for name in names if name not in over]
    return kept, [DimensionSkip(name, over[name], max_dimension_values) for name in names if name in over], groups


def profile(
    df: DataFrame,
    dimensions: Sequence[str] = (),
    *,
    columns: Iterable[tuple[str, str, str]] | None = None,
    where: str | None = None,
    treat_empty_string_as_null: bool = False,
    max_dimension_values: int = MAX_DIMENSION_VALUES,
    added_metrics: Sequence[Metric | StringMetric] = (),
    columns_per_pass: int = COLUMNS_PER_PASS,
    digest_strings: bool = False,
) -> Profile:
    """Overall and per-dimension metrics of a table.

    ``columns`` declares (name, type, description) in display order; by default the schema of the
    DataFrame is used. ``where`` limits the rows before anything is counted. The strings that the guard
    counts are written to the shared scratch folder once and are not deduplicated again for Overall.
    """
    columns = None if columns is None else list(columns)
    kept, skipped, groups = _guard(
        df, dimensions, columns, where, treat_empty_string_as_null, max_dimension_values, digest_strings, True)
    profiled, unsupported = resolve_columns(df, columns)
    metrics = profile_columns(
        df, kept, columns=columns, where=where, treat_empty_string_as_null=treat_empty_string_as_null,
        added_metrics=added_metrics, columns_per_pass=columns_per_pass, digest_strings=digest_strings,
        overall_groups=groups,
    )
    covered = tuple((c.name, c.data_type) for c in profiled)
    return Profile(metrics, covered, tuple(kept), tuple(unsupported), tuple(skipped))
