"""SQL stating a profile column by column, for comparison with the library's passes."""

from __future__ import annotations

from collections.abc import Sequence

RANGED = {"INT64", "FLOAT64", "NUMERIC", "BIGNUMERIC", "DATE", "DATETIME", "TIMESTAMP"}


def value_text(value: str, kind: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    if kind in ("NUMERIC", "BIGNUMERIC"):
        return f"CASE WHEN contains({text}, '.') THEN rtrim(rtrim({text}, '0'), '.') ELSE {text} END"
    return f"{text} || '+00'" if kind == "TIMESTAMP" else text


def column_metrics(order: int, name: str, kind: str, flag: bool, description: str = "") -> str:
    empty = f"COUNT(*) FILTER (WHERE {name} = '')" if kind == "STRING" else "CAST(0 AS BIGINT)"
    fold = flag and kind == "STRING"
    missing = f"COUNT(*) FILTER (WHERE {name} IS NULL{f' OR {name} = ' + chr(39) * 2 if fold else ''})"
    nulls = f"COUNT(*) FILTER (WHERE {name} IS NULL)"
    distinct = f"COUNT(DISTINCT {f'NULLIF({name}, ' + chr(39) * 2 + ')' if fold else name})"
    rate = "COALESCE(CAST({} AS DOUBLE) / NULLIF(COUNT(*), 0), 0.0)"
    low, high = (
        (value_text(f"MIN({name})", kind), value_text(f"MAX({name})", kind)) if kind in RANGED
        else ("CAST(NULL AS VARCHAR)",) * 2
    )
    return ", ".join([
        "COUNT(*) AS record_count", f"{order} AS column_order", f"'{name}' AS column_name", f"'{kind}' AS column_type",
        f"'{description}' AS column_description",
        f"{nulls} AS null_count", f"{rate.format(nulls)} AS null_rate", f"{empty} AS empty_string_count",
        f"{missing} AS missing_count", f"{rate.format(missing)} AS missing_rate",
        f"{distinct if kind == 'STRING' else 'CAST(NULL AS BIGINT)'} AS distinct_count",
        f"{rate.format(distinct) if kind == 'STRING' else 'CAST(NULL AS DOUBLE)'} AS distinct_ratio",
        f"{low} AS min_value", f"{high} AS max_value",
        f"{f'COUNT(*) FILTER (WHERE {name})' if kind == 'BOOL' else 'CAST(NULL AS BIGINT)'} AS true_count",
    ])


def profile_sql(
    source: str, columns: Sequence[tuple[str, str]], dimensions: Sequence[str] = (), flag: bool = False,
    descriptions: dict[str, str] | None = None,
) -> str:
    """The full metric table of a SELECT statement."""
    kinds = dict(columns)
    parts = []
    for place, dimension in enumerate([None, *dimensions]):
        for order, (name, kind) in enumerate(columns):
            named = f"'{dimension}'" if dimension else "CAST(NULL AS VARCHAR)"
            value = value_text(dimension, kinds[dimension]) if dimension else "CAST(NULL AS VARCHAR)"
            metrics = column_metrics(order, name, kind, flag, (descriptions or {}).get(name, ""))
            group = f" GROUP BY {dimension}" if dimension else ""
            parts.append(
                f"SELECT {place} AS dimension_order, {named} AS dimension_name, {value} AS dimension_value, "
                f"{metrics} FROM profiled{group}"
            )
    return f"WITH profiled AS ({source}) " + " UNION ALL ".join(parts)
