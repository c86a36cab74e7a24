"""Profile every enabled relation of a store and publish the results together, or not at all.

The driver handles one small record per relation and task. Metric rows go from the aggregation
straight to a written table; checks, merge and publication read that table.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from colmetry.errors import ProfileError
from colmetry.operators.aggregate import row_scope
from colmetry.operators.catalog import carry_over, merge_results
from colmetry.operators.validate import validate
from colmetry.plans import tasks as planning
from colmetry.plans.profile import Profile, profile
from colmetry.schema import STORED_METRICS, resolve_columns, resolve_dimension
from colmetry.sources import files
from colmetry.sources.snapshots import SnapshotStore, number_slices, stage_slices

RESULTS = (
    "run_id string, task_number int, unique_id string, name string, dimension string, status string, "
    "row_count bigint, error string, skip_reason string, distinct_values bigint, maximum_allowed bigint, "
    "estimated_bytes bigint, bytes_processed bigint, published boolean"
)

TableReader = Callable[[SparkSession, Row], DataFrame]


@dataclass(frozen=True)
class TaskResult:
    task_number: int
    unique_id: str
    name: str
    dimension: str | None
    estimated_bytes: int | None = None
    max_bytes_billed: int | None = None
    status: str = "planned"
    row_count: int = 0
    error: str | None = None
    skip_reason: str | None = None
    distinct_values: int | None = None
    maximum_allowed: int | None = None
    bytes_processed: int | None = None


@dataclass(frozen=True)
class RunResult:
    run_id: str
    published: bool
    tasks: tuple[TaskResult, ...]
    location: str | None = None
    violations: dict[str, int] = field(default_factory=dict)


def read_table(spark: SparkSession, relation: Row) -> DataFrame:
    """The table a relation names: its relation_name, else database.schema.name."""
    name = relation.relation_name.replace("`", "")
    parts = name.split(".") if name else [p for p in (relation.database, relation.schema, relation.name) if p]
    return spark.table(".".join(f"`{part}`" for part in parts))


def import_relations(store: SnapshotStore, imported: DataFrame) -> str:
    """Save imported relations, keeping the stored results that still hold."""
    if not store.exists():
        no_metrics = imported.sparkSession.createDataFrame([], STORED_METRICS)
        return store.write(imported, no_metrics)
    kept = carry_over(imported, store.read())
    return store.write(kept.relations, kept.metrics)


def run(
    store: SnapshotStore, *, select: str | None = None, read: TableReader = read_table, threads: int = 1,
    columns_per_pass: int | None = None,
) -> RunResult:
    """Profile the enabled relations and publish a new generation.

    Nothing is published when a relation is over its scan limit, a task fails or a check finds a
    violation. A string dimension with too many values is left out and the rest is published.
    ``threads`` relations are submitted at a time; small relations then share the cluster.
    """
    if threads < 1:
        raise ProfileError(f"a run needs one thread or more, not {threads}")
    spark = store.spark
    stored = store.read()
    # Each relation is a table with jobs of its own, so the driver walks over the relations.
    chosen = planning.enabled_relations(stored.relations, select).orderBy("name", "unique_id").collect()
    tables, unreadable = _read_tables(spark, chosen, read)
    planned = _plan(chosen, tables)
    run_id = uuid4().hex

    if unreadable:
        outcomes = {relation.unique_id: unreadable.get(relation.unique_id) for relation in chosen}
        return _record(store, RunResult(run_id, False, tuple(_task_outcomes(planned, outcomes, {}, True))))
    blocked = _over_limit(planned)
    if blocked:
        done = [replace(t, status="skipped", error=(
            f"the tasks of {t.name} are estimated to exceed its max_bytes_billed of {t.max_bytes_billed}" if t.unique_id in blocked
            else "left out as another relation of the plan is over its max_bytes_billed"
        )) for t in planned]
        return _record(store, RunResult(run_id, False, tuple(done)))

    scratch = store.scratch()
    try:
        return _record(store, _execute(store, stored, chosen, tables, planned, run_id, scratch, threads, columns_per_pass))
    finally:
        files.delete(spark, scratch)


def _read_tables(spark: SparkSession, chosen: list[Row], read: TableReader) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Tables by relation, and error texts of relations whose table is missing, lacks a declared column or does not fit its type."""
    tables, unreadable = {}, {}
    for relation in chosen:
        try:
            table = read(spark, relation)
            resolve_columns(table, _declared(relation))
            # Conditions that the table cannot answer show up here, before any job.
            row_scope(table, relation.profiling.where)
            tables[relation.unique_id] = table
        except Exception as error:  # noqa: BLE001 - reported per task
            unreadable[relation.unique_id] = str(error) or type(error).__name__
    return tables, unreadable


def _plan(chosen: list[Row], tables: dict[str, DataFrame]) -> list[TaskResult]:
    planned: list[TaskResult] = []
    for relation in chosen:
        settings, table = relation.profiling, tables.get(relation.unique_id)
        limit, size, dimensions = settings.max_bytes_billed, None, settings.dimensions
        if table is not None:
            columns, _ = resolve_columns(table, _declared(relation))
            dimensions = [resolve_dimension(table, columns, name).name for name in settings.dimensions]
            size = None if limit is None else files.scanned_bytes(row_scope(table, settings.where))
        for dimension in [None, *dimensions]:
            planned.append(TaskResult(
                len(planned), relation.unique_id, relation.name, dimension, estimated_bytes=size, max_bytes_billed=limit,
            ))
    return planned


def _declared(relation: Row) -> list[tuple[str, str, str]] | None:
    return [(c.name, c.data_type, c.description) for c in relation.columns] or None


def _over_limit(planned: list[TaskResult]) -> set[str]:
    """Relations whose tasks together read more than their limit, or an unknown amount."""
    totals: dict[str, list[TaskResult]] = {}
    for task in planned:
        totals.setdefault(task.unique_id, []).append(task)
    over = set()
    for unique_id, group in totals.items():
        limit = group[0].max_bytes_billed
        sizes = [t.estimated_bytes for t in group]
        if limit is not None and (None in sizes or sum(sizes) > limit):
            over.add(unique_id)
    return over


def _execute(store, stored, chosen, tables, planned, run_id, scratch, threads, columns_per_pass) -> RunResult:
    spark = store.spark
    stopped: list[str] = []

    def compute(number: int, relation: Row) -> Profile | str | None:
        """The profile of one relation, an error text, or None when an earlier failure ended the run."""
        if stopped:
            return None
        settings = relation.profiling
        try:
            options = {} if columns_per_pass is None else {"columns_per_pass": columns_per_pass}
            result = profile(
                tables[relation.unique_id], settings.dimensions, columns=_declared(relation), where=settings.where,
                treat_empty_string_as_null=settings.treat_empty_string_as_null,
                max_dimension_values=settings.max_dimension_values, **options,
            )
            keyed = result.metrics.withColumn("unique_id", F.lit(relation.unique_id))
            stage_slices(keyed, f"{scratch}/relation-{number:06d}")
            return result
        except Exception as error:  # noqa: BLE001 - reported per task
            stopped.append(relation.unique_id)
            return str(error) or type(error).__name__

    if threads == 1 or len(chosen) == 1:
        outcomes = [compute(i, r) for i, r in enumerate(chosen)]
    else:
        with ThreadPoolExecutor(max_workers=min(threads, len(chosen))) as pool:
            outcomes = list(pool.map(lambda pair: compute(*pair), enumerate(chosen)))
    by_id = {relation.unique_id: outcome for relation, outcome in zip(chosen, outcomes)}

    if stopped:
        return RunResult(run_id, False, tuple(_task_outcomes(planned, by_id, {}, bool(stopped))))

    folders = [f"{scratch}/relation-{i:06d}" for i in range(len(chosen))]
    staged = spark.read.parquet(*folders)
    # A dimension listed twice was computed once and repeated; the first copy is checked.
    first = _without_repeats(staged, by_id)
    checked = _checked_relations(stored.relations, by_id)
    violations = {r.check: r.n for r in validate(first, checked).groupBy("check").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = first.groupBy("unique_id", "dimension_name").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = {(r.unique_id, r.dimension_name): r.n for r in counted}
    done = _task_outcomes(planned, by_id, rows, False)
    if violations:
        text = "result failed checks: " + ", ".join(sorted(violations))
        failed = tuple(replace(t, status="failed", error=text) if t.status == "succeeded" else t for t in done)
        return RunResult(run_id, False, failed, violations=violations)

    profiled_at = datetime.now(UTC).isoformat()
    ids, numbered = checked.select("unique_id"), number_slices(staged)
    merged = merge_results(stored, numbered, ids, profiled_at)
    return RunResult(run_id, True, tuple(done), store.publish(merged.relations, numbered, ids))


def _checked_relations(relations: DataFrame, by_id: dict[str, Profile]) -> DataFrame:
    """What the checks need to know of each relation: its columns, the dimensions that ran, the flag."""
    spark = relations.sparkSession
    ran = spark.createDataFrame(
        [(unique_id, list(p.dimensions), [tuple(c) for c in p.columns]) for unique_id, p in by_id.items()],
        "unique_id string, dimensions array<string>, columns array<struct<name:string,data_type:string>>",
    )
    flags = relations.select("unique_id", F.col("profiling.treat_empty_string_as_null").alias("treat_empty_string_as_null"))
    return ran.join(flags, "unique_id")


def _without_repeats(staged: DataFrame, by_id: dict[str, Profile]) -> DataFrame:
    repeats = [
        (unique_id, order)
        for unique_id, p in by_id.items()
        for order, name in enumerate(p.dimensions, start=1) if name in p.dimensions[:order - 1]
    ]
    if not repeats:
        return staged
    listed = staged.sparkSession.createDataFrame(repeats, "unique_id string, dimension_order int")
    return staged.join(listed, ["unique_id", "dimension_order"], "left_anti")


def _task_outcomes(planned, by_id, rows, ended: bool) -> list[TaskResult]:
    done = []
    failed_first: set[str] = set()
    for task in planned:
        outcome = by_id[task.unique_id]
        if outcome is None:
            done.append(replace(task, status="skipped", error="not run, as another relation failed"))
        elif isinstance(outcome, str):
            # The tasks of a relation share their scans and fail as one.
            first = task.unique_id not in failed_first
            failed_first.add(task.unique_id)
            done.append(replace(task, status="failed" if first else "skipped",
                                error=outcome if first else "not run, as an earlier item of this relation failed"))
        else:
            skip = next((s for s in outcome.skipped_dimensions if s.dimension == task.dimension), None)
            if skip:
                done.append(replace(
                    task, status="skipped", error=skip.reason, skip_reason="max_dimension_values",
                    distinct_values=skip.distinct_values, maximum_allowed=skip.maximum_allowed,
                ))
            else:
                # What was read is not known: Spark does not tell the driver's Python, and the estimate is no measurement.
                done.append(replace(
                    task, status="succeeded",
                    row_count=0 if ended else rows.get((task.unique_id, task.dimension), 0),
                ))
    return done


def _record(store: SnapshotStore, result: RunResult) -> RunResult:
    """Append the outcome of every task to the run history of the store."""
    rows = [(
        result.run_id, t.task_number, t.unique_id, t.name, t.dimension, t.status, t.row_count, t.error, t.skip_reason,
        t.distinct_values, t.maximum_allowed, t.estimated_bytes, t.bytes_processed, result.published,
    ) for t in result.tasks]
    store.spark.createDataFrame(rows, RESULTS).coalesce(1).write.mode("append").parquet(f"{store.path}/run_results")
    return result


def run_results(store: SnapshotStore) -> DataFrame:
    """Outcomes of all recorded runs, one row per task."""
    return store.spark.read.schema(RESULTS).parquet(f"{store.path}/run_results")
