"""Stored results: two Parquet tables per generation and a pointer to the current one.

    <path>/current                        name of the generation readers use
    <path>/generations/gen-0001/models.parquet
    <path>/generations/gen-0001/column_profiles.parquet

A new generation is written beside the old ones, read back and checked, and only then named by the
pointer, so readers see either the old or the new result. One writer at a time is assumed. A folder
with the two tables directly inside is read as well until its first generation is written.

A run publishes in proportion to what it ran: its generation holds the metric rows of its relations
only, and ``parts.parquet`` names for every relation the generation whose table has its rows. Tables are
never changed, so generations share them; one that is out of the kept ones loses its relations but keeps
its metric rows as long as a kept generation names it. A generation without ``parts.parquet`` holds the
rows of all its relations.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from colmetry.errors import AmbiguousError, NotFoundError, StorageError
from colmetry.functions.json_text import decode_relations, encode_relations
from colmetry.operators.aggregate import rate
from colmetry.schema import SCHEMA_VERSION, STORED_METRICS
from colmetry.sources import files

MODELS = "models.parquet"
METRICS = "column_profiles.parquet"
PARTS = "parts.parquet"
PARTS_SCHEMA = "unique_id STRING, part STRING, metric_rows BIGINT"
KEEP_GENERATIONS = 3
MIN_GENERATIONS = 2
# Generations whose rows one generation may be made of; the publication after that rewrites them into one table.
MAX_PARTS = 64

STORED_METRIC_COLUMNS = tuple(part.strip().split(" ")[0] for part in STORED_METRICS.split(","))


@dataclass(frozen=True)
class Snapshot:
    """Relations (one row each, lists as arrays) and their metric rows."""

    relations: DataFrame
    metrics: DataFrame


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str, keep: int = KEEP_GENERATIONS):
        if keep < MIN_GENERATIONS:
            raise ValueError(f"keep must be at least {MIN_GENERATIONS}")
        self.spark = spark
        self.path = str(path).rstrip("/")
        self.keep = keep

    # -- reading -------------------------------------------------------------------------------

    def generation(self) -> int:
        """Number of the current generation, 0 before the first."""
        if not files.exists(self.spark, f"{self.path}/current"):
            return 0
        name = files.read_text(self.spark, f"{self.path}/current").strip()
        if not name.startswith("gen-") or not name[4:].isdigit():
            raise StorageError(f"the pointer does not name a generation: {name!r}")
        return int(name[4:])

    def location(self) -> str:
        """Folder holding the two current tables."""
        number = self.generation()
        return f"{self.path}/generations/gen-{number:04d}" if number else self.path

    def exists(self) -> bool:
        """Whether there is a stored result; a table without its partner is an error."""
        folder = self.location()
        present = [files.exists(self.spark, f"{folder}/{name}") for name in (MODELS, METRICS)]
        if any(present) and not all(present):
            raise StorageError(f"incomplete profile storage in {folder}: both tables are required")
        if folder != self.path and not all(present):
            raise StorageError(f"the current generation is missing: {folder}")
        return all(present)

    def read(self) -> Snapshot:
        """Relations by name, and metric rows in slice and column order."""
        return read_tables(self.spark, self._folder())

    def read_relations(self) -> DataFrame:
        """Relations only; the metric table is not scanned."""
        folder = self._folder()
        models, metrics = _tables(self.spark, folder)
        return _read_models(models, _is_current(models, metrics, check_metrics=False))

    def read_relation(self, identifier: str) -> Snapshot:
        """One relation by unique id, or else by name."""
        models, metrics = _tables(self.spark, self._folder())
        current = _is_current(models, metrics, check_metrics=False)
        relations = _read_models(models, current)
        for field in ("unique_id", "name"):
            found = relations.where(F.col(field) == identifier)
            ids = [row.unique_id for row in found.select("unique_id").limit(2).collect()]
            if len(ids) > 1:
                raise AmbiguousError(f"several relations are called {identifier!r}; look one up by its unique_id")
            if ids:
                wanted = F.col("unique_id") == ids[0]
                if current:
                    metrics = _metric_table(self.spark, self._folder(), ids[0])
                    _check_version(metrics)
                return Snapshot(found, _read_metrics(models.where(wanted), metrics, current))
        raise NotFoundError(identifier)

    def _folder(self) -> str:
        if not self.exists():
            raise StorageError(f"no profile storage in {self.path}")
        return self.location()

    # -- writing -------------------------------------------------------------------------------

    def write(self, relations: DataFrame, metrics: DataFrame) -> str:
        """Publish a new generation and return its folder.

        ``metrics`` needs ``unique_id`` and ``profile_order``. Both inputs may come from the current
        generation.
        """
        number = self.generation() + 1
        folder = f"{self.path}/generations/gen-{number:04d}"
        if files.exists(self.spark, folder):
            raise StorageError(f"{folder} exists; another write may be running or was left unfinished")
        try:
            rows, given = F.count(F.lit(1)).alias("n"), [Observation(), Observation()]
            # In the order of lookups, so that statistics confine a relation to few files and row groups.
            placed = stored_metrics(metrics).orderBy("unique_id", "profile_order", "column_order")
            placed.observe(given[0], rows).write.option("compression", "zstd").parquet(f"{folder}/{METRICS}")
            written = self.spark.read.schema(STORED_METRICS).parquet(f"{folder}/{METRICS}")
            # Only the new table is read to fill in columns, whatever the input was derived from.
            models = encode_relations(_with_columns(relations, written))
            models.observe(given[1], rows).write.option("compression", "zstd").parquet(f"{folder}/{MODELS}")
            back = read_tables(self.spark, folder)
            known = back.relations.select("unique_id", F.lit(True).alias("_known"))
            found = back.metrics.join(known, "unique_id", "left").agg(rows, F.count_if(F.col("_known").isNull()).alias("unknown")).first()
            if found.unknown:
                raise StorageError(f"{found.unknown} metric rows belong to no relation")
            self._compare("metric rows", given[0].get["n"], found.n)
            self._compare("relations", given[1].get["n"], back.relations.count())
            files.replace_text(self.spark, f"{self.path}/current", f"gen-{number:04d}")
        except Exception:
            files.delete(self.spark, folder)
            raise
        self._forget_old()
        return folder

    def publish(self, relations: DataFrame, metrics: DataFrame, profiled: DataFrame) -> str:
        """Publish a new generation in which the relations ``profiled`` (``unique_id``) have ``metrics`` and all others keep their rows.

        Only ``metrics``, the relations and the list of parts are written. Results stored in an older format, and those that have come to
        consist of ``MAX_PARTS`` tables, are written whole.
        """
        folder = self._folder()
        ids = profiled.select("unique_id").distinct()
        if self.generation() == 0 or set(_tables(self.spark, folder)[1].columns) != set(STORED_METRIC_COLUMNS):
            return self._publish_whole(relations, metrics, ids)
        kept = _parts(self.spark, folder).join(ids, "unique_id", "left_anti").join(relations.select("unique_id"), "unique_id", "left_semi")
        if kept.select("part").distinct().count() >= MAX_PARTS:
            return self._publish_whole(relations, metrics, ids)
        number = self.generation() + 1
        name, target = f"gen-{number:04d}", f"{self.path}/generations/gen-{number:04d}"
        if files.exists(self.spark, target):
            raise StorageError(f"{target} exists; another write may be running or was left unfinished")
        try:
            rows, given = F.count(F.lit(1)).alias("n"), [Observation(), Observation()]
            placed = stored_metrics(metrics).orderBy("unique_id", "profile_order", "column_order")
            placed.observe(given[0], rows).write.option("compression", "zstd").parquet(f"{target}/{METRICS}")
            written = self.spark.read.schema(STORED_METRICS).parquet(f"{target}/{METRICS}")
            own = written.groupBy("unique_id").agg(rows.alias("metric_rows")).select("unique_id", F.lit(name).alias("part"), "metric_rows")
            if not own.join(ids, "unique_id", "left_anti").isEmpty():
                raise StorageError("metric rows of a relation that was not profiled")
            kept.unionByName(own).write.option("compression", "zstd").parquet(f"{target}/{PARTS}")
            models = encode_relations(_with_columns(relations, written))
            models.observe(given[1], rows).write.option("compression", "zstd").parquet(f"{target}/{MODELS}")
            back = read_models(self.spark, target)
            unknown = own.join(back, "unique_id", "left_anti").agg(F.coalesce(F.sum("metric_rows"), F.lit(0)).alias("n")).first().n
            if unknown:
                raise StorageError(f"{unknown} metric rows belong to no relation")
            self._compare("metric rows", given[0].get["n"], own.agg(F.coalesce(F.sum("metric_rows"), F.lit(0)).alias("n")).first().n)
            self._compare("relations", given[1].get["n"], back.count())
            files.replace_text(self.spark, f"{self.path}/current", name)
        except Exception:
            files.delete(self.spark, target)
            raise
        self._forget_old()
        return target

    def _publish_whole(self, relations: DataFrame, metrics: DataFrame, ids: DataFrame) -> str:
        stored = self.read().metrics
        others = stored.join(ids, "unique_id", "left_anti").join(relations.select("unique_id"), "unique_id", "left_semi")
        return self.write(relations, others.unionByName(metrics.select(*stored.columns)))

    @staticmethod
    def _compare(what: str, given: int, read: int) -> None:
        if given != read:
            raise StorageError(f"{given} {what} were written, {read} can be read back")

    def _forget_old(self) -> None:
        """Keep the newest generations and the metric tables that they name; a folder that cannot be deleted is left alone."""
        root = f"{self.path}/generations"
        names = files.folder_names(self.spark, root)
        numbered = sorted((n for n in names if n.startswith("gen-") and n[4:].isdigit()), key=lambda n: int(n[4:]))
        try:
            shared = {
                r.part for name in numbered[-self.keep:] if files.exists(self.spark, f"{root}/{name}/{PARTS}")
                for r in _parts(self.spark, f"{root}/{name}").select("part").distinct().collect()
            }
            for name in numbered[:-self.keep]:
                for unused in [f"{name}/{MODELS}", f"{name}/{PARTS}"] if name in shared else [name]:
                    files.delete(self.spark, f"{root}/{unused}")
        except Exception:  # noqa: BLE001 - best effort
            pass

    def scratch(self) -> str:
        """A new folder for intermediate tables."""
        return f"{files.scratch_root(self.spark, self.path + '/scratch')}/profile-{uuid4().hex}"


def read_tables(spark: SparkSession, folder: str) -> Snapshot:
    """Read a pair of stored tables of this or an older format."""
    models, metrics = _tables(spark, folder)
    current = _is_current(models, metrics)
    relations = _read_models(models, current)
    return Snapshot(relations.orderBy("name", "unique_id"), _read_metrics(models, metrics, current))


def read_models(spark: SparkSession, folder: str) -> DataFrame:
    """Relations of a pair of stored tables."""
    models, metrics = _tables(spark, folder)
    return _read_models(models, _is_current(models, metrics, check_metrics=False))


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/{MODELS}"), _metric_table(spark, folder)


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    """For every relation with metric rows, the generation whose table holds them."""
    if files.exists(spark, f"{folder}/{PARTS}"):
        return spark.read.schema(PARTS_SCHEMA).parquet(f"{folder}/{PARTS}")
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    return spark.read.parquet(f"{folder}/{METRICS}").groupBy("unique_id").agg(F.count(F.lit(1)).alias("metric_rows")).select(
        "unique_id", F.lit(name).alias("part"), "metric_rows")


def _metric_table(spark: SparkSession, folder: str, unique_id: str | None = None) -> DataFrame:
    """The metric rows of a generation, or of one of its relations, from the tables that hold them."""
    if not files.exists(spark, f"{folder}/{PARTS}"):
        whole = spark.read.parquet(f"{folder}/{METRICS}")
        return whole if unique_id is None else whole.where(F.col("unique_id") == unique_id)
    root, parts = folder.rstrip("/").rsplit("/", 1)[0], _parts(spark, folder)
    if unique_id is not None:
        found = parts.where(F.col("unique_id") == unique_id).first()
        name = found.part if found else folder.rstrip("/").rsplit("/", 1)[-1]
        return spark.read.schema(STORED_METRICS).parquet(f"{root}/{name}/{METRICS}").where(F.col("unique_id") == unique_id)
    # At most MAX_PARTS names come to the driver.
    names = sorted({r.part for r in parts.select("part").distinct().collect()} | {folder.rstrip("/").rsplit("/", 1)[-1]})
    tables = [
        spark.read.schema(STORED_METRICS).parquet(f"{root}/{name}/{METRICS}").withColumn("_part", F.lit(name)) for name in names
    ]
    owners = parts.select("unique_id", F.col("part").alias("_part"))
    return reduce(DataFrame.unionByName, tables).join(owners, ["unique_id", "_part"], "left_semi").drop("_part")


def _read_metrics(models: DataFrame, metrics: DataFrame, current: bool) -> DataFrame:
    """Metric rows of ``models`` in today's columns, in order."""
    if not current:
        # Before versions metric rows carried the relation's name, which _read_models found unique.
        metrics = metrics.drop("unique_id").join(models.select("model_name", "unique_id"), "model_name")
    return _upgrade_metrics(metrics).orderBy("unique_id", "profile_order", "column_order")


def _is_current(models: DataFrame, metrics: DataFrame, check_metrics: bool = True) -> bool:
    """Check the schema versions; False for the format that had none."""
    versioned = ["schema_version" in df.columns for df in (models, metrics)]
    if versioned[0] != versioned[1]:
        raise StorageError("relations and metric rows are of inconsistent formats: only one of the tables states a version")
    if versioned[0]:
        for df in (models, metrics) if check_metrics else (models,):
            _check_version(df)
        if "unique_id" not in metrics.columns:
            raise StorageError("the metric rows state a version but have no unique_id")
    return versioned[0]


def _check_version(df: DataFrame) -> None:
    # Row groups whose statistics hold the known version only are not even read.
    other = (F.col("schema_version") != SCHEMA_VERSION) | F.col("schema_version").isNull()
    if df.where(other).limit(1).count():
        raise StorageError(f"results are stored in an unsupported version; this library reads version {SCHEMA_VERSION}")


def _read_models(models: DataFrame, current: bool) -> DataFrame:
    missing = {
        "profile_version": F.lit(1),
        "upstream_ids_json": F.lit("[]"),
        "profiling_json": F.lit("{}"),
    }
    filled = models.withColumns({n: v for n, v in missing.items() if n not in models.columns})
    if duplicates(filled, "unique_id"):
        raise StorageError("duplicate relation unique_id among the relations to store or read")
    if not current and duplicates(filled, "model_name"):
        raise StorageError("results without a version have ambiguous model names; import the relations into another folder and run again")
    return decode_relations(filled)


def _upgrade_metrics(metrics: DataFrame) -> DataFrame:
    """Fill in the columns older results do not have."""
    has_missing = {"empty_string_count", "missing_count", "missing_rate"} <= set(metrics.columns)
    added: dict[str, Column] = {}
    if not has_missing:
        added = {
            "empty_string_count": F.lit(0).cast("bigint"),
            "missing_count": F.col("null_count"),
            "missing_rate": F.col("null_rate"),
        }
    if "distinct_ratio" not in metrics.columns:
        added["distinct_ratio"] = rate(F.col("distinct_count"), F.col("record_count"))
    upgraded = metrics.withColumns(added) if added else metrics
    return upgraded.select(*[c for c in STORED_METRIC_COLUMNS if c != "schema_version"])


def stored_metrics(metrics: DataFrame) -> DataFrame:
    """Metric rows in the stored columns and types."""
    typed = (part.strip().split(" ") for part in STORED_METRICS.split(","))
    return metrics.withColumn("schema_version", F.lit(SCHEMA_VERSION)).select(
        *[F.col(name).cast(kind).alias(name) for name, kind in typed]
    )


def _with_columns(relations: DataFrame, metrics: DataFrame) -> DataFrame:
    """Relations without declared columns take them from their first slice; the metrics are read only if there are such."""
    lacking = relations.where(~F.coalesce(F.size("columns") > 0, F.lit(False))).select("unique_id")
    if lacking.isEmpty():
        return relations
    metrics = metrics.join(lacking, "unique_id", "left_semi")
    first = metrics.groupBy("unique_id").agg(F.min("profile_order").alias("profile_order"))
    found = (
        metrics.join(first, ["unique_id", "profile_order"])
        .groupBy("unique_id")
        .agg(F.array_sort(F.collect_list(F.struct("column_order", "column_name", "column_type", "column_description"))).alias("_found"))
    )
    listed = F.transform("_found", lambda c: F.struct(
        c["column_name"].alias("name"), c["column_type"].alias("data_type"), c["column_description"].alias("description")
    ))
    declared = F.col("columns")
    return relations.join(found, "unique_id", "left").withColumn(
        "columns", F.when(F.size(declared) > 0, declared).otherwise(F.coalesce(listed, declared))
    ).drop("_found")


def duplicates(df: DataFrame, key: str) -> bool:
    """Whether a key occurs more than once."""
    return df.groupBy(key).count().where("count > 1").limit(1).count() > 0


def stage_slices(metrics: DataFrame, folder: str) -> None:
    """Write one relation's metric rows to ``folder`` in slice order, each with its place.

    Slices of a dimension can be many, so they are not numbered in a window over the relation: rows
    are range-partitioned and sorted, and keep their partition and place for ``number_slices``. The
    rows of a slice stay in one partition.
    """
    order = [F.col("dimension_order"), F.coalesce("dimension_value", F.lit("")), F.col("dimension_value").isNotNull()]
    (
        metrics.repartitionByRange(*order)
        .sortWithinPartitions(*order, "column_order")
        .withColumn("_row", F.monotonically_increasing_id())
        .write.parquet(folder)
    )


def number_slices(staged: DataFrame) -> DataFrame:
    """Staged rows of any number of relations with their slices numbered from 0 in order."""
    placed = staged.withColumns({
        "_part": F.shiftright("_row", 33),
        "_place": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)),
    })
    # One row per relation and written partition, whatever the number of slices.
    sizes = placed.groupBy("unique_id", "_part").agg(
        F.count(F.lit(1)).alias("_rows"), (F.max("column_order") + 1).alias("_columns")
    )
    before = sizes.withColumn(
        "_before", F.expr("sum(_rows) OVER (PARTITION BY unique_id ORDER BY _part) - _rows")
    ).drop("_rows")
    position = F.expr("(_before + _place) DIV _columns").cast("int")
    return placed.join(before, ["unique_id", "_part"]).withColumn("profile_order", position).drop(
        "_row", "_part", "_place", "_before", "_columns"
    )
