"""What storage and runs allow, refuse and record, one row per case."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from colmetry import SnapshotStore
from colmetry.plans.run import run, run_results
from colmetry.plans.tasks import enabled_relations
from colmetry.sources import files
from colmetry.sources.snapshots import read_tables
from suite.inputs import table
from suite.stored import customer_results, relations, scratch

QUERIES, SQL = {}, {}


def _listed(spark: SparkSession, cases: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(cases, "case_name string, outcome string")


def _refusal(action) -> str:
    """The name of the error that an action ends in."""
    try:
        action()
    except Exception as error:  # noqa: BLE001 - which one is the result
        return type(error).__name__
    return "allowed"


def store_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Duplicate and unknown relations, versions, retention, order, folders without generations."""
    base = scratch(spark)
    results = customer_results(spark, folder)
    metrics = files.staged(results.metrics.orderBy("unique_id").limit(20))
    named = files.staged(results.relations.join(metrics.select("unique_id"), "unique_id", "left_semi"))
    store = SnapshotStore(spark, f"{base}/store")
    plain = SnapshotStore(spark, f"{base}/plain")
    store.write(named, metrics)
    cases = [
        ("duplicate relation", _refusal(lambda: store.write(named.unionByName(named), metrics))),
        ("rows of no relation", _refusal(lambda: store.write(named, metrics.withColumn("unique_id", F.lit("other"))))),
        ("generation after refusals", str(store.generation())),
    ]
    first = store.location()
    models, stored = spark.read.parquet(f"{first}/models.parquet"), spark.read.parquet(f"{first}/column_profiles.parquet")
    other = f"{base}/other"
    models.write.parquet(f"{other}/models.parquet")
    stored.withColumn("schema_version", F.lit(99)).write.parquet(f"{other}/column_profiles.parquet")
    cases.append(("unknown version", _refusal(lambda: read_tables(spark, other))))
    for table_name, frame in (("models", models), ("column_profiles", stored)):
        frame.write.parquet(f"{base}/plain/{table_name}.parquet")
    cases.append(("plain folder", f"generation {plain.generation()}, {plain.read().metrics.count()} rows"))
    plain.write(plain.read().relations, plain.read().metrics)
    cases.append(("after its first write", f"generation {plain.generation()}, {plain.read().metrics.count()} rows"))
    for _ in range(3):
        store.publish(named, metrics, metrics.select("unique_id"))
    cases.append(("generations kept", ",".join(sorted(files.folder_names(spark, f"{base}/store/generations")))))
    lines = [(r.unique_id, r.profile_order, r.column_order) for r in store.read().metrics.collect()]
    cases.append(("metric rows in order", str(lines == sorted(lines) and len(lines) == 20)))
    return _listed(spark, cases)


def run_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Selection, scan limits, all or nothing, the instant and version of a run."""
    base = scratch(spark)

    def made(name: str, limit: str = "NULL", tables: tuple[str, ...] = ("region", "nation"), enabled: bool = True) -> SnapshotStore:
        rows = [(f"model.{t}", "model", t, "db", "raw", None) for t in tables]
        one = spark.createDataFrame(rows, "unique_id string, resource_type string, name string, database string, schema string, profiled_at string")
        found = relations(one, {n: n for n in one.columns}).withColumn("profiling", F.col("profiling").withField(
            "enabled", F.lit(enabled)).withField("max_bytes_billed", F.expr(f"IF(name = 'nation', CAST({limit} AS BIGINT), NULL)")))
        store = SnapshotStore(spark, f"{base}/{name}")
        store.write(found, customer_results(spark, folder).metrics.limit(0))
        return store

    def outcome(store: SnapshotStore) -> str:
        done = run(store, read=lambda session, relation: table(session, folder, relation.name))
        return f"{done.published}: " + ", ".join(f"{t.name} {t.status}" for t in done.tasks) + f"; generation {store.generation()}"

    sound = made("sound")
    enabled = sound.read_relations()
    began = datetime.now(UTC).isoformat()
    cases = [
        ("selector that names two", _refusal(lambda: enabled_relations(enabled.withColumn("name", F.lit("same")), "same"))),
        ("selector that names none", _refusal(lambda: enabled_relations(enabled, "customer"))),
        ("selector", str([r.name for r in enabled_relations(enabled, "model.nation").collect()])),
        ("nothing enabled", _refusal(lambda: run(made("idle", enabled=False)))),
        ("over its limit", outcome(made("limited", limit="1"))),
        ("within its limit", outcome(made("roomy", limit="1000000000"))),
        ("missing table", outcome(made("broken", tables=("region", "no_such_table")))),
        ("all sound", outcome(sound)),
    ]
    stored = sound.read_relations().collect()
    instants = {r.profiled_at for r in stored}
    cases += [
        ("one instant for a run", str(len(instants) == 1 and began <= min(instants) <= datetime.now(UTC).isoformat())),
        ("version", str(sorted({r.profile_version for r in stored}))),
        ("recorded", str([(r.name, r.status, r.row_count) for r in run_results(sound).orderBy("task_number").collect()])),
    ]
    return _listed(spark, cases)


def _sql(cases: dict[str, str], source: str) -> str:
    rows = ", ".join("('{}', '{}')".format(*(text.replace("'", "''") for text in case)) for case in cases.items())
    return f"SELECT case_name, outcome FROM (VALUES {rows}) AS t(case_name, outcome) WHERE EXISTS (SELECT 1 FROM {source})"


QUERIES["store_outcomes"] = store_outcomes
SQL["store_outcomes"] = _sql({
    "duplicate relation": "StorageError", "rows of no relation": "StorageError", "generation after refusals": "1",
    "unknown version": "StorageError", "plain folder": "generation 0, 20 rows", "after its first write": "generation 1, 20 rows",
    "generations kept": "gen-0002,gen-0003,gen-0004", "metric rows in order": "True",
}, "customer")
QUERIES["run_outcomes"] = run_outcomes
SQL["run_outcomes"] = _sql({
    "selector that names two": "AmbiguousError", "selector that names none": "ProfileError", "selector": "['nation']",
    "nothing enabled": "ProfileError",
    "over its limit": "False: nation skipped, region skipped; generation 1",
    "within its limit": "True: nation succeeded, region succeeded; generation 2",
    "missing table": "False: no_such_table failed, region skipped; generation 1",
    "all sound": "True: nation succeeded, region succeeded; generation 2",
    "one instant for a run": "True", "version": "[4]",
    "recorded": "[('nation', 'succeeded', 3), ('region', 'succeeded', 2)]",
}, "region")
