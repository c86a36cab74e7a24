import json
import os

import pytest
from pyspark.sql import functions as F

from colmetry import AmbiguousError, NotFoundError, SnapshotStore, StorageError, read_json_catalog
from colmetry.sources import snapshots
from colmetry.sources.snapshots import Snapshot, read_tables


def column(name, kind, **metrics):
    return {"name": name, "data_type": kind, "null_count": 1, "null_rate": 0.1, **metrics}


RELATIONS = [
    {
        "unique_id": "model.demo.events", "name": "events", "database": "db", "schema_name": "raw", "materialization": "table",
        "tags": ["a"], "tests": ["unique"], "upstream_ids": ["source.demo.raw"], "profiled_at": "2026-09-01T00:00:00+09:00",
        "profile_version": 4, "profiling": {"enabled": True, "dimensions": ["event_date"], "max_bytes_billed": 1000},
        "profiles": [
            {"record_count": 10, "columns": [column("category", "string", distinct_count=2), column("amount", "float", min_value=1.5, max_value="")]},
            {"dimension_name": "event_date", "dimension_value": None, "record_count": 6, "columns": [
                column("category", "STRING", distinct_count=0, distinct_ratio=0.0), column("amount", "FLOAT64")]},
            {"dimension_name": "event_date", "dimension_value": "line1\nline2,\"x\"", "record_count": 4, "columns": [
                column("category", "STRING", distinct_count=1, description="é"), column("amount", "FLOAT64")]},
        ],
    },
    {"name": "bare", "database": "db", "schema": "raw", "materialization": "view"},
]


@pytest.fixture()
def catalog(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(RELATIONS))
    return read_json_catalog(spark, str(path))


@pytest.fixture()
def store(spark, tmp_path, catalog):
    made = SnapshotStore(spark, str(tmp_path / "store"))
    made.write(catalog.relations, catalog.metrics)
    return made


def test_json_catalog_defaults(catalog):
    rows = {r.unique_id: r for r in catalog.relations.collect()}
    assert set(rows) == {"model.demo.events", "model.db.raw.bare"}
    assert rows["model.demo.events"].profiling.max_bytes_billed == 1000 and rows["model.db.raw.bare"].profiling.enabled is False
    first = catalog.metrics.orderBy("profile_order", "column_order").first()
    assert (first.column_type, first.missing_count, first.missing_rate, first.distinct_ratio) == ("STRING", 1, 0.1, 0.2)


def test_malformed_json_raises(spark, tmp_path):
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(Exception):
        read_json_catalog(spark, str(tmp_path / "bad.json")).relations.collect()


def test_round_trip_keeps_null_empty_and_special_text(store, catalog):
    back = store.read()
    order = ["unique_id", "profile_order", "column_order"]
    assert back.metrics.collect() == catalog.metrics.orderBy(*order).collect()
    rows = back.metrics.collect()
    assert rows[1].max_value == "" and rows[0].max_value is None
    assert [r.dimension_value for r in rows if r.column_order == 0] == [None, None, 'line1\nline2,"x"']
    relation = {r.unique_id: r for r in back.relations.collect()}["model.demo.events"]
    assert relation.profiled_at == "2026-09-01T00:00:00+09:00" and relation.upstream_ids == ["source.demo.raw"]


def test_columns_come_from_the_first_slice_when_none_are_declared(store):
    found = {r.name: r.columns for r in store.read_relations().collect()}
    assert [(c.name, c.data_type) for c in found["events"]] == [("category", "STRING"), ("amount", "FLOAT64")]
    assert found["bare"] == []


def test_single_relation(store, spark, catalog):
    assert store.read_relation("events").metrics.count() == 6
    assert store.read_relation("model.db.raw.bare").metrics.count() == 0
    with pytest.raises(NotFoundError):
        store.read_relation("nothing")
    both = store.read().relations.withColumn("name", F.lit("same"))
    store.write(both, store.read().metrics)
    with pytest.raises(AmbiguousError):
        store.read_relation("same")
    assert store.read_relation("model.demo.events").relations.first().name == "same"


def test_generations_are_kept_and_forgotten(store, tmp_path):
    for _ in range(4):
        snapshot = store.read()
        store.write(snapshot.relations, snapshot.metrics)
    names = sorted(os.listdir(tmp_path / "store" / "generations"))
    assert names == ["gen-0003", "gen-0004", "gen-0005"] and store.generation() == 5
    assert (tmp_path / "store" / "current").read_text() == "gen-0005"
    with pytest.raises(ValueError):
        SnapshotStore(store.spark, "x", keep=1)


def test_failed_write_leaves_the_old_generation(store, tmp_path, catalog):
    doubled = catalog.relations.unionByName(catalog.relations)
    with pytest.raises(StorageError, match="duplicate relation unique_id"):
        store.write(doubled, catalog.metrics)
    orphan = catalog.metrics.withColumn("unique_id", F.lit("model.unknown"))
    with pytest.raises(StorageError, match="belong to no relation"):
        store.write(catalog.relations, orphan)
    assert os.listdir(tmp_path / "store" / "generations") == ["gen-0001"] and store.generation() == 1
    os.mkdir(tmp_path / "store" / "generations" / "gen-0002")
    with pytest.raises(StorageError, match="exists"):
        store.write(catalog.relations, catalog.metrics)
    assert os.path.isdir(tmp_path / "store" / "generations" / "gen-0002")


@pytest.mark.parametrize("lost", ["metrics", "relations"])
def test_short_write_is_refused(store, catalog, monkeypatch, lost):
    def short(spark, folder):
        whole = read_tables(spark, folder)
        if lost == "metrics":
            return Snapshot(whole.relations, whole.metrics.limit(5))
        return Snapshot(whole.relations.where("name = 'events'"), whole.metrics)

    monkeypatch.setattr(snapshots, "read_tables", short)
    with pytest.raises(StorageError, match="can be read back"):
        store.write(catalog.relations, catalog.metrics)
    assert store.generation() == 1


def test_lookup_reads_one_relation_in_stored_order(store, spark):
    plan = store.read_relation("events").metrics._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(unique_id,model.demo.events)" in plan
    rows = spark.read.parquet(f"{store.location()}/column_profiles.parquet").select("profile_order", "column_order").collect()
    assert rows == sorted(rows) and len(rows) == 6


def test_plain_folder_is_read_until_the_first_generation(spark, store, tmp_path):
    plain = str(tmp_path / "plain")
    for name in ("models", "column_profiles"):
        spark.read.parquet(f"{store.location()}/{name}.parquet").write.parquet(f"{plain}/{name}.parquet")
    direct = SnapshotStore(spark, plain)
    assert direct.exists() and direct.read().metrics.count() == 6
    direct.write(direct.read().relations, direct.read().metrics)
    assert direct.generation() == 1 and direct.read().metrics.count() == 6


def test_half_present_storage_is_an_error(spark, store, tmp_path):
    half = str(tmp_path / "half")
    spark.read.parquet(f"{store.location()}/models.parquet").write.parquet(f"{half}/models.parquet")
    with pytest.raises(StorageError, match="both tables"):
        SnapshotStore(spark, half).exists()
    assert not SnapshotStore(spark, str(tmp_path / "none")).exists()
    with pytest.raises(StorageError, match="no profile storage"):
        SnapshotStore(spark, str(tmp_path / "none")).read()
    (tmp_path / "lost").mkdir()
    (tmp_path / "lost" / "current").write_text("gen-0007")
    with pytest.raises(StorageError, match="missing"):
        SnapshotStore(spark, str(tmp_path / "lost")).read()


def rewritten(spark, store, folder, models=lambda df: df, metrics=lambda df: df):
    models(spark.read.parquet(f"{store.location()}/models.parquet")).write.parquet(f"{folder}/models.parquet")
    metrics(spark.read.parquet(f"{store.location()}/column_profiles.parquet")).write.parquet(f"{folder}/column_profiles.parquet")
    return str(folder)


@pytest.mark.parametrize("side", ["models", "metrics"])
def test_unknown_versions_are_refused(spark, store, tmp_path, side):
    folder = rewritten(spark, store, tmp_path / "v", **{side: lambda df: df.withColumn("schema_version", F.lit(99))})
    with pytest.raises(StorageError, match="unsupported"):
        read_tables(spark, folder)


def test_versions_must_agree_and_need_unique_ids(spark, store, tmp_path):
    one = rewritten(spark, store, tmp_path / "one", metrics=lambda df: df.drop("schema_version"))
    with pytest.raises(StorageError, match="inconsistent"):
        read_tables(spark, one)
    no_id = rewritten(spark, store, tmp_path / "two", metrics=lambda df: df.drop("unique_id"))
    with pytest.raises(StorageError, match="unique_id"):
        read_tables(spark, no_id)


def test_versionless_results_need_unique_names(spark, store, tmp_path):
    def named(df):
        return df.join(spark.read.parquet(f"{store.location()}/models.parquet").select("unique_id", "model_name"), "unique_id").drop(
            "unique_id", "schema_version", "distinct_ratio")

    old = rewritten(spark, store, tmp_path / "old", models=lambda df: df.drop("schema_version"), metrics=named)
    read = read_tables(spark, old)
    assert read.metrics.count() == 6 and read.metrics.where("column_name = 'category'").first().distinct_ratio == 0.2
    twice = rewritten(spark, store, tmp_path / "twice", metrics=named, models=lambda df: df.drop("schema_version").withColumn("model_name", F.lit("same")))
    with pytest.raises(StorageError, match="ambiguous model names"):
        read_tables(spark, twice)


def many(spark, count, rows=40):
    """Relations with some metric rows each."""
    one = json.dumps({**RELATIONS[0], "unique_id": "ID", "name": "ID"})
    texts = [one.replace("ID", f"r{k:03d}") for k in range(count)]
    return "[" + ",".join(texts) + "]"


def size_of(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def test_a_run_writes_its_own_relations_only(spark, tmp_path):
    sizes = []
    for count in (4, 60):
        path = tmp_path / f"catalog{count}.json"
        path.write_text(many(spark, count))
        given = read_json_catalog(spark, str(path))
        store = SnapshotStore(spark, str(tmp_path / f"store{count}"))
        store.write(given.relations, given.metrics)
        before = {tuple(r) for r in store.read().metrics.collect()}
        ran = given.metrics.where("unique_id = 'r001'").withColumn("null_count", F.lit(7).cast("bigint"))
        folder = store.publish(given.relations, ran, ran.select("unique_id"))
        sizes.append(size_of(f"{folder}/{snapshots.METRICS}"))
        after = {tuple(r) for r in store.read().metrics.collect()}
        assert {r for r in after if r[0] != "r001"} == {r for r in before if r[0] != "r001"} and len(after) == len(before)
        assert {r["null_count"] for r in store.read_relation("r001").metrics.collect()} == {7}
        assert store.read_relation("r002").metrics.count() == 6 and store.read_relations().count() == count
    assert sizes[0] == sizes[1]


def test_shared_tables_outlive_their_generation(spark, tmp_path, monkeypatch):
    path = tmp_path / "catalog.json"
    path.write_text(many(spark, 3))
    given = read_json_catalog(spark, str(path))
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.write(given.relations, given.metrics)
    generations = tmp_path / "store" / "generations"

    def run(name, value):
        rows = store.read().metrics.where(F.col("unique_id") == name).withColumn("null_count", F.lit(value).cast("bigint"))
        return store.publish(store.read_relations(), rows, rows.select("unique_id"))

    for value in range(2, 6):
        run("r000", value)
    assert sorted(os.listdir(generations)) == [f"gen-000{k}" for k in (1, 3, 4, 5)]
    assert not (generations / "gen-0001" / "models.parquet").exists()
    found = {r.unique_id: r.null_count for r in store.read().metrics.collect()}
    assert found == {"r000": 5, "r001": 1, "r002": 1}
    # Rows that were not profiled, or belong to no relation, are refused and leave the generation before.
    alien = given.metrics.where("unique_id = 'r002'")
    with pytest.raises(StorageError, match="not profiled"):
        store.publish(given.relations, alien, given.relations.where("unique_id = 'r001'"))
    with pytest.raises(StorageError, match="belong to no relation"):
        store.publish(given.relations.where("unique_id <> 'r002'"), alien, alien.select("unique_id"))
    assert store.generation() == 5
    # A relation that is gone loses its rows, and too many parts are written into one.
    store.publish(given.relations.where("unique_id <> 'r001'"), alien.limit(0), alien.select("unique_id"))
    assert {r.unique_id for r in store.read().metrics.collect()} == {"r000"}
    monkeypatch.setattr(snapshots, "MAX_PARTS", 0)
    run("r000", 9)
    assert not (generations / "gen-0007" / snapshots.PARTS).exists() and {r.null_count for r in store.read().metrics.collect()} == {9}
