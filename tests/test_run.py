import json
import os

import pytest
from pyspark.sql import functions as F

from colmetry import (
    AmbiguousError, ProfileError, SnapshotStore, import_relations, ingest_artifacts, run, run_results, run_summary,
)
from colmetry.sources import artifacts


def node(name, columns, profiling=None, **more):
    return {
        "unique_id": f"model.shop.{name}", "resource_type": "model", "package_name": "shop", "name": name, "alias": name,
        "database": "", "schema": "", "description": "", "columns": columns, "depends_on": {"nodes": []},
        "config": {"materialized": "table", "tags": [], "meta": {"profiling": profiling} if profiling else {}}, **more,
    }


EVENT_COLUMNS = {
    "day": {"data_type": "date"}, "kind": {"data_type": "string", "description": "what"}, "amount": {"data_type": "integer"},
    "payload": {"data_type": "json"},
}


def write_project(folder, events=None, orders=None, **metadata):
    nodes = [
        node("events", EVENT_COLUMNS, {"enabled": True, "dimensions": ["kind", "day"], "max_dimension_values": 2, **(events or {})}),
        node("orders", {"id": {"data_type": "integer"}}, {"enabled": True, **(orders or {})}),
        node("idle", {"id": {"data_type": "integer"}}),
        {**node("foreign", {}), "unique_id": "model.other.foreign", "package_name": "other"},
    ]
    target = os.path.join(folder, "target")
    os.makedirs(target, exist_ok=True)
    manifest = {"metadata": {"project_name": "shop", "generated_at": "2026-09-02T00:00:00Z", **metadata},
                "nodes": {n["unique_id"]: n for n in nodes}, "sources": {}}
    with open(os.path.join(target, "manifest.json"), "w") as file:
        json.dump(manifest, file)
    return folder


@pytest.fixture()
def project(tmp_path):
    return write_project(str(tmp_path / "project"))


@pytest.fixture()
def store(spark, tmp_path, project):
    made = SnapshotStore(spark, str(tmp_path / "store"))
    import_relations(made, ingest_artifacts(spark, project))
    return made


@pytest.fixture()
def tables(spark):
    frames = {
        "events": spark.createDataFrame(
            [("2026-09-01", "a", 1), ("2026-09-01", "b", 2), ("2026-09-02", "c", None), (None, None, 4)], "day string, kind string, amount int"
        ).withColumns({"day": F.to_date("day"), "payload": F.array("kind")}),
        "orders": spark.range(5).toDF("id"),
    }
    return lambda _spark, relation: frames[relation.name]


def outcomes(result):
    return [(t.name, t.dimension, t.status) for t in result.tasks]


def test_artifacts_are_imported(store):
    found = {r.name: r for r in store.read().relations.collect()}
    assert set(found) == {"events", "orders", "idle"}
    assert [(c.name, c.data_type) for c in found["events"].columns] == [
        ("day", "DATE"), ("kind", "STRING"), ("amount", "INT64"), ("payload", "JSON")]
    assert found["events"].profiled_at is None and found["idle"].profiling.enabled is False


def test_run_publishes_all_enabled_relations(store, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "scratch", lambda: str(tmp_path / "scratch"), raising=False)
    result = run(store, read=tables)
    assert result.published and result.location.endswith("gen-0002")
    assert outcomes(result) == [
        ("events", None, "succeeded"), ("events", "kind", "skipped"), ("events", "day", "succeeded"), ("orders", None, "succeeded")]
    skip = result.tasks[1]
    assert (skip.skip_reason, skip.distinct_values, skip.maximum_allowed) == ("max_dimension_values", 3, 2)
    assert [t.row_count for t in result.tasks] == [3, 0, 9, 1]
    snapshot = store.read()
    events = snapshot.metrics.where("unique_id = 'model.shop.events'").collect()
    assert [(r.profile_order, r.dimension_value) for r in events if r.column_order == 0] == [
        (0, None), (1, None), (2, "2026-09-01"), (3, "2026-09-02")]
    assert {r.column_description for r in events if r.column_name == "kind"} == {"what"}
    relations = {r.name: r for r in snapshot.relations.collect()}
    assert relations["events"].profile_version == 4 and relations["events"].profiled_at == relations["orders"].profiled_at
    assert relations["idle"].profiled_at is None
    assert not os.path.exists(tmp_path / "scratch")


def test_threads_give_the_same_result(store, tables):
    run(store, read=tables)
    once = store.read().metrics.collect()
    assert run(store, read=tables, threads=3).published
    assert store.read().metrics.collect() == once
    with pytest.raises(ProfileError):
        run(store, read=tables, threads=0)


def test_selected_relation_replaces_only_its_own_results(store, tables, spark):
    run(store, read=tables)
    before = {r.name: r.profiled_at for r in store.read().relations.collect()}
    result = run(store, select="orders", read=lambda s, r: spark.range(9).toDF("id"))
    after = {r.name: r.profiled_at for r in store.read().relations.collect()}
    assert {t.name for t in result.tasks} == {"orders"}
    assert after["events"] == before["events"] and after["orders"] > before["orders"]
    assert store.read_relation("orders").metrics.first().record_count == 9
    assert store.read_relation("events").metrics.count() == 12


def test_selectors(store, tables, spark):
    with pytest.raises(ProfileError, match="did not match"):
        run(store, select="idle", read=tables)
    snapshot = store.read()
    store.write(snapshot.relations.withColumn("name", F.lit("same")), snapshot.metrics)
    with pytest.raises(AmbiguousError):
        run(store, select="same", read=tables)
    store.write(snapshot.relations.withColumn("profiling", F.col("profiling").withField("enabled", F.lit(False))), snapshot.metrics)
    with pytest.raises(ProfileError, match="no relations"):
        run(store, read=tables)


def test_failing_relation_leaves_the_store_unchanged(store, tables, spark):
    def broken(session, relation):
        if relation.name == "orders":
            return session.range(3).select(F.expr("if(id = 2, raise_error('no'), id)").cast("bigint").alias("id"))
        return tables(session, relation)

    result = run(store, read=broken)
    assert not result.published and store.generation() == 1
    assert [t.status for t in result.tasks] == ["succeeded", "skipped", "succeeded", "failed"]
    first = run(store, read=lambda s, r: broken(s, r) if r.name == "orders" else s.range(1).select(
        F.to_date(F.lit("2026-01-01")).alias("day"), F.raise_error(F.lit("x")).cast("string").alias("kind"), F.lit(1).alias("amount"), F.array().alias("payload")))
    assert [t.status for t in first.tasks] == ["failed", "skipped", "skipped", "skipped"]
    assert "earlier item" in first.tasks[1].error and "another relation" in first.tasks[3].error
    assert store.generation() == 1


@pytest.mark.parametrize("column, table", [("missing", None), ("id", "double")])
def test_unreadable_table_is_a_failed_task(store, tables, column, table):
    def read(session, relation):
        if relation.name == "orders":
            return session.table("no_such_table") if table is None else session.range(3).select(F.col("id").cast(table))
        return tables(session, relation)

    result = run(store, read=read)
    assert not result.published and store.generation() == 1
    assert [t.status for t in result.tasks] == ["skipped", "skipped", "skipped", "failed"]
    assert "no_such_table" in result.tasks[3].error if table is None else "'id' is declared as INT64 but holds double" in result.tasks[3].error
    assert run_results(store).where("status = 'failed'").count() == 1


def test_scan_estimate_is_the_size_of_the_selected_files(spark, tmp_path):
    from colmetry.sources.files import scanned_bytes

    def size(folder):
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))

    path = str(tmp_path / "grown")
    spark.range(10).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(path)
    assert scanned_bytes(spark.read.parquet(path).where("id > 3")) == size(path)
    assert scanned_bytes(spark.read.parquet(path).where("p = 1")) == size(path + "/p=1")
    assert scanned_bytes(spark.range(3)) is None
    spark.sql(f"CREATE TABLE grown_table USING parquet LOCATION '{tmp_path / 'table'}' AS SELECT id FROM range(5)")
    spark.sql("ANALYZE TABLE grown_table COMPUTE STATISTICS FOR ALL COLUMNS")
    spark.range(100_000).write.mode("append").parquet(str(tmp_path / "table"))
    spark.sql("REFRESH TABLE grown_table")
    spark.conf.set("spark.sql.cbo.enabled", "true")
    try:
        assert scanned_bytes(spark.table("grown_table")) == size(str(tmp_path / "table"))
    finally:
        spark.conf.unset("spark.sql.cbo.enabled")
        spark.sql("DROP TABLE grown_table")


def test_unusable_dimension_aborts_the_plan(spark, tmp_path, tables):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    import_relations(store, ingest_artifacts(spark, write_project(str(tmp_path / "p"), events={"dimensions": ["amount"]})))
    with pytest.raises(ProfileError, match="dimension must be"):
        run(store, read=tables)
    assert store.generation() == 1


@pytest.mark.parametrize("slack, published", [(0, True), (-1, False)])
def test_scan_limit_blocks_the_whole_run(spark, tmp_path, tables, slack, published):
    path = str(tmp_path / "events.parquet")
    tables(spark, type("R", (), {"name": "events"})).coalesce(1).write.parquet(path)
    size = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet"))
    store = SnapshotStore(spark, str(tmp_path / "s"))
    project = write_project(str(tmp_path / "p"), events={"max_bytes_billed": size * 3 + slack})
    import_relations(store, ingest_artifacts(spark, project))
    result = run(store, read=lambda s, r: s.read.parquet(path) if r.name == "events" else tables(s, r))
    assert result.published is published
    assert [t.estimated_bytes for t in result.tasks] == [size] * 3 + [None]
    if not published:
        assert {t.status for t in result.tasks} == {"skipped"} and store.generation() == 1
        assert "exceed" in result.tasks[0].error and "another relation" in result.tasks[3].error


def test_repeated_dimension_is_stored_twice(spark, tmp_path, tables):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    import_relations(store, ingest_artifacts(spark, write_project(str(tmp_path / "p"), events={"dimensions": ["day", "day"]})))
    result = run(store, select="events", read=tables)
    assert result.published and [t.row_count for t in result.tasks] == [3, 9, 9]
    assert store.read_relation("events").metrics.count() == 21


def test_reimport_keeps_results_that_still_hold(spark, store, tables, tmp_path, project):
    run(store, read=tables)

    def again(**changes):
        write_project(project, **changes)
        import_relations(store, ingest_artifacts(spark, project))
        snapshot = store.read()
        stamped = {r.name: r.profiled_at is not None for r in snapshot.relations.collect()}
        counted = {r.unique_id.split(".")[-1]: r["count"] for r in snapshot.metrics.groupBy("unique_id").count().collect()}
        assert {n for n, yes in stamped.items() if yes} == set(counted)
        return set(counted)

    assert again() == {"events", "orders"}
    assert again(events={"enabled": False, "max_bytes_billed": "2 GB"}) == {"events", "orders"}
    assert again(events={"where": "amount > 1"}) == {"orders"}
    assert again(orders={"treat_empty_string_as_null": True}) == set()


def test_older_computation_is_not_carried(spark, store, tables, project):
    run(store, read=tables)
    snapshot = store.read()
    store.write(snapshot.relations.withColumn("profile_version", F.lit(3)), snapshot.metrics)
    import_relations(store, ingest_artifacts(spark, project))
    assert store.read().metrics.count() == 0


def test_run_history(store, tables, spark):
    run(store, read=tables)
    run(store, select="orders", read=tables)
    rows = run_results(store)
    assert rows.count() == 5
    summary = {(r.relations, r.succeeded, r.skipped, r.failed) for r in run_summary(rows).collect()}
    assert summary == {(2, 3, 1, 0), (1, 1, 0, 0)}


def test_tables_are_read_by_relation_name(spark, tmp_path):
    from colmetry.plans.run import read_table

    spark.range(4).toDF("id").createOrReplaceTempView("orders_view")
    row = spark.sql("SELECT '`orders_view`' AS relation_name, '' AS database, '' AS schema, 'x' AS name").first()
    assert read_table(spark, row).count() == 4
    spark.sql("CREATE DATABASE IF NOT EXISTS shop_raw")
    spark.range(6).toDF("id").write.mode("overwrite").saveAsTable("shop_raw.orders")
    named = spark.sql("SELECT '`spark_catalog.shop_raw.orders`' AS relation_name, '' AS database, '' AS schema, 'x' AS name").first()
    blank = spark.sql("SELECT '' AS relation_name, 'spark_catalog' AS database, 'shop_raw' AS schema, 'orders' AS name").first()
    assert read_table(spark, named).count() == 6 and read_table(spark, blank).count() == 6


def test_many_projects_in_one_read(spark, tmp_path):
    for name in ("a", "b"):
        write_project(str(tmp_path / name))
    catalog = {"metadata": {"generated_at": "2026-09-01T00:00:00Z"}, "sources": {}, "nodes": {
        "model.shop.orders": {"columns": {"extra": {"type": "TIMESTAMP", "index": 1}, "id": {"type": "bigint", "index": 2}}}}}
    (tmp_path / "b" / "target" / "catalog.json").write_text(json.dumps(catalog))
    manifests, catalogs = artifacts.read_manifests(spark, str(tmp_path)), artifacts.read_catalogs(spark, str(tmp_path))
    stale = {os.path.basename(r.project): r.catalog_stale for r in artifacts.projects(manifests, catalogs).collect()}
    assert stale == {"a": False, "b": True}
    rows = artifacts.relations(manifests, catalogs).where("name = 'orders'").collect()
    assert {os.path.basename(r.project): [(c.name, c.data_type) for c in r.columns] for r in rows} == {
        "a": [("id", "INT64")], "b": [("extra", "TIMESTAMP"), ("id", "BIGINT")]}


def test_broken_artifacts_raise(spark, tmp_path):
    folder = write_project(str(tmp_path / "p"), project_name=None)
    with pytest.raises(Exception, match="project_name is missing"):
        ingest_artifacts(spark, folder).collect()
    write_project(folder)
    with open(os.path.join(folder, "target", "catalog.json"), "w") as file:
        file.write("{nope")
    with pytest.raises(Exception):
        ingest_artifacts(spark, folder).collect()
    with pytest.raises(Exception):
        ingest_artifacts(spark, str(tmp_path / "nowhere")).collect()


@pytest.mark.parametrize("setting", [{"where": "  "}, {"where": True}, {"where": 5}, {"max_dimension_values": 0}, {"max_bytes_billed": "5 XB"}, {"max_bytes_billed": "0"}])
def test_wrong_settings_raise(spark, tmp_path, setting):
    folder = write_project(str(tmp_path / "p"), events=setting)
    with pytest.raises(Exception, match=list(setting)[0]):
        ingest_artifacts(spark, folder).collect()
