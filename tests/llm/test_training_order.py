"""Both ways of writing shards: from a second scan, and from records written with their bytes."""

import zlib

from pyspark.sql import functions as F

from colmetry.llm import training_order


def read_back(spark, out, manifest, layout):
    rows = manifest.orderBy("record").collect()
    records = {r["slot"]: bytes(r["ids"]) for r in training_order.read_shards(spark, out, layout).collect()}
    assert sorted(records) == list(range(layout.records)) == [r["record"] for r in rows]
    assert all(zlib.crc32(records[r["slot"]]) == r["crc32"] for r in rows)
    return b"".join(records[r["slot"]][:-1] for r in rows).replace(b"\xfe", b"").split(b"\xff")[:-1]


def documents(spark, path):
    spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.repeat(F.col("id").cast("string"), 20)).alias(
        "text")).repartition(6).write.parquet(path)
    return spark.read.parquet(path)


def test_a_scan_is_cut_twice_and_its_bytes_are_not_staged(spark, tmp_path, monkeypatch):
    docs, staged = documents(spark, str(tmp_path / "docs")), []
    own = training_order.stage
    monkeypatch.setattr(training_order, "stage", lambda df: staged.append(df.columns) or own(df))
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    stream = read_back(spark, str(tmp_path / "out"), *training_order.materialise(docs, str(tmp_path / "out"), length=64, slots=32))
    assert sorted(stream) == sorted(r["text"].encode() for r in docs.collect())
    assert len(staged) == 1 and "payload" not in staged[0] and spark.conf.get("spark.sql.files.minPartitionNum", None) == before


def test_other_partitions_in_the_second_pass_are_noticed(spark, tmp_path, monkeypatch):
    docs, staged = documents(spark, str(tmp_path / "docs")), []
    other = spark.read.parquet(str(tmp_path / "docs")).repartition(3).sortWithinPartitions("doc_id")
    own, texts = training_order.stage, training_order._texts
    monkeypatch.setattr(training_order, "stage", lambda df: staged.append(df.columns) or own(df))
    # The second of the three times that texts are read, their partitions are others, or one is left out.
    for k, changed in enumerate((other, docs.where("doc_id < 200"))):
        times = iter([docs, changed, docs])
        monkeypatch.setattr(training_order, "_texts", lambda _: texts(next(times)))
        out = str(tmp_path / f"out{k}")
        stream = read_back(spark, out, *training_order.materialise(docs, out, length=64, slots=32))
        assert sorted(stream) == sorted(r["text"].encode() for r in docs.collect())
    assert ["payload" in columns for columns in staged] == [False, True] * 2


def test_rows_behind_a_shuffle_are_written_once(spark, tmp_path, monkeypatch):
    docs, staged = documents(spark, str(tmp_path / "docs")).repartition(5), []
    own = training_order.stage
    monkeypatch.setattr(training_order, "stage", lambda df: staged.append(df.columns) or own(df))
    stream = read_back(spark, str(tmp_path / "out"), *training_order.materialise(docs, str(tmp_path / "out"), length=64, slots=32))
    assert sorted(stream) == sorted(r["text"].encode() for r in docs.collect())
    assert len(staged) == 1 and "payload" in staged[0]
