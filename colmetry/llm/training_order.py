"""Training-order materialisation: every sequence gets a global slot by a keyed permutation, and slots are written as fixed-stride shards.

The texts of a scan partition are turned into ids one after the other, each closed by the end id, and cut into records of ``length``
ids; a record is ``length - 1`` ids of the stream and the end id once more, the last record of a partition is filled with the fill id.
Records are numbered through all partitions, and a Feistel network over the next power of four, walked until the value is below the
number of records, maps numbers to slots one to one. A shard holds ``slots`` consecutive slots in order, so record s is in shard
s // slots at byte (s % slots) * stride: a reader can go on from any slot with one seek.

The payload of the records goes to the shards and nowhere else. A first pass over the scan cuts the records and writes all but their bytes,
with the partition and place they were cut in: numbers, layout and manifest come from that table. A second pass cuts them again and sends
each through one exchange to its shard's range. How files are split is pinned while both passes are planned, so it does not depend on the
executors at hand, and each partition of the second pass compares the number and a running check sum of its records with those of the
first; where they differ, and for ``documents`` that are no plain scan (there is an exchange in their plan), the records are written
once with their bytes and the shards come from that table. The bytes of the shards must be those of all records.
Shards go through Spark's text writer (the record end is its line end), so they need only a file system that Spark can reach, and a
task's files appear when it commits.

Ids are the UTF-8 bytes of the text by default: one byte each, 0xFF ends and 0xFE fills, which UTF-8 never has. ``encoder`` may be any
function from text to numpy ids, with its own width, end and fill, as of a public tokenizer.

Defined cases: null text is empty, its document is one end id; equal rows are each written; null ids of documents are null in
``doc_ids``; an empty table gives no records and no shards; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colmetry.llm.texts import delete_staged, plain, remove, stage

LENGTH, SLOTS, KEY, ROUNDS = 2048, 8192, 0x5DEECE66D, 6


def utf8_ids(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8"), np.uint8)


@dataclass(frozen=True)
class Encoder:
    encode: Callable[[str], np.ndarray] = utf8_ids
    width: str = "<u1"
    end: int = 0xFF
    fill: int = 0xFE


@dataclass(frozen=True)
class Layout:
    """Where records are: all a reader needs."""
    records: int
    length: int
    slots: int
    width: str

    @property
    def stride(self) -> int:
        return self.length * np.dtype(self.width).itemsize


def permute(number: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """Slots of record numbers below ``size``: a Feistel network over the next power of four, walked until below ``size``."""
    half = max(1, -(-max(1, (size - 1).bit_length()) // 2))
    mask, out = np.uint64((1 << half) - 1), number.astype(np.uint64)
    open_ = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(open_):
            left, right = out[open_] >> np.uint64(half), out[open_] & mask
            for k in range(ROUNDS):
                mixed = (right + np.uint64((key + 0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(29)
                mixed *= np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
            out[open_] = (left << np.uint64(half)) | right
            open_ = open_[out[open_] >= size]
    return out.astype(np.int64)


def _records(batches: Iterator[pd.DataFrame], encoder: Encoder, length: int) -> Iterator[tuple[np.ndarray, list[list]]]:
    """Records [n, length] of a partition's texts, with the ids of the documents in each."""
    body, kept, owners = length - 1, np.zeros(0, encoder.width), []
    end = np.array([encoder.end], encoder.width)

    def cut(stream: np.ndarray, owners: list[tuple], rows: int) -> tuple[np.ndarray, list[list]]:
        table = np.full((rows, length), encoder.end, encoder.width)
        table[:, :body] = stream[: rows * body].reshape(rows, body)
        inside: list[list] = [[] for _ in range(rows)]
        for doc, start, stop in owners:
            for row in range(start // body, min(rows, (stop - 1) // body + 1)):
                inside[row].append(doc)
        return table, inside

    for batch in batches:
        for at in range(0, len(batch), 1000):
            part, pieces, size = batch.iloc[at:at + 1000], [kept], len(kept)
            for doc, text in zip(part["doc_id"], part["text"]):
                ids = encoder.encode(text).astype(encoder.width, copy=False)
                pieces += [ids, end]
                owners.append((doc, size, size + len(ids) + 1))
                size += len(ids) + 1
            stream, rows = np.concatenate(pieces), size // body
            if rows:
                yield cut(stream, owners, rows)
            kept = stream[rows * body:].copy()
            owners = [(doc, max(0, a - rows * body), b - rows * body) for doc, a, b in owners if b > rows * body]
    if len(kept):
        filled = np.full(body, encoder.fill, encoder.width)
        filled[: len(kept)] = kept
        yield cut(filled, owners, 1)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", plain("text").alias("text"))


def _cut(documents: DataFrame, length: int, encoder: Encoder, payload: bool = True) -> DataFrame:
    """Records with the partition they were cut in, their place in it and ``so_far``, a check sum of the partition up to there; written."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, place, so_far = TaskContext.get().partitionId(), 0, 0
        for table, inside in _records(batches, encoder, length):
            sums = []
            for record in table:
                so_far = zlib.crc32(record.tobytes(), so_far)
                sums.append(so_far)
            out = {"part": part, "place": np.arange(place, place + len(table)), "n_ids": (table != encoder.fill).sum(axis=1),
                   "doc_ids": inside, "crc32": [zlib.crc32(r.tobytes()) for r in table], "so_far": sums}
            yield pd.DataFrame(out | ({"payload": [r[:-1].tobytes() for r in table]} if payload else {}))
            place += len(table)

    ids = documents.schema["doc_id"].dataType.simpleString()
    schema = f"part int, place long, n_ids long, doc_ids array<{ids}>, crc32 long, so_far long"
    return stage(_texts(documents).mapInPandas(cut, schema + (", payload binary" if payload else "")))


class SplitsDiffer(RuntimeError):
    """A scan was not split as before, so its records have other numbers."""


def _cut_again(documents: DataFrame, known: dict[int, tuple[int, int, int]], layout: Layout, key: int, encoder: Encoder) -> DataFrame:
    """(shard, slot, payload) of the records, cut as ``known`` (first number, records, check sum by partition) says or not at all."""
    held = documents.sparkSession.sparkContext.broadcast(known)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, done, so_far = TaskContext.get().partitionId(), 0, 0
        first, records, whole = held.value.get(part, (0, 0, 0))
        for table, _ in _records(batches, encoder, layout.length):
            for record in table:
                so_far = zlib.crc32(record.tobytes(), so_far)
            number = np.arange(first + done, first + done + len(table))
            done += len(table)
            if done > records:
                break
            slot = permute(number, layout.records, key)
            yield pd.DataFrame({"shard": slot // layout.slots, "slot": slot, "payload": [r[:-1].tobytes() for r in table]})
        if (done, so_far) != (records, whole):
            raise SplitsDiffer(f"{_DIFFER}: partition {part} has other records than when they were numbered")

    return _texts(documents).mapInPandas(cut, "shard long, slot long, payload binary")


_DIFFER = "scan split anew"


@contextmanager
def _pinned(spark: SparkSession) -> Iterator[None]:
    """Splits of files by size alone while plans are made, whatever executors come and go."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _number(cut: DataFrame, before: dict[int, int], layout: Layout, key: int, payload: bool) -> DataFrame:
    held = cut.sparkSession.sparkContext.broadcast(before)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            record = np.fromiter((held.value[p] for p in batch["part"]), np.int64, len(batch)) + batch["place"].to_numpy()
            slot = permute(record, layout.records, key)
            out = {"record": record, "slot": slot, "shard": slot // layout.slots, "byte_offset": slot % layout.slots * layout.stride}
            yield pd.DataFrame(out | {c: batch[c] for c in batch.columns[2:]})

    ids = cut.schema["doc_ids"].dataType.simpleString()
    schema = f"record long, slot long, shard long, byte_offset long, n_ids long, doc_ids {ids}, crc32 long"
    columns = ["part", "place", "n_ids", "doc_ids", "crc32", *(["payload"] if payload else [])]
    return cut.select(columns).mapInPandas(number, schema + (", payload binary" if payload else ""))


def _layout(cut: DataFrame, length: int, slots: int, encoder: Encoder) -> tuple[dict[int, tuple[int, int, int]], Layout]:
    """First number, records and check sum of each partition (one row each comes to the driver), and the layout."""
    known, total = {}, 0
    parts = cut.groupBy("part").agg(F.count("*").alias("n"), F.max("place").alias("last"), F.max_by("so_far", "place").alias("whole"))
    for r in parts.orderBy("part").toLocalIterator():
        if r["n"] != r["last"] + 1:
            raise RuntimeError(f"partition {r['part']} has {r['n']} records, numbered up to {r['last']}")
        known[r["part"]], total = (total, r["n"], r["whole"]), total + r["n"]
    return known, Layout(total, length, slots, encoder.width)


def _firsts(known: dict[int, tuple[int, int, int]]) -> dict[int, int]:
    return {part: first for part, (first, _, _) in known.items()}


def plan(documents: DataFrame, length: int = LENGTH, slots: int = SLOTS, key: int = KEY, encoder: Encoder = Encoder(),
         payload: bool = True) -> tuple[DataFrame, Layout]:
    """Records of ``documents`` (columns doc_id, text): record, slot, shard, byte_offset, n_ids, doc_ids, crc32, and ``payload`` (the
    record's bytes without its end id) if asked for."""
    cut = _cut(documents, length, encoder, payload)
    known, layout = _layout(cut, length, slots, encoder)
    return _number(cut, _firsts(known), layout, key, payload), layout


def _write(records: DataFrame, layout: Layout, path: str, encoder: Encoder) -> None:
    """Shards of records (shard, slot, payload)."""
    end = np.array([encoder.end], encoder.width).tobytes().decode("latin-1")
    ranged = records.select("shard", "slot", F.col("payload").cast("string").alias("value")).repartitionById(
        -(-layout.records // layout.slots), F.col("shard").cast("int")).sortWithinPartitions("shard", "slot")
    ranged.select("shard", "value").write.partitionBy("shard").option("lineSep", end).option("encoding", "ISO-8859-1").text(path)
    written = records.sparkSession.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    if written != layout.records * layout.stride:
        raise SplitsDiffer(f"{_DIFFER}: shards hold {written} bytes, not {layout.records} records of {layout.stride}")


def _is_scan(documents: DataFrame) -> bool:
    """Whether a second run reads the same rows in the same order, as far as splits are the same."""
    return "Exchange" not in documents._jdf.queryExecution().executedPlan().toString()


def materialise(documents: DataFrame, path: str, length: int = LENGTH, slots: int = SLOTS, key: int = KEY,
                encoder: Encoder = Encoder()) -> tuple[DataFrame, Layout]:
    """Write the shards below ``path`` (folder shard=K each) and return the manifest of all records, without their bytes."""
    spark, again = documents.sparkSession, _is_scan(documents)
    with _pinned(spark):
        cut = _cut(documents, length, encoder, payload=not again)
        known, layout = _layout(cut, length, slots, encoder)
        if layout.records and again:
            try:
                _write(_cut_again(documents, known, layout, key, encoder), layout, path, encoder)
            except Exception as error:  # a task's error comes as Spark's
                if _DIFFER not in str(error):
                    raise
                again = False
                remove(spark, path)
                delete_staged(cut)
                cut = _cut(documents, length, encoder)
                known, layout = _layout(cut, length, slots, encoder)
    if layout.records and not again:
        _write(_number(cut, _firsts(known), layout, key, payload=True), layout, path, encoder)
    return _number(cut, _firsts(known), layout, key, payload=False), layout


def read_shards(spark: SparkSession, path: str, layout: Layout, first: int = 0, stop: int | None = None) -> DataFrame:
    """Slots ``first`` to ``stop`` (not included): columns slot, ids (bytes of the record). Only their shards are opened."""
    stop, stride = min(layout.records, stop if stop is not None else layout.records), layout.stride
    files = spark.read.format("binaryFile").load(path).where(
        F.col("shard").between(first // layout.slots, max(first, stop - 1) // layout.slots))
    slots = F.explode(F.transform(F.sequence(F.lit(0), (F.length("content") / stride).cast("int") - 1), lambda k: F.struct(
        (F.col("shard") * layout.slots + k).alias("slot"), F.substring("content", k * stride + 1, F.lit(stride)).alias("ids"))))
    return files.select(slots.alias("r")).select("r.slot", "r.ids").where((F.col("slot") >= first) & (F.col("slot") < stop))
