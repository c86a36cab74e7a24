"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine, distributed components.

Equal vectors of one label (named by 128 bits of hash) are one row with a count. Every row gets ``POOL`` sign bits, one per random
hyperplane. A table of the index looks at some of these bits, and rows of one label with equal bits there share a bucket. Two vectors at
the limit agree in a bit with probability 1 - angle / pi, from which come the number of bits (a bucket of the largest label holds about
``BUCKET`` unrelated vectors, whatever the size of the input) and the number of tables (a pair at the limit is missed with probability
``MISSED`` at most, closer ones less).

* First pass: rows travel as their sign bits only, once per table. Within a bucket, pairs whose signs differ in more bits than a pair at
  the limit does (but for one in a million) are no candidates. A pair counts in the first table it meets in and nowhere else, which both
  sides tell from their signs. Rows with a candidate are named, without their partners.
* Second pass: the rows named take their vectors along, to the tables named for them only, and cosines in double precision decide. A row
  adds up its links; for components, a task emits one link to a local root per row, not all pairs.
* Buckets of more than ``BLOCK`` rows are cut into blocks, and every two blocks are a task of their own, so a group of close vectors
  holding a large part of a label is no single task.

Nothing is capped: results are all pairs at or above the limit that meet in a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log2, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmetry.llm.components import connected
from colmetry.llm.texts import delete_staged, stage

LIMIT, POOL, SEED = 0.93, 256, 29
BUCKET, BLOCK, MISSED, LEAST_BITS = 2048, 4096, 1e-3, 6
TILE = 1024


def normalised(vector: np.ndarray) -> np.ndarray:
    """The vector at length one in double precision. Dividing by the greatest component first keeps squares in range."""
    wide = np.asarray(vector, np.float64)
    wide = wide / np.abs(wide).max()
    return wide / np.sqrt((wide * wide).sum())


def planes(size: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, POOL))


def signs(vectors: np.ndarray) -> np.ndarray:
    """Sign bits [n, POOL / 64] of unit vectors [n, size]."""
    return np.packbits(vectors @ planes(vectors.shape[1]) > 0, axis=1).view(np.uint64)


def agreeing(limit: float) -> np.ndarray:
    """Probability of each number of differing bits for a pair at the limit."""
    p = acos(limit) / pi
    return np.array([comb(POOL, d) * p ** d * (1 - p) ** (POOL - d) for d in range(POOL + 1)])


def furthest(limit: float, missed: float = 1e-6) -> int:
    """Differing bits that a pair at the limit exceeds with probability ``missed`` at most."""
    return int(np.searchsorted(np.cumsum(agreeing(limit)), 1 - missed))


def layout(rows: int, limit: float = LIMIT) -> tuple[int, int]:
    """Bits and number of tables for a label of so many rows."""
    bits = max(LEAST_BITS, ceil(log2(max(1, rows / BUCKET))))
    weight, same = agreeing(limit), ((POOL - np.arange(POOL + 1)) / POOL) ** bits
    tables = 1
    while (weight * (1 - same) ** tables).sum() > MISSED:
        tables += 1
    return bits, tables


def masks(bits: int, tables: int) -> np.ndarray:
    """The bits that each table looks at, as masks [tables, POOL / 64]."""
    rng, out = np.random.default_rng([SEED, bits]), np.zeros((tables, POOL), np.uint8)
    for row in out:
        row[rng.choice(POOL, bits, replace=False)] = 1
    return np.packbits(out, axis=1).view(np.uint64)


def _first_shared(a: np.ndarray, b: np.ndarray, table: int, looked: np.ndarray) -> np.ndarray:
    """Whether rows a and b (sign bits [n, words]) share a bucket of this table and of none before it."""
    other = a ^ b
    fresh = ((other & looked[table]) == 0).all(axis=1)
    for mask in looked[:table]:
        fresh &= ((other & mask) != 0).any(axis=1)
    return fresh


def _near(own: np.ndarray, other: np.ndarray, most: int, table: int, looked: np.ndarray, square: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs whose signs differ in ``most`` bits at most and that this table is the first to meet, tile by tile."""
    for i in range(0, len(own), TILE):
        for j in range(i if square else 0, len(other), TILE):
            a, b = own[i:i + TILE], other[j:j + TILE]
            apart = np.zeros((len(a), len(b)), np.uint16)
            for word in range(a.shape[1]):
                apart += np.bitwise_count(a[:, None, word] ^ b[None, :, word])
            x, y = np.nonzero(apart <= most)
            if square and i == j:
                x, y = x[x < y], y[x < y]
            fresh = _first_shared(a[x], b[y], table, looked)
            yield x[fresh] + i, y[fresh] + j


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([normalised(v) for v in vectors])


def _signed(reps: DataFrame) -> DataFrame:
    """``reps`` (rep, label, size, copies, vector) with ``signs``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby("size"):
                yield part.assign(signs=[b.tobytes() for b in signs(_matrix(part["vector"]))])

    return reps.mapInPandas(run, reps.select("*", F.lit(b"").alias("signs")).schema)


def _buckets(signed: DataFrame, looked: np.ndarray) -> DataFrame:
    """A row per row and table: rep, label, size, signs, tab, bucket (a hash of the bits that the table looks at)."""
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            own = np.frombuffer(b"".join(batch["signs"]), np.uint64).reshape(len(batch), -1)
            for tab, mask in enumerate(looked):
                with np.errstate(over="ignore"):
                    mixed = ((own & mask) * odd).sum(axis=1)
                yield batch.assign(tab=tab, bucket=(mixed ^ (mixed >> np.uint64(31))).view(np.int64))

    rows = signed.select("rep", "label", "size", "signs")
    return rows.mapInPandas(run, rows.select("*", F.lit(0).alias("tab"), F.lit(0).cast("long").alias("bucket")).schema)


BUCKET_KEY = ["label", "size", "tab", "bucket"]


def _celled(rows: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Rows dealt to cells: a bucket is one cell, a large one a cell for each two of its blocks. ``side`` is the block within the cell."""
    cut = sizes.where(F.col("n") > block).select(*BUCKET_KEY, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    known = rows.join(cut, BUCKET_KEY, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least(k, own).alias("low"), F.greatest(k, own).alias("high"), own.alias("side")))
    return known.select(*rows.columns, F.explode(pair).alias("c")).select(*rows.columns, "c.low", "c.high", "c.side")


CELL = [*BUCKET_KEY, "low", "high"]


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole cells, from batches sorted by cell."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[CELL]
        edges = [0, *(np.flatnonzero((keys.to_numpy()[1:] != keys.to_numpy()[:-1]).any(axis=1)) + 1), len(batch)]
        for a, b in zip(edges[:-1], edges[1:]):
            part = batch.iloc[a:b]
            if kept and tuple(kept[0][CELL].iloc[0]) != tuple(part[CELL].iloc[0]):
                yield pd.concat(kept)
                kept = []
            kept.append(part)
    if kept:
        yield pd.concat(kept)


def _pairs(cell: pd.DataFrame, most: int, looked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of a cell as places in it."""
    table = int(cell["tab"].iloc[0])
    bits = np.frombuffer(b"".join(cell["signs"]), np.uint64).reshape(len(cell), -1)
    low, high = cell["low"].iloc[0], cell["high"].iloc[0]
    if low == high:
        yield from _near(bits, bits, most, table, looked, True)
        return
    left, right = (np.flatnonzero(cell["side"] == end) for end in (low, high))
    for i, j in _near(bits[left], bits[right], most, table, looked, False):
        yield left[i], right[j]


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places' local roots after linking i with j."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def links(signed: DataFrame, looked: np.ndarray, limit: float = LIMIT, block: int = BLOCK) -> DataFrame:
    """From signed rows: staged rows (rep, other, linked), one per row and cell it has links in; ``linked`` are the copies of others that
    are linked to ``rep`` there, and ``other`` is the row that stands for its component in the cell."""
    most = furthest(limit)

    def celled(rows: DataFrame, buckets: DataFrame) -> DataFrame:
        sizes = buckets.groupBy(*BUCKET_KEY).agg(F.count("*").alias("n"))
        return _celled(rows, sizes, block).repartition(*CELL).sortWithinPartitions(*CELL)

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in _cells(batches):
            met = np.zeros(len(cell), bool)
            for i, j in _pairs(cell, most, looked):
                met[i], met[j] = True, True
            yield cell.loc[met, ["rep", *BUCKET_KEY]]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in _cells(batches):
            rep, copies, unit = cell["rep"].to_numpy(), cell["copies"].to_numpy(), _matrix(cell["vector"])
            linked, root, step = np.zeros(len(cell), np.int64), np.arange(len(cell)), max(1, (1 << 22) // unit.shape[1])
            for i, j in _pairs(cell, most, looked):
                for at in range(0, len(i), step):
                    a, b = i[at:at + step], j[at:at + step]
                    close = np.einsum("ij,ij->i", unit[a], unit[b]) >= limit
                    a, b = a[close], b[close]
                    np.add.at(linked, a, copies[b])
                    np.add.at(linked, b, copies[a])
                    root = _joined(root, a, b)
            met = linked > 0
            yield pd.DataFrame({"rep": rep[met], "other": rep[root[met]], "linked": linked[met]})

    dealt = stage(_buckets(signed, looked))
    named = stage(celled(dealt, dealt).mapInPandas(name, dealt.select("rep", *BUCKET_KEY).schema).distinct())
    delete_staged(dealt)
    found = named.join(signed.select("rep", "signs", "vector", "copies"), "rep")
    verified = stage(celled(found, named).mapInPandas(verify, "rep long, other long, linked long"))
    delete_staged(named)
    return verified


def near_duplicates(vectors: DataFrame, limit: float = LIMIT, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id`` (least id reachable, itself included), ``kept``.

    Defined cases: rows whose label is null, and vectors that are null, empty or zero or hold a null or non-finite component, link with
    nothing; neither do vectors of different lengths. Equal vectors of a label link with each other, repeated rows too, each counted;
    a null id is passed over by the minimum (null if a component has no other), and such a row is not kept; an empty table gives no
    rows; other columns are ignored. Vectors that differ only in length or by rounding are compared like any others.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").alias("vector"), F.col(f"`{label}`").alias("label"))
    usable = F.col("label").isNotNull() & F.coalesce(
        (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vector", lambda x: x != 0), F.lit(False))
    name = ["label", "h", "g"]
    hashed = rows.where(usable).withColumns({"h": F.xxhash64(F.lit(1), "vector"), "g": F.xxhash64(F.lit(2), "vector")})
    reps = stage(hashed.groupBy(*name).agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("vector").alias("vector")).withColumns(
        {"size": F.size("vector"), "rep": F.monotonically_increasing_id()}))
    largest = reps.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0
    signed = stage(_signed(reps.select("rep", "label", "size", "copies", "vector")))
    found = links(signed, masks(*layout(largest, limit)), limit, block)

    node = F.struct(F.col("first").isNull().alias("no_id"), "first", "rep")
    nodes = reps.select("rep", node.alias("node"))
    edges = found.where("rep <> other").select("rep", "other").distinct()
    edges = edges.join(nodes.withColumnRenamed("node", "a"), "rep").join(
        nodes.select(F.col("rep").alias("other"), F.col("node").alias("b")), "other").select("a", "b")
    roots = connected(edges).select("node.rep", F.col("root.first").alias("root"))
    known = reps.join(found.groupBy("rep").agg(F.sum("linked").alias("linked")), "rep", "left").join(roots, "rep", "left")
    known = stage(known.select(
        *name, (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "first").alias("component_id")))
    for table in (reps, signed, found):
        delete_staged(table)
    # Many rows may share a vector; they are thin here, and adaptive execution splits a crowded key of this join.
    some = hashed.select("vec_id", *name).join(known, name).select("vec_id", "n_links", "component_id")
    none = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(none).select(
        F.col("vec_id").alias(vec_id), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
