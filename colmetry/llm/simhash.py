"""SimHash near-duplicates: a binary trie joined with itself.

Fingerprints are 64-bit votes of word shingles. Links are found by walking pairs of trie nodes together from the top: bits on which the
two paths differ are counted, and a pair is dropped once it exceeds the error budget. Whoever shares a link may differ anywhere, so one
trie would carry many open pairs near its top. With e errors and e + r blocks of bits some r blocks have no error, so the walk is
done in one trie per choice of r blocks, its bit order starting with those blocks: there only a top node paired with itself has to be
followed. Rows (choice, value of the chosen blocks) spread the top nodes over tasks; r is such that a top node holds about
``TOP_NODE`` fingerprints on average, whatever the size of the input. The result does not depend on r.

A task keeps open pairs in chunks, deepest first, and joins linked fingerprints at once; pairs whose fingerprints are one component
already are dropped, so thousands of close copies do not become all their pairs. It emits one link to a local root per fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmetry.llm.components import connected
from colmetry.llm.texts import delete_staged, plain, stage

SHINGLE, SEED, ERRORS = 4, 42, 4
TOP_NODE, CHUNK = 4096, 1 << 16


def fingerprint(text: bytes) -> int:
    """Majority vote of the shingles' hashes; words are lower-cased (A-Z) and split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1:].tolist())
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        votes += np.unpackbits(hashes[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > n).view(np.uint64)[0])


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``doc_id``, ``fp`` (long holding the 64 bits)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.fromiter((fingerprint(t.encode("utf-8")) for t in batch["text"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": bits.view(np.int64)})

    rows = documents.select(F.col(doc_id).alias("doc_id"), plain(text).alias("text"))
    return rows.mapInPandas(run, rows.select("doc_id", F.lit(0).cast("long").alias("fp")).schema)


def block_layout(distinct: int, errors: int = ERRORS) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Blocks as (shift, bits), and the choices of blocks that are walked."""
    r = 1
    while distinct >> (64 * r // (errors + r)) > TOP_NODE and r < errors:
        r += 1
    count = errors + r
    edges = [64 * k // count for k in range(count + 1)]
    blocks = [(64 - edges[k + 1], edges[k + 1] - edges[k]) for k in range(count)]
    return blocks, list(combinations(range(count), r))


def _ordered(fp: np.ndarray, blocks: list[tuple[int, int]], choice: tuple[int, ...]) -> np.ndarray:
    """Fingerprints with the bits of the chosen blocks moved to the top."""
    out = np.zeros_like(fp)
    for k in [*choice, *(k for k in range(len(blocks)) if k not in choice)]:
        shift, bits = blocks[k]
        out = (out << np.uint64(bits)) | ((fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1))
    return out


def trie_links(keys: np.ndarray, top: int, errors: int = ERRORS) -> np.ndarray:
    """For sorted distinct ``keys``: the place of each key's local root, over links within ``errors`` bits below equal ``top`` bits."""
    n, root = len(keys), np.arange(len(keys))
    if n < 2:
        return root
    one = np.uint64(1)
    prefix = keys >> np.uint64(64 - top)
    starts = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
    stops = np.append(starts[1:], n)
    keep = stops - starts > 1
    starts, stops = starts[keep], stops[keep]
    stack = [(top, np.stack([starts[i:i + CHUNK], stops[i:i + CHUNK], starts[i:i + CHUNK], stops[i:i + CHUNK],
                             np.zeros(len(starts[i:i + CHUNK]), np.int64)])) for i in range(0, len(starts), CHUNK)]
    changes = np.arange(n)
    while stack:
        depth, pairs = stack.pop()
        a0, a1, b0, b1, wrong = pairs
        # A pair of nodes that are one component already, end to end, has nothing to add.
        done = (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0]) & (root[a0] == root[b0])
        pairs = pairs[:, ~done]
        a0, a1, b0, b1, wrong = pairs
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= errors
            if near.any():
                root = _unite(root, i[near], j[near])
                changes = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))
            pairs = pairs[:, ~single]
        if not pairs.shape[1]:
            continue
        a0, a1, b0, b1, wrong = pairs
        shift = np.uint64(63 - depth)
        am = np.clip(np.searchsorted(keys, ((keys[a0] >> shift) | one) << shift), a0, a1)
        bm = np.clip(np.searchsorted(keys, ((keys[b0] >> shift) | one) << shift), b0, b1)
        twin = a0 == b0
        children = np.concatenate([
            np.stack([a0, am, b0, bm, wrong]), np.stack([am, a1, bm, b1, wrong]), np.stack([a0, am, bm, b1, wrong + 1]),
            np.stack([am, a1, b0, bm, wrong + 1])[:, ~twin],
        ], axis=1)
        a0, a1, b0, b1, wrong = children
        alive = (a1 > a0) & (b1 > b0) & (wrong <= errors) & ~((a0 == b0) & (a1 - a0 == 1))
        children = children[:, alive]
        stack += [(depth + 1, children[:, i:i + CHUNK]) for i in range(0, children.shape[1], CHUNK)]
    return root


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = root.copy()
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def links(prints: DataFrame, distinct: int, errors: int = ERRORS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that have the components of all links within ``errors`` bits."""
    blocks, choices = block_layout(distinct, errors)

    def value(k: int):
        shift, bits = blocks[k]
        return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    tops = F.array(*(
        F.struct(F.lit(c).cast("int").alias("choice"), F.xxhash64(*(value(k) for k in choice)).alias("top"))
        for c, choice in enumerate(choices)))
    rows = prints.select("fp", F.explode(tops).alias("t")).select("t.choice", "t.top", "fp").repartition("choice", "top")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = [(b["choice"].to_numpy(), b["fp"].to_numpy()) for b in batches]
        if not frame:
            return
        which, fp = (np.concatenate(x) for x in zip(*frame))
        fp = fp.view(np.uint64)
        for c in np.unique(which):
            own = fp[which == c]
            keys = _ordered(own, blocks, choices[c])
            order = np.argsort(keys)
            root = trie_links(keys[order], sum(blocks[k][1] for k in choices[c]), errors)
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield pd.DataFrame({"a": own[order][moved].view(np.int64), "b": own[order][root[moved]].view(np.int64)})

    return rows.select("choice", "fp").mapInPandas(run, "a long, b long")


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", errors: int = ERRORS) -> DataFrame:
    """One row per row of ``documents``: id, ``fingerprint`` (hex digits), ``component_id`` (least id reachable over links).

    Defined cases: null and empty texts, and texts without a word, have fingerprint zero and are linked like any other; fewer than four
    words are one shingle; equal rows are in one component; null ids are passed over by the minimum (null if a component has no other);
    an empty table gives no rows; other columns are ignored. Whole texts count, of any length.
    """
    prints = stage(fingerprints(documents, doc_id, text))
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = stage(links(nodes.select("fp"), nodes.count(), errors))
    # Nodes in order of their least id, so that a component's root holds its answer.
    node = nodes.select("fp", F.struct(F.col("first").isNull().alias("no_id"), "first", "fp").alias("node"))
    named = edges.join(node.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(
        node.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    roots = connected(named.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node.fp").alias("fp"), "root")
    found = stage(nodes.join(roots, "fp", "left").select("fp", F.coalesce("root.first", "first").alias("component_id")))
    for table in (nodes, edges):
        delete_staged(table)
    return prints.join(found, "fp").select(
        F.col("doc_id").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(documents: DataFrame, errors: int = ERRORS) -> DataFrame:
    """One document of each component, the one with the least ``doc_id``; rows with one ``doc_id`` are one document, and its least row
    (by text) stays. A component of null ids is one document too. Columns as in ``documents``."""
    found = near_duplicates(documents, errors=errors)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("copies"))
    kept = stage(kept.withColumnRenamed("doc_id", "kept_id"))
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.col("doc_id").alias("own_id"))
    # One form at every size: texts are dealt by id once and ids are looked up in a hash of those kept.
    joined = rows.join(kept.hint("shuffle_hash"), F.col("own_id").eqNullSafe(F.col("kept_id")))
    # Only ids that stand on several rows need to be gathered.
    least = joined.where("copies > 1").groupBy("own_id").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row"))
    return joined.where("copies = 1").select("row").unionByName(least.select("row")).select("row.*")
