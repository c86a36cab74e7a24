"""Language-model scores by logistic context mixing of bit predictors.

A text is its lower-cased words, each closed by one space, and a lone space as its end. Bytes are coded bit by bit. Seven predictors
see hashed contexts of the current word: its last two to five bytes, all of it, and, for the kind of the document, its last three
bytes and all of it; each counts the zeros and ones met behind its context. Their stretched probabilities are combined by a weight
vector chosen by a gate (how much the longest contexts have seen, and the bit's place), and an adaptive map from (bits of the byte so
far, mixed probability) refines the result.

* A document's kind is one of ``KINDS`` clusters of word endings, found without labels. It is not told to the coder: the coder runs one
  model per kind and weighs them by how well each has done on the document's earlier words. That product telescopes, so a text scores
  log10 sum over kinds of prior times the product of its words' probabilities.
* Counts come from all training texts: words are counted by task, then by word, and the bits of every distinct word enter fixed tables
  (``BITS`` slots) that tasks fill and Spark adds up in blocks. Words met once stay out of the whole-word tables, where they would
  only repeat themselves.
* Clusters come from all training texts, by rounds of expectation-maximisation that tasks add up. They start from clusters of cells: the
  summed texts that share their two most frequent endings (hashed to ``CELLS``).
* Weights and map come from all training texts too. As equal words of a kind bring equal bits, a distinct word enters once with its
  count. Words are dealt by hash to lanes of about ``LANE_WORDS``; each lane learns online, in order: bits are predicted before they are
  used, and the occurrence at hand is taken out of the counts first, so known words don't look better than they are. Lanes' maps are
  added up, their weights averaged by curvature (what each lane has seen of a gate).
* As contexts end at word limits, a word has the same probability wherever it stands, so every distinct word is scored once. Texts are
  dealt to blocks of about ``BLOCK_WORDS`` words; a block asks once for each of its distinct words and adds up its texts.

Defined cases: null text is empty and scores its end alone; equal rows score alike; a null id counts as the empty text for the fold;
without training texts all counts are zero and every bit is even; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colmetry.llm.texts import delete_staged, fold, plain, stage

FOLDS, HELD_OUT = 7, 2
KINDS, ENDINGS = 6, 4096
# Slots, as a power of two, of the predictors: last 2, 3, 4, 5 bytes, whole word; kind with last 3 bytes, kind with whole word.
BITS = (18, 19, 20, 20, 21, 19, 21)
SHARED, WHOLE = 5, (4, 6)
SLICE = 1 << 14
LANE_WORDS, LEARN_WORDS, RIDGE = 50_000, 2000, 16.0
CELLS, ROUNDS, GAIN = 1021, 15, 1e-4
BLOCK_WORDS, PART, STEP = 4_000_000, 10_000, 4096
# Bytes of texts split at a time, and of words (with 4 for each) counted at a time.
PIECE, FLUSH = 4 << 20, 48 << 20
PLACES, BUCKETS = 8, 33
GATES = 10 * PLACES
# Predictors that choose the gate: what a context that has been seen counts for.
LEVELS = {2: 1, 3: 2, 4: 3, 6: 4}
_U = np.uint64
# Every float16 as a float64: a lookup is several times faster than numpy's conversion.
_HALVES = np.arange(1 << 16, dtype=np.uint16).view(np.float16).astype(np.float64)


def split(texts: pa.Array) -> pa.ListArray:
    """Of each text the words in lower case (A-Z), then the end as an empty word."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    closed = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(texts, " ", ""))
    return pc.ascii_split_whitespace(closed)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a ``text``, about ``PIECE`` bytes of texts at a time."""
    for batch in batches:
        rows = max(1, batch.num_rows * PIECE // max(PIECE, batch.column("text").nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _hash(x: np.ndarray, bits: int) -> np.ndarray:
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(32)
    x *= _U(0xC4CEB9FE1A85EC53)
    x >>= _U(64 - bits)
    return x.view(np.int64)


def _at(table: np.ndarray, index: np.ndarray, axis: int | None = None) -> np.ndarray:
    """table[index] for an index known to lie within the table, which numpy then need not test."""
    return np.take(table, index, axis, mode="clip")


class Bits:
    """The bits of words, each closed by a space, and the slots that predictors look at: arrays [place in the byte, held bytes].

    With ``share``, bytes that a word has in common with the start of the word before are held once: ``gather`` adds up what words
    bring to a byte, ``spread`` adds up bytes for each word. In sorted words most bytes are shared.
    """

    def __init__(self, words: list[bytes], share: bool = False):
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        starts = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(data)) - starts[word]
        new = np.ones(len(data), bool)
        if share:
            other = np.where((word > 0) & (place < lengths[word - 1]), starts[word - 1] + place, -1)
            parts = np.where((other < 0) | (data != data[other]), place, len(data))
            new = place >= np.minimum.reduceat(parts, starts)[word]
        self.words = len(words)
        # Bytes by place, then word: a byte stands for those that follow it up to the next new one.
        column = np.argsort(place, kind="stable")
        self.owner, fresh = word[column], new[column]
        self.heads = np.flatnonzero(fresh)
        self.source = np.cumsum(fresh) - 1
        held = column[self.heads]
        wide = data.astype(np.uint64) + _U(1)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate(([1], np.full(int(lengths.max()), 0x5851F42D4C957F2D))).astype(np.uint64))
            before = np.concatenate(([0], np.cumsum(wide * power[place])[:-1])).astype(np.uint64)
            contexts, packed, at = [], np.zeros(len(held), np.uint64), place[held]
            for back in range(1, 6):
                recent = np.where(at < back, _U(0), wide[np.maximum(held - back, 0)])
                packed = packed * _U(0x100000001B3) + recent * _U(0x9E3779B97F4A7C15)
                contexts.append(packed)
            whole = ((before[held] - before[starts][word[held]]) ^ at.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) * _U(0xC2B2AE3D27D4EB4F)
        self.contexts = [*contexts[1:], whole]
        own, shifts = data[held], np.arange(8, 0, -1, dtype=np.uint8)[:, None]
        node = (1 << np.arange(8, dtype=np.uint16))[:, None] | (own.astype(np.uint16) >> shifts)
        self.bit = (own >> (shifts - 1)) & 1
        self.code = node.astype(np.int64) * 2 + self.bit
        self.step = node.astype(np.uint64) * _U(0xD6E8FEB86659FD93)

    def gather(self, weight: np.ndarray) -> np.ndarray:
        """Weights of words, added up for each held byte."""
        return np.add.reduceat(weight[self.owner], self.heads)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values of held bytes, added up for each word."""
        return np.bincount(self.owner, values[self.source], self.words)

    def shared(self, at: np.ndarray | slice = slice(None)) -> list[np.ndarray]:
        return [_hash(c[at] + self.step[:, at], b) for c, b in zip(self.contexts, BITS)]

    def by_kind(self, kind: int, at: np.ndarray | slice = slice(None)) -> list[np.ndarray]:
        """Slots of the kind's predictors, for the held bytes ``at``."""
        own = _U((kind + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)
        step = self.step[:, at]
        return [_hash((self.contexts[k][at] ^ own) + step, b) for k, b in zip((1, 4), BITS[SHARED:])]


def _endings(words: pa.ListArray) -> list[np.ndarray]:
    """Hashed last three bytes of each word of each text; a space stands before every word, and one more before the first."""
    text = pc.binary_join_element_wise("  ", pc.binary_join(words, " "), " ", "")
    data, ends = np.frombuffer(text.buffers()[2], np.uint8), np.cumsum(pc.binary_length(text).to_numpy(), dtype=np.int64)
    starts, closing = np.concatenate(([0], ends[:-1])), data[:ends[-1]] == 32
    closing[starts] = closing[starts + 1] = False
    last = np.flatnonzero(closing) - 1
    met = np.zeros(len(last), np.uint32)
    for back, factor in enumerate((131, 31_337, 7_654_321)):
        met += data[last - back] * np.uint32(factor)
    met -= met // np.uint32(1_000_003) * np.uint32(1_000_003)
    return np.split((met % np.uint32(ENDINGS)).astype(np.intp), np.cumsum(pc.list_value_length(words).to_numpy())[:-1])


def endings(words: list[bytes]) -> np.ndarray:
    """Hashed last three bytes of each word."""
    return _endings(pa.array([[w.decode("utf-8") for w in words]], pa.list_(pa.string())))[0]


class Kinds:
    """Clusters of documents by their words' endings: a mixture of multinomials fitted by expectation-maximisation."""

    def __init__(self, documents: np.ndarray, met: np.ndarray):
        """From the documents of each kind [kinds] and the endings met in them [kinds, endings]."""
        self.prior = np.log((documents + 1) / (documents.sum() + len(documents)))
        met = met + 0.01
        self.table = np.log(met / met.sum(axis=1, keepdims=True)).T.astype(np.float32)

    def of(self, met: np.ndarray) -> int:
        """Kind of a document, from the endings of its words."""
        return int((_at(self.table, met, axis=0).sum(axis=0) + self.prior).argmax())

    def members(self, like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of kinds in documents, from the summed ``table`` rows of each, and the log-likelihood of each document."""
        like = like + self.prior
        top = like.max(axis=1, keepdims=True)
        member = np.exp(like - top)
        total = member.sum(axis=1, keepdims=True)
        return member / total, (top + np.log(total)).ravel()


def _traits(texts: DataFrame) -> DataFrame:
    """By text its distinct endings (ascending), their counts and its cell: the two most frequent endings of its words."""
    end = int(endings([b""])[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            cells, places, counts = [], [], []
            for own in _endings(split(batch.column("text"))):
                met = np.bincount(own, minlength=ENDINGS)
                at = np.flatnonzero(met)
                places.append(at.astype("<u2").tobytes())
                counts.append(met[at].astype("<u4").tobytes())
                met[end] -= 1
                first = int(met.argmax())
                met[first] = -1
                cells.append((first * ENDINGS + int(met.argmax())) % CELLS)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())],
                                             ["cell", "at", "met"])

    return texts.select("text").mapInArrow(run, "cell int, at binary, met binary")


def _summed(parts: DataFrame) -> list:
    """Rows of (k, documents, gain, met), added up by k."""
    def add(pieces: pd.DataFrame) -> pd.DataFrame:
        met = np.sum([np.frombuffer(m, "<f8") for m in pieces["met"]], axis=0)
        return pd.DataFrame({"k": pieces["k"][:1], "documents": [pieces["documents"].sum()], "gain": [pieces["gain"].sum()], "met": [met.tobytes()]})

    return sorted(parts.groupBy("k").applyInPandas(add, parts.schema).collect())


_SUMS = "k int, documents double, gain double, met binary"


def _cells(traits: DataFrame) -> list:
    """Documents and endings by cell."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        documents, met = Counter(), {}
        for batch in batches:
            documents.update(batch["cell"])
            for cell, at, n in zip(batch["cell"], batch["at"], batch["met"]):
                if cell not in met:
                    met[cell] = np.zeros(ENDINGS)
                met[cell][np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u4")
        for cell, counts in met.items():
            yield pd.DataFrame({"k": [cell], "documents": [float(documents[cell])], "gain": [0.0], "met": [counts.tobytes()]})

    return _summed(traits.mapInPandas(run, _SUMS))


def _round(traits: DataFrame, kinds: Kinds) -> list:
    """One round over all documents: shares of documents and endings by kind, and the log-likelihood."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        documents, met, gain = np.zeros(KINDS), np.zeros((KINDS, ENDINGS)), 0.0
        for batch in batches:
            sizes = batch["at"].str.len().to_numpy() // 2
            at, n = np.frombuffer(b"".join(batch["at"]), "<u2"), np.frombuffer(b"".join(batch["met"]), "<u4").astype(np.float64)
            member, found = kinds.members(np.add.reduceat(kinds.table[at] * n[:, None], np.cumsum(sizes) - sizes))
            documents, gain = documents + member.sum(axis=0), gain + found.sum()
            for k in range(KINDS):
                met[k] += np.bincount(at, n * np.repeat(member[:, k], sizes), ENDINGS)
        yield pd.DataFrame({"k": range(KINDS), "documents": documents, "gain": gain, "met": [row.tobytes() for row in met]})

    return _summed(traits.mapInPandas(run, _SUMS))


def _arrays(sums: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["documents"] for r in sums]), np.stack([np.frombuffer(r["met"], "<f8") for r in sums])


def fit_kinds(texts: DataFrame) -> Kinds:
    """Kinds of all ``texts``."""
    traits = stage(_traits(texts))
    cells = _cells(traits)
    if not cells:
        return Kinds(np.zeros(KINDS), np.zeros((KINDS, ENDINGS)))
    documents, counts = _arrays(cells)
    root, mass = np.sqrt(counts / counts.sum(axis=1, keepdims=True)), counts.sum(axis=1)
    picks = [int(mass.argmax())]
    while len(picks) < KINDS:  # a large cell that is little like those picked so far
        picks.append(int((mass * (1 - (root @ root[picks].T).max(axis=1))).argmax()))
    kinds = Kinds(documents[picks], counts[picks])
    for _ in range(ROUNDS):
        member, _ = kinds.members(counts @ kinds.table)
        kinds = Kinds(member.T @ documents, member.T @ counts)
    before = -np.inf
    for _ in range(ROUNDS):
        sums = _round(traits, kinds)
        kinds, now = Kinds(*_arrays(sums)), sums[0]["gain"]
        if now - before < GAIN * abs(now):
            break
        before = now
    delete_staged(traits)
    return kinds


def word_counts(documents: DataFrame, kinds: Kinds) -> DataFrame:
    """Columns ``word``, ``n_all`` and ``kinds`` (training count by kind) over rows of (held_out, text); counted by task first."""
    def counted_at_once(words: list[pa.Array], kind: list[np.ndarray]) -> pa.RecordBatch:
        coded, size = pa.chunked_array(words).dictionary_encode().unify_dictionaries(), KINDS + 1
        distinct = coded.chunk(0).dictionary
        met, first = np.zeros((2, len(distinct) * size), np.int64)
        own, start = np.concatenate(kind), len(coded)
        for chunk in reversed(coded.chunks):  # so that the first place of a word stays
            start -= len(chunk)
            cell = chunk.indices.to_numpy().astype(np.int64) * size + own[start:start + len(chunk)]
            np.add.at(met, cell, 1)
            first[cell[::-1]] = np.arange(start + len(chunk) - 1, start - 1, -1)
        at = np.flatnonzero(met)
        at = at[np.argsort(at % size * len(coded) + first[at])]  # by kind as met, which sets the sample that deals words to ranges
        return pa.RecordBatch.from_arrays(
            [distinct.take(pa.array(at // size)), pa.array(at % size, pa.int32()), pa.array(met[at])], ["word", "kind", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kind, held = [], [], 0
        for batch in _pieces(batches):
            lists = split(batch.column("text"))
            own = [KINDS if out else kinds.of(met) for out, met in zip(batch.column("held_out").to_pylist(), _endings(lists))]
            words.append(lists.flatten())
            kind.append(np.repeat(np.array(own, np.uint8), pc.list_value_length(lists).to_numpy()))
            held += words[-1].nbytes
            if held > FLUSH:
                yield counted_at_once(words, kind)
                words, kind, held = [], [], 0
        if words:
            yield counted_at_once(words, kind)

    counted = documents.select("held_out", "text").mapInArrow(run, "word string, kind int, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n_all"), F.array(*(
        F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)) for k in range(KINDS))).alias("kinds"))


def add_bits(tables: list[np.ndarray], words: list[bytes], by_kind: np.ndarray) -> None:
    """Enter sorted words with their counts by kind (array [words, kinds]) into tables [2 * slots]."""
    total = by_kind.sum(axis=1)
    bits, once = Bits(words, share=True), total <= 1

    def enter(bits: Bits, slots: list[np.ndarray], first: int, weight: np.ndarray, once: np.ndarray) -> None:
        every, often = (np.tile(bits.gather(w), 8) for w in (weight, np.where(once, 0, weight)))
        for k, slot in enumerate(slots, first):
            np.add.at(tables[k], (slot * 2 + bits.bit).ravel(), often if k in WHOLE else every)

    enter(bits, bits.shared(), 0, total, once)
    for kind in range(by_kind.shape[1]):
        rows = np.flatnonzero(by_kind[:, kind])
        if len(rows):
            bits = Bits([words[i] for i in rows], share=True)
            enter(bits, bits.by_kind(kind), SHARED, by_kind[rows, kind], once[rows])


def count_bits(words: DataFrame) -> list[np.ndarray]:
    """Tables of counts, by predictor an array [slots, 2], from rows of (word, kinds, n), best in order."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = None
        for batch in batches:
            tables = tables or [np.zeros(2 << b, np.float32) for b in BITS]
            for at in range(0, len(batch), PART):
                part = batch.iloc[at:at + PART]
                add_bits(tables, [w.encode("utf-8") for w in part["word"]], np.stack(part["kinds"]).astype(np.float32))
        for k, table in enumerate(tables or ()):
            for at in range(0, len(table), SLICE):
                if table[at:at + SLICE].any():
                    yield pd.DataFrame({"k": [k], "at": [at], "counts": [table[at:at + SLICE].tobytes()]})

    def add(pieces: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, "<f4") for c in pieces["counts"]], axis=0, dtype=np.float64)
        return pd.DataFrame({"k": pieces["k"][:1], "at": pieces["at"][:1], "counts": [total.astype("<f4").tobytes()]})

    schema = "k int, at long, counts binary"
    tables = [np.zeros(2 << b, np.float32) for b in BITS]
    pieces = words.where("n > 0").select("word", "kinds").mapInPandas(run, schema)
    for row in pieces.groupBy("k", "at").applyInPandas(add, schema).toLocalIterator():
        counts = np.frombuffer(row["counts"], "<f4")
        tables[row["k"]][row["at"]:row["at"] + len(counts)] = counts
    return [t.reshape(-1, 2) for t in tables]


def _stretch(counts: np.ndarray) -> np.ndarray:
    return np.log((counts[:, 1] + 0.4) / (counts[:, 0] + 0.4))


def _level(k: int, counts: np.ndarray) -> np.ndarray:
    """Weight sets that predictor ``k`` asks for, of which the highest holds: whether it has seen its context, the last one how often."""
    seen = counts[:, 0] + counts[:, 1]
    return np.where(seen > 0, np.minimum(np.ceil(np.log2(1 + seen)) - 1 if k == 6 else 0, 5) + LEVELS[k], 0).astype(np.uint8)


def _gate(level: np.ndarray) -> np.ndarray:
    """Weight set: what the longest contexts have seen, and the place of the bit."""
    return level * np.uint8(PLACES) + np.arange(PLACES, dtype=np.uint8)[:, None]


def _bucket(dot: np.ndarray) -> np.ndarray:
    return (np.rint(dot * 16 / 12) + 16).astype(np.int64)  # from 0 to BUCKETS - 1, as dot is clipped to 12


class Mixer:
    """Weights by gate and the adaptive map, with the curvature of what has been seen, which sets the steps (online Newton)."""

    def __init__(self):
        self.weights = np.full((GATES, len(BITS)), 0.25)
        self.curve = np.tile(RIDGE * np.eye(len(BITS)), (GATES, 1, 1))
        self.hits, self.tries = np.zeros((256, BUCKETS)), np.zeros((256, BUCKETS))

    def learn(self, inputs: np.ndarray, sizes: np.ndarray, code: np.ndarray, weight: np.ndarray) -> None:
        """One step of the online pass: predict, then correct weights and map.

        Columns of ``inputs`` [predictors, bits] are in order of their gates, ``sizes`` of each; a bit counts ``weight`` times.
        """
        ends, dot = np.cumsum(sizes), np.empty(len(code))
        gates = np.flatnonzero(sizes)
        spans = [(g, slice(ends[g] - sizes[g], ends[g])) for g in gates]
        for g, span in spans:
            np.matmul(self.weights[g], inputs[:, span], out=dot[span])
        np.clip(dot, -12, 12, out=dot)
        p, bit = 1 / (1 + np.exp(-dot)), code & 1
        met = np.bincount(code * BUCKETS + _bucket(dot), weight, 512 * BUCKETS).reshape(256, 2, BUCKETS)
        self.hits += met[:, 1]
        self.tries += met.sum(axis=1)
        # Halfway between the expected curvature and the squared error, so that a surprise makes no wild step.
        error = bit - p
        slope, bend = weight * error, weight * (p * (1 - p) + error * error) / 2
        bent, slopes = inputs * bend, np.zeros((len(gates), len(BITS)))
        for k, (g, span) in enumerate(spans):
            part = inputs[:, span]
            self.curve[g] += bent[:, span] @ part.T
            slopes[k] = part @ slope[span]
        self.weights[gates] += np.linalg.solve(self.curve[gates], slopes[:, :, None])[:, :, 0]


class Model:
    """Count tables as stretched probabilities and levels, with gate weights and the adaptive map."""

    def __init__(self, tables: list[np.ndarray], kinds: Kinds, mixer: Mixer):
        self.kinds = kinds
        self.stretched = [_stretch(t).astype(np.float16).astype(np.float32) for t in tables]
        self.level = {k: _level(k, tables[k]) for k in LEVELS}
        self.weights, self.hits, self.tries = mixer.weights.T.astype(np.float32), mixer.hits, mixer.tries
        # The mean of the mixed probability and what the map has met for it is linear in the former: by (node, bit, bucket).
        one = 0.5 + 8 / (self.tries + 16), self.hits / (self.tries + 16) / 2
        self.slope, self.start = (np.stack([zero, x], axis=1).ravel() for zero, x in zip((-one[0], 1 - one[1]), one))

    def refined(self, dot: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Probability of the coded bit."""
        cell = _bucket(dot)
        cell += code * BUCKETS
        p = _at(self.slope, cell)
        p *= 1 / (1 + np.exp(-dot))
        p += _at(self.start, cell)
        return np.clip(p, 1e-6, 1 - 1e-6, out=p)

    def score(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word with its closing space, by kind."""
        bits = Bits(words, share=True)
        held = np.concatenate([self._score(bits, slice(at, at + STEP)) for at in range(0, len(bits.heads), STEP)], axis=1)
        return np.stack([bits.spread(row) for row in held], axis=1)

    def _score(self, bits: Bits, at: slice) -> np.ndarray:
        """log10 probability of the held bytes ``at``, by kind: few enough for the processor's cache."""
        shared, code = bits.shared(at), bits.code[:, at]
        fixed = [_at(self.stretched[k], slots) for k, slots in enumerate(shared)]
        level = np.maximum.reduce([_at(self.level[k], shared[k]) for k in LEVELS if k < SHARED])
        out = np.zeros((KINDS, code.shape[1]))
        for kind in range(KINDS):
            own = bits.by_kind(kind, at)
            gate = _gate(np.maximum(level, _at(self.level[6], own[1]))).astype(np.intp)
            dot = _at(self.weights[0], gate)
            dot *= fixed[0]
            for k in range(1, len(BITS)):
                part = _at(self.weights[k], gate)
                part *= fixed[k] if k < SHARED else _at(self.stretched[k], own[k - SHARED])
                dot += part
            np.clip(dot, -12, 12, out=dot)
            out[kind] = np.log10(self.refined(dot, code).prod(axis=0))
        return out

    def total(self, by_kind: np.ndarray) -> float:
        """log10 probability of a text from the sums of its words by kind."""
        weighed = by_kind + self.kinds.prior / np.log(10)
        top = weighed.max()
        return float(top + np.log10((10 ** (weighed - top)).sum()))


def without_one(tables: list[np.ndarray]) -> tuple[list[np.ndarray], dict[int, np.ndarray]]:
    """By predictor stretched probabilities and levels at (slot, bit), from counts without one occurrence of that bit."""
    stretched, level = [np.zeros(t.size, np.float16) for t in tables], {k: np.zeros(tables[k].size, np.uint8) for k in LEVELS}
    for k, table in enumerate(tables):
        for bit in (0, 1):
            counts = table.copy()
            counts[:, bit] = np.maximum(counts[:, bit] - 1, 0)
            stretched[k][bit::2] = _stretch(counts)
            if k in LEVELS:
                level[k][bit::2] = _level(k, counts)
    return stretched, level


def learn_words(mixer: Mixer, held: tuple[list[np.ndarray], dict[int, np.ndarray]], words: list[bytes], by_kind: np.ndarray) -> None:
    """An online step by kind over sorted words with their counts by kind (array [words, kinds]), which are among the counted ones."""
    bits, (stretched, level) = Bits(words, share=True), held

    def met(k: int, slots: np.ndarray) -> np.ndarray:
        return _at(_HALVES, _at(stretched[k], slots).view(np.uint16))

    # Counts without the occurrence that is being coded.
    slots = [slot * 2 + bits.bit for slot in bits.shared()]
    fixed = [met(k, x).ravel() for k, x in enumerate(slots)]
    seen = np.maximum.reduce([_at(level[k], slots[k]) for k in LEVELS if k < SHARED])
    code = bits.code.ravel()
    for kind in np.flatnonzero(by_kind.any(axis=0)):
        weight = bits.gather(by_kind[:, kind])
        own = np.flatnonzero(weight)
        part, last = (slot * 2 + bits.bit[:, own] for slot in bits.by_kind(int(kind), own))
        gate = _gate(np.maximum(seen[:, own], _at(level[6], last))).ravel()
        order = np.argsort(gate, kind="stable")
        at = (np.arange(8)[:, None] * len(weight) + own).ravel()[order]
        inputs = np.empty((len(BITS), len(at)))
        for k, x in enumerate(fixed):
            np.take(x, at, out=inputs[k], mode="clip")
        inputs[SHARED], inputs[SHARED + 1] = met(SHARED, part.ravel()[order]), met(SHARED + 1, last.ravel()[order])
        mixer.learn(inputs, np.bincount(gate, minlength=GATES), code[at], np.tile(weight[own], 8)[order])


def fit_mixer(tables: list[np.ndarray], words: DataFrame, distinct: int) -> Mixer:
    """Weights and map from an online pass by lane over all rows of (word, kinds, n) with n > 0; the tables hold their counts."""
    held = words.sparkSession.sparkContext.broadcast(without_one(tables))
    lanes = max(1, -(-distinct // LANE_WORDS))

    def learn(lane: pd.DataFrame) -> pd.DataFrame:
        lane, mixer = lane.sort_values("word", ignore_index=True), Mixer()
        steps = -(-len(lane) // LEARN_WORDS)
        for k in range(steps):  # each step has words from the whole alphabet
            part = lane.iloc[k::steps]
            learn_words(mixer, held.value, [w.encode("utf-8") for w in part["word"]], np.stack(part["kinds"]).astype(np.float64))
        pulls = mixer.curve @ mixer.weights[:, :, None]
        gates = np.concatenate([mixer.curve.reshape(GATES, -1), pulls.reshape(GATES, -1)], axis=1)
        nodes = np.concatenate([mixer.hits, mixer.tries], axis=1)
        return pd.DataFrame({"part": np.repeat([0, 1], [len(gates), len(nodes)]), "at": [*range(len(gates)), *range(len(nodes))],
                             "sums": [row.tobytes() for row in [*gates, *nodes]]})

    def add(pieces: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(p, "<f8") for p in pieces["sums"]], axis=0)
        return pd.DataFrame({"part": pieces["part"][:1], "at": pieces["at"][:1], "sums": [total.tobytes()]})

    schema, mixer, size = "part int, at int, sums binary", Mixer(), len(BITS)
    dealt = words.where("n > 0").select("word", "kinds", F.pmod(F.xxhash64("word"), F.lit(lanes)).alias("lane"))
    learned = dealt.groupBy("lane").applyInPandas(learn, schema)
    for row in learned.groupBy("part", "at").applyInPandas(add, schema).collect():
        sums = np.frombuffer(row["sums"], "<f8")
        if row["part"] == 0:
            mixer.curve[row["at"]] = sums[:size * size].reshape(size, size)
            mixer.weights[row["at"]] = np.linalg.solve(mixer.curve[row["at"]], sums[size * size:])
        else:
            mixer.hits[row["at"]], mixer.tries[row["at"]] = np.split(sums, 2)
    held.unpersist()
    return mixer


def score_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS,
                    held_out: int = HELD_OUT) -> DataFrame:
    """One row per row of ``documents``: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    ``n_bytes`` are those of the coded text (words and their closing spaces, and the end).
    """
    spark: SparkSession = documents.sparkSession
    rows = documents.select(F.col(doc_id).alias("doc_id"), (fold(F.col(doc_id), folds) == held_out).alias("held_out"),
                            plain(text).alias("text"))
    kinds = fit_kinds(rows.where(~F.col("held_out")))
    # In order, as neighbours share most of their bytes.
    words = stage(word_counts(rows, kinds).withColumn("n", F.aggregate("kinds", F.lit(0).cast("long"), lambda a, n: a + n))
                  .repartitionByRange("word").sortWithinPartitions("word"))
    total, distinct, all_words = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n_all"), F.lit(0))).first()
    tables = count_bits(words)
    model = spark.sparkContext.broadcast(Model(tables, kinds, fit_mixer(tables, words, distinct)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), PART):
                part = batch.iloc[k:k + PART]
                found = model.value.score([w.encode("utf-8") for w in part["word"]]).astype("<f4")
                yield pd.DataFrame({"word": part["word"], "n": part["n"], "scores": [row.tobytes() for row in found]})

    scored = words.select("word", "n").mapInPandas(score, "word string, n long, scores binary")
    blocks = max(1, -(-all_words // BLOCK_WORDS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).select(
        "block", "doc_id", "held_out", "text")

    def ask(block: pa.Table) -> pa.Table:
        own = pc.unique(pa.chunked_array([pc.unique(split(b.column("text")).flatten()) for b in _pieces(block.to_batches())]))
        return pa.table({"word": own, "block": pa.array(np.full(len(own), block.column("block")[0].as_py(), np.int32))})

    asked = dealt.groupBy("block").applyInArrow(ask, "word string, block int")
    answered = asked.join(scored, "word")
    unit = 1 / (total + distinct + 1)

    def add(answers: pa.Table, texts: pa.Table) -> pa.Table:
        n, names = answers.column("n").to_numpy(), answers.column("word").combine_chunks()
        scores = np.frombuffer(b"".join(answers.column("scores").to_pylist()), "<f4").reshape(-1, KINDS)
        each = np.column_stack([scores, np.log10((n + 1) * unit), n > 0, pc.binary_length(names).to_numpy() + 1])
        lists = [split(b.column("text")) for b in _pieces(texts.to_batches())]
        places, out = pc.index_in(pa.chunked_array([own.flatten() for own in lists]), value_set=names).to_numpy(), []
        for at in np.split(places, np.cumsum(np.concatenate([pc.list_value_length(own).to_numpy() for own in lists]))[:-1]):
            sums = np.ones(len(at)) @ _at(each, at, axis=0)
            out.append((len(at), sums[KINDS + 1], sums[KINDS], model.value.total(sums[:KINDS]), sums[KINDS + 2]))
        tokens, known, base, score, size = np.array(out).T
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": tokens.astype(np.int64),
                         "n_known": known.astype(np.int64), "base_score": base, "score": score, "n_bytes": size.astype(np.int64)})

    ids = documents.schema[doc_id].dataType.simpleString()
    found = answered.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(
        add, f"doc_id {ids}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return found.select(
        F.col("doc_id").alias(doc_id), "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"),
        "base_score", "score", "n_bytes", (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
