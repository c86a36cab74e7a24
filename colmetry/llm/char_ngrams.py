"""Kneser-Ney models of the bytes of words, one per class, over shared lower orders.

A word is its lower-case bytes and a closing space. From the lowest order up, a byte's probability behind the last bytes is the
discounted count of what was met there plus the left-over mass times the order below. Counts of the highest order are those of the
text, counts of lower orders are numbers of different bytes met before (continuations). Up to order ``shared`` the counts of all
classes are one, so that rare expressions are smoothed alike in every class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmetry.llm.texts import plain, words

DISCOUNT = 0.75
MEMO, FRESH, WORDS_AT_ONCE = 200_000, 20_000, 200_000


def draw(marks: DataFrame, labels: list, per_class: int, seed: int) -> DataFrame:
    """At most ``per_class`` ids of each label, those least by a hash: columns picked_id, picked_label, k (place of the label).

    ``marks`` has columns doc_id and label. Ids are drawn before any text is read, and the result is small enough to broadcast.
    """
    parts = []
    for k, label in enumerate(labels):
        own = marks.where(F.col("label") == label).select("doc_id").distinct()
        parts.append(own.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(per_class).select(
            F.col("doc_id").alias("picked_id"), F.lit(label).alias("picked_label"), F.lit(k).alias("k")))
    return reduce(DataFrame.unionByName, parts)


def drawn_texts(texts: DataFrame, drawn: DataFrame) -> DataFrame:
    """One text (the least) for each drawn id: columns doc_id, k, text. ``texts`` has doc_id, text and, if ids don't settle it, label."""
    same = F.col("doc_id").eqNullSafe(F.col("picked_id"))
    if "label" in texts.columns:
        same = same & (F.col("label") == F.col("picked_label"))
    # Bounded by labels times ids per label.
    return texts.join(F.broadcast(drawn), same).groupBy("doc_id", "k").agg(F.min(plain("text")).alias("text"))


def labels_of(marks: DataFrame) -> list:
    """The labels in order; there are few."""
    return sorted(r["label"] for r in marks.where(F.col("label").isNotNull()).select("label").distinct().collect())


def class_words(texts: DataFrame, marks: DataFrame, labels: list, per_class: int) -> tuple[list[bytes], np.ndarray]:
    """Words of the texts of at most ``per_class`` ids of each label, with their counts by label (array [words, labels]).

    The sample bounds what the driver holds.
    """
    if not labels:
        return [], np.zeros((0, 0))
    picked = drawn_texts(texts, draw(marks, labels, per_class, 7))
    counted = picked.select("k", F.explode(words(F.lower("text"))).alias("word")).groupBy("word").agg(
        *(F.count(F.when(F.col("k") == k, 1)).alias(f"n{k}") for k in range(len(labels)))).toPandas()
    return [w.encode("utf-8") for w in counted["word"]], counted[[f"n{k}" for k in range(len(labels))]].to_numpy(np.float64)


def split_parts(texts: Iterable[str], split: Callable[[str], list[bytes]]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Runs of texts as words, with the place of the first: a run ends once it has ``WORDS_AT_ONCE`` words, so memory does not depend on
    how many texts a batch has."""
    first, run, held = 0, [], 0
    for text in texts:
        run.append(split(text))
        held += len(run[-1])
        if held >= WORDS_AT_ONCE:
            yield first, run
            first, run, held = first + len(run), [], 0
    if run:
        yield first, run


def _grams(names: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed last ``order`` bytes at every byte of every word (start of word as 1), lowest byte last read; and the word's number."""
    pad = b"\x01" * (order - 1)
    data = np.frombuffer(b"".join(pad + w + b" " for w in names), np.uint8)
    lengths = np.fromiter(map(len, names), np.int64, len(names)) + order
    number = np.repeat(np.arange(len(names)), lengths)
    place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key = np.zeros(len(data), np.uint64)
    for back in range(order):
        shifted = np.zeros(len(data), np.uint64)
        shifted[back:] = data[: len(data) - back]
        key |= shifted << np.uint64(8 * back)
    real = place >= order - 1
    return key[real], number[real]


class ByteModel:
    """``names`` and ``counts`` as from :func:`class_words`."""

    def __init__(self, names: list[bytes], counts: np.ndarray, order: int, shared: int, least: int = 1):
        self.order, self.classes = order, counts.shape[1]
        keys, number = _grams(names, order)
        keys, place = np.unique(keys, return_inverse=True)
        met = np.stack([np.bincount(place, counts[number, k], len(keys)) for k in range(self.classes)], axis=1)
        levels = {order: (keys, met)}
        for m in range(order - 1, 0, -1):
            shorter = keys & np.uint64((1 << (8 * m)) - 1)
            below, place = np.unique(shorter, return_inverse=True)
            met = np.stack([np.bincount(place, met[:, k] > 0, len(below)) for k in range(self.classes)], axis=1)
            levels[m] = (below, met)
            keys = below
        # Highest order first: rare grams of long orders are left to the orders below.
        self.levels = {}
        for m, (keys, met) in levels.items():
            if m > shared and least > 1:
                kept = met.sum(axis=1) >= least
                keys, met = keys[kept], met[kept]
            if m <= shared:
                met = np.repeat(met.sum(axis=1, keepdims=True), self.classes, axis=1)
            self.levels[m] = self._level(keys, met)

    def _level(self, keys: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, ...]:
        behind, place = np.unique(keys >> np.uint64(8), return_inverse=True)
        total = np.stack([np.bincount(place, met[:, k], len(behind)) for k in range(self.classes)], axis=1)
        kinds = np.stack([np.bincount(place, met[:, k] > 0, len(behind)) for k in range(self.classes)], axis=1)
        share = np.where(total[place] > 0, np.maximum(met - DISCOUNT, 0) / np.maximum(total[place], 1), 0)
        left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1)
        # A byte and what stands before it are found together: the row of the context rides along.
        return keys, share.astype(np.float32), place.astype(np.int32), behind, left.astype(np.float32)

    def score(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Natural-log probability of each word by class (array [words, classes]), and its number of bytes."""
        keys, number = _grams(names, self.order)
        keys, inverse = np.unique(keys, return_inverse=True)
        p = np.full((len(keys), self.classes), 1 / 256, np.float32)
        for m in range(1, self.order + 1):
            own, share, row, behind, left = self.levels[m]
            if not len(own):
                continue
            key = keys & np.uint64((1 << (8 * m)) - 1)
            at = np.minimum(np.searchsorted(own, key), len(own) - 1)
            hit = own[at] == key
            context = np.minimum(np.searchsorted(behind, key >> np.uint64(8)), len(behind) - 1)
            known = behind[context] == key >> np.uint64(8)
            p = np.where(hit[:, None], share[at], 0) + np.where(known[:, None], left[context], 1) * p
        logs = np.log(p)[inverse]
        totals = np.stack([np.bincount(number, logs[:, k], len(names)) for k in range(self.classes)], axis=1)
        return totals.astype(np.float32), np.bincount(number, minlength=len(names))


class Memo:
    """Scores of words met so far in a worker, dropped when ``MEMO`` words are held."""

    def __init__(self, model: ByteModel):
        self.model, self.place, self.rows, self.sizes = model, {}, np.zeros((0, model.classes), np.float32), np.zeros(0, np.int64)

    def look_up(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Rows of ``rows`` and ``sizes`` for each word of each text; valid until the next call."""
        if len(self.place) > MEMO:
            self.__init__(self.model)
        fresh = sorted({w for t in texts for w in t if w not in self.place})
        if fresh:
            found = [self.model.score(fresh[at:at + FRESH]) for at in range(0, len(fresh), FRESH)]
            self.place.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh))))
            self.rows = np.concatenate([self.rows, *(rows for rows, _ in found)])
            self.sizes = np.concatenate([self.sizes, *(sizes for _, sizes in found)])
        return [np.fromiter(map(self.place.__getitem__, t), np.int64, len(t)) for t in texts]
