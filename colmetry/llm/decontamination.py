"""Benchmark decontamination: every training passage queries a BM25 index of the test items by block-max WAND; hits are verified.

Words are lower-case runs without punctuation. Passages are ``PASSAGE`` words long and start every half of that, so all of a document
is queried. An item matches a passage if its BM25 score is at least ``SHARE`` of what the item itself would reach in a passage of that
length. Impacts are divided by each item's own threshold, so one threshold, 1, serves all: a passage whose greatest impacts together
stay below 1, over all items and then over every one of ``RANGES`` or more ranges of items, is dropped at once, the others walk the posting lists, pivoting on list maxima and skipping blocks by block maxima.
Hits are verified on the document's text around the passage: ``OVERLAP`` of the five-word shingles of the question and of the answer
have to be there. An item's answer is its last line, else its last sentence; an item of one sentence is all question.

The index travels to every task, so it is built for ``INDEX_CHARS`` characters of items at a time (a size bound); more items are
further runs over the documents. Document frequencies are those of all items.

Defined cases: null and empty texts match nothing, nor do items without a word; equal items are each reported; equal rows are reported
once per id; null ids are reported as null; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmetry.llm.texts import plain, stage

PASSAGE, SHARE, OVERLAP, SHINGLE = 128, 0.5, 0.8, 5
K1, B, BLOCK, RANGES = 1.2, 0.75, 16, 32
INDEX_CHARS, BOUNDS = 32 << 20, 1 << 23
WORDS_AT_ONCE = 400_000
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
# Marks beyond ASCII that part words: Latin signs, Armenian, Arabic, Devanagari, Myanmar, Ethiopic and Khmer marks, general punctuation,
# those of Chinese and Japanese, and the full-width forms of ASCII's.
_MARKS = re.compile("[\u00a0-\u00bf\u0589\u060c\u061b\u061f\u06d4\u0964\u0965\u104a\u104b\u1361-\u1368\u17d4-\u17d6\u2000-\u206f"
                    "\u3000-\u303f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def tokens(text: str) -> list[bytes]:
    if not text.isascii():
        text = _MARKS.sub(" ", text).lower()
    return text.encode("utf-8").translate(_ASCII).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    lines = [line for line in text.split("\n") if tokens(line)]
    if len(lines) < 2:
        lines = [s for s in re.split(r"(?<=[.?!])\s+", text) if tokens(s)]
    if len(lines) < 2:
        return tokens(text), []
    return tokens("\n".join(lines[:-1])), tokens(lines[-1])


def shingles(words: list[bytes]) -> set[bytes]:
    if not words:
        return set()
    n = min(SHINGLE, len(words))
    return {b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)}


class Index:
    """Posting lists of items by word: item numbers, impacts over the item's threshold, greatest impact, greatest per block of items."""

    def __init__(self, items: list[tuple[object, str]], frequency: dict[bytes, int], all_items: int, mean_words: float):
        self.names, self.parts, lists = [i for i, _ in items], [], defaultdict(list)
        for k, (_, text) in enumerate(items):
            question, answer = question_and_answer(text)
            self.parts.append((question, answer))
            counts = Counter(question + answer)
            size = sum(counts.values())
            impact = {w: np.log1p((all_items - frequency[w] + 0.5) / (frequency[w] + 0.5)) * n * (K1 + 1)
                      / (n + K1 * (1 - B + B * size / mean_words)) for w, n in counts.items()}
            # A passage can hold half its length of an item for certain.
            threshold = SHARE * sum(impact.values()) * min(1, PASSAGE / 2 / max(1, size))
            for w, x in impact.items():
                lists[w].append((k, x / threshold))
        self.words = {w: k for k, w in enumerate(lists)}
        self.items = [[k for k, _ in own] for own in lists.values()]
        self.impacts = [[x for _, x in own] for own in lists.values()]
        self.greatest = np.array([max(own) for own in self.impacts])
        self.blocks = [_block_maxima(i, x) for i, x in zip(self.items, self.impacts)]
        # Greatest impacts by word over each of a few ranges of items, for bounds of many passages at once.
        ranges = min(max(1, len(items)), max(RANGES, BOUNDS // max(1, len(self.words))))
        self.ranges = np.zeros((len(self.words), ranges), np.float32)
        for t, (own, impacts) in enumerate(zip(self.items, self.impacts)):
            np.maximum.at(self.ranges[t], np.array(own) * ranges // len(items), impacts)

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Items with a score of at least 1 and their scores, by block-max WAND over distinct ``terms``."""
        found, cursors = [], [[self.items[t][0], 0, t] for t in terms]
        greatest, end = self.greatest, len(self.names)
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += greatest[t]
                if bound >= 1:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.blocks[t].get(block, 0.0) for _, _, t in cursors[:pivot + 1]) < 1:
                # Nothing up to the end of the block, or to the next list beyond the pivot, can reach the threshold.
                goal = min((block + 1) * BLOCK, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end)
                goal = max(goal, item + 1)
            elif cursors[0][0] == item:
                score = sum(self.impacts[t][at] for _, at, t in cursors[:pivot + 1])
                if score >= 1:
                    found.append((item, score))
                goal = item + 1
            else:
                goal = item
            for cursor in cursors[:pivot + 1]:
                if cursor[0] < goal:
                    own = self.items[cursor[2]]
                    cursor[1] = bisect_left(own, goal, cursor[1])
                    cursor[0] = own[cursor[1]] if cursor[1] < len(own) else end
            cursors = [c for c in cursors if c[0] < end]
        return found


def _block_maxima(items: list[int], impacts: list[float]) -> dict[int, float]:
    out: dict[int, float] = {}
    for item, impact in zip(items, impacts):
        out[item // BLOCK] = max(out.get(item // BLOCK, 0.0), impact)
    return out


def search_passages(index: Index, split: list[list[bytes]]) -> Iterator[tuple[int, int, int, float]]:
    """(text, first word of the passage, item, score) for every passage and item at or above the threshold."""
    step, vocabulary, found_before = PASSAGE // 2, max(1, len(index.words)), {}
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    known = np.fromiter((index.words.get(w, -1) for t in split for w in t), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(split)), sizes)
    place = np.arange(len(known)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # Windows of a text: one for each half passage that begins in it; a word is in its own and in the one before.
    windows = np.maximum(1, -(-sizes // step))
    first = np.cumsum(windows) - windows
    at = np.flatnonzero(known >= 0)
    half = place[at] // step
    own = first[owner[at]] + half
    keys = np.unique(np.concatenate([own, own[half > 0] - 1]) * vocabulary + np.concatenate([known[at], known[at][half > 0]]))
    if not len(keys):
        return
    window, term = keys // vocabulary, keys % vocabulary
    bound = np.bincount(window, index.greatest[term], int(windows.sum()))
    starts = np.searchsorted(window, np.arange(len(bound) + 1))
    text = np.repeat(np.arange(len(split)), windows)
    for w in _open_windows(index, bound, window, term, starts):
        terms = term[starts[w]:starts[w + 1]]
        seen = terms.tobytes()
        if seen not in found_before:
            found_before[seen] = index.search(terms.tolist())
        for item, score in found_before[seen]:
            yield int(text[w]), int(w - first[text[w]]) * step, item, float(score)


def _open_windows(index: Index, bound: np.ndarray, window: np.ndarray, term: np.ndarray, starts: np.ndarray) -> Iterator[int]:
    """Windows whose greatest impacts reach 1 within some range of items; the margin covers rounding."""
    likely = np.flatnonzero(bound >= 1 - 1e-4)
    at_once = max(16, (1 << 22) // (64 * index.ranges.shape[1]))
    for at in range(0, len(likely), at_once):
        some = likely[at:at + at_once]
        pairs = np.concatenate([np.arange(starts[w], starts[w + 1]) for w in some])
        sizes = starts[some + 1] - starts[some]
        within = np.add.reduceat(index.ranges[term[pairs]], np.cumsum(sizes) - sizes, axis=0).max(axis=1)
        yield from some[within >= 1 - 1e-4].tolist()


def find(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text") -> DataFrame:
    """One row per document id and item that is verified: id, item id, bm25 (over the item's threshold), question_overlap,
    answer_overlap, first_word (of the best passage)."""
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).alias("doc_id"), plain(text).alias("text"))
    items = benchmark.select(F.col(item_id).alias("item_id"), plain(item_text).alias("text"))
    frequency, sizes = Counter(), []
    schema = (f"doc_id {documents.schema[doc_id].dataType.simpleString()}, item_id {benchmark.schema[item_id].dataType.simpleString()}, "
              "bm25 double, question_overlap double, answer_overlap double, first_word long")
    groups: list[list] = [[]]
    held = 0
    for item in items.orderBy("item_id", "text").toLocalIterator():
        words = [w for part in question_and_answer(item["text"]) for w in part]
        if not words:
            continue
        frequency.update(set(words))
        sizes.append(len(words))
        if held + len(item["text"]) > INDEX_CHARS and groups[-1]:
            groups.append([])
            held = 0
        held += len(item["text"])
        groups[-1].append((item["item_id"], item["text"]))
    matched = None
    for group in groups:
        index = spark.sparkContext.broadcast(Index(group, frequency, len(sizes), float(np.mean(sizes)) if sizes else 1.0))
        part = rows.mapInPandas(_matcher(index), schema)
        matched = part if matched is None else matched.unionByName(part)
    best = matched.groupBy("doc_id", "item_id").agg(F.max_by(F.struct(
        "bm25", "question_overlap", "answer_overlap", "first_word"), F.struct("bm25", -F.col("first_word"))).alias("b"))
    return best.select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "b.*")


def _matcher(index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, sought = index.value, {}
        for batch in batches:
            start, held, split = 0, 0, []
            for k, t in enumerate(batch["text"]):
                split.append(tokens(t))
                held += len(split[-1])
                if held > WORDS_AT_ONCE or k == len(batch) - 1:
                    yield verify(own, sought, batch["doc_id"].iloc[start:k + 1], split)
                    start, held, split = k + 1, 0, []

    def verify(own: Index, sought: dict, ids: pd.Series, split: list[list[bytes]]) -> pd.DataFrame:
        best: dict[tuple[int, int], tuple] = {}
        for text, first, item, score in search_passages(own, split):
            if item not in sought:
                sought[item] = [shingles(part) for part in own.parts[item]]
            reach = sum(map(len, own.parts[item]))
            around = split[text][max(0, first - reach):first + PASSAGE + reach]
            have = {}
            overlaps = []
            for part, wanted in zip(own.parts[item], sought[item]):
                n = min(SHINGLE, len(part))
                if n and n not in have:
                    have[n] = {b" ".join(around[i:i + n]) for i in range(len(around) - n + 1)}
                overlaps.append(len(wanted & have[n]) / len(wanted) if n else 1.0)
            if min(overlaps) >= OVERLAP:
                best[text, item] = max(best.get((text, item), (0.0,)), (score, *overlaps, first))
        values = ids.to_numpy()
        return pd.DataFrame([(values[t], own.names[i], *b) for (t, i), b in best.items()],
                            columns=["doc_id", "item_id", "bm25", "question_overlap", "answer_overlap", "first_word"])

    return run


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a verified match, columns as in ``documents``; rows with one id are one document."""
    dirty = stage(find(documents, benchmark).select(F.col("doc_id").alias("dirty_id")).distinct())
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.col("doc_id").alias("own_id"))
    return rows.join(dirty, F.col("own_id").eqNullSafe(F.col("dirty_id")), "left_anti").select("row.*")
