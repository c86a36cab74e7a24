"""Phrase collocations: best-first growth with bounds from prefix counts.

Words are counted by language, then word pairs, then three-word phrases grown from the pairs that can still matter:

* No phrase occurs more often than its parts, so only words and pairs met ``LEAST`` times are grown.
* A pair (x, y) bounds its growth: a phrase xyz with a occurrences scores at most a * a / (f(x) * f(yz)) <= f(xy) / f(x), as a <= f(yz)
  and a <= f(xy). Pairs are taken in order of this bound.
* A pair's own place is settled once no longer phrase around it can hold half of its occurrences. Those that start with it come with its
  growth, as its bound is not below its score; those that end with it start with a pair that itself has half of its occurrences.

A round picks, for each language, the score T of about the ``frontier``-th known phrase, grows all pairs with a bound of T or more and those
that may hold a pair of that score, and counts their three-word phrases over the whole corpus. All phrases scoring T or more are then
known, and whether they survive. A language is done when ``limit`` survivors score T or more (so the last one's ties do too) or T is 0;
for the others the frontier doubles.

Words travel as 64-bit hashes, which are checked: if two words of the corpus share one, another seed is taken. Tasks hold about ``PART``
tokens at a time, as numbers, count a part's n-grams with arrays, and Spark adds up. Which words or pairs are worth sending is told to tasks by a Bloom
filter of at most ``FILTER_BITS`` bits: what passes it wrongly is only counted in vain, so the results do not depend on its size.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colmetry.llm.texts import delete_staged, plain, stage

LEAST, LIMIT, SHARE, SCALE = 10, 2000, 50, 1_000_000
PART, BATCH, FILTER_BITS, HASHES, STEPS = 250_000, 500, 1 << 28, 4, 1000
NO_LANGUAGE = "und"
_ENDS = re.compile(rb"[.,;:!?\n\x0b\x0c\r]+")
_U = np.uint64


def pieces(text: str) -> Iterator[list[bytes]]:
    """Words of each piece of a text, lower-cased (A-Z)."""
    for piece in _ENDS.split(text.encode("utf-8").lower()):
        if words := piece.split():
            yield words


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    """A hash of hashes, in order."""
    out = _U(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            out = (out ^ part) * _U(0xFF51AFD7ED558CCD)
            out = out ^ (out >> _U(32))
    return out


class Bloom:
    """A set of hashes that may hold more than was put in, never less; its size is set by the number of entries up to a fixed bound."""

    def __init__(self, entries: int, bits: int = FILTER_BITS):
        size = 1 << max(10, min(bits, 12 * max(1, entries)).bit_length() - 1)
        self.mask, self.table = _U(size - 1), np.zeros(size // 8, np.uint8)

    def places(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                at = (hashes + _U(k) * (hashes >> _U(29) | _U(1))) & self.mask
                yield (at >> _U(3)).astype(np.int64), np.uint8(1) << (at & _U(7)).astype(np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for place, bit in self.places(hashes):
            np.bitwise_or.at(self.table, place, bit)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        met = np.ones(len(hashes), bool)
        for place, bit in self.places(hashes):
            met[met] = (self.table[place[met]] & bit[met]) != 0
        return met


def _language(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8"), 7)


def bloom_of(rows: DataFrame, columns: list[str]) -> Bloom:
    """A filter of the rows' (lang, columns); tasks fill it, and only its fixed-size parts come to the driver."""
    entries = rows.count()
    size = len(Bloom(entries).table)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None
        for batch in batches:
            own = own or Bloom(entries)
            for lang, part in batch.groupby("lang"):
                own.add(_mix(_U(_language(lang)), *(part[c].to_numpy().view(np.uint64) for c in columns)))
        for at in range(0, size if own else 0, 1 << 16):
            if own.table[at:at + (1 << 16)].any():
                yield pd.DataFrame({"at": [at], "bits": [own.table[at:at + (1 << 16)].tobytes()]})

    def unite(parts: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in parts["bits"]])
        return pd.DataFrame({"at": parts["at"][:1], "bits": [bits.tobytes()]})

    whole, schema = Bloom(entries), "at long, bits binary"
    few = rows.select("lang", *columns).coalesce(max(1, min(64, entries // 100_000)))
    for row in few.mapInPandas(fill, schema).groupBy("at").applyInPandas(unite, schema).toLocalIterator():
        bits = np.frombuffer(row["bits"], np.uint8)
        whole.table[row["at"]:row["at"] + len(bits)] = bits
    return whole


class Tokens:
    """Some texts of one language: ``codes`` of their words in order (-1 ends a piece) and ``words`` by code."""

    def __init__(self):
        self._code: defaultdict[bytes, int] = defaultdict()
        self._code.default_factory = self._code.__len__
        self._codes: list[int] = []

    def add(self, text: str) -> None:
        code, codes = self._code, self._codes
        for words in pieces(text):
            codes += [code[w] for w in words]
            codes.append(-1)

    def __len__(self) -> int:
        return len(self._codes)

    @property
    def codes(self) -> np.ndarray:
        return np.array(self._codes, np.int64)

    @property
    def words(self) -> list[bytes]:
        return list(self._code)

    def hashes(self, seed: int) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self._code), np.uint64, len(self._code))


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Tokens]]:
    """Texts of a partition by language; about ``PART`` tokens are held, and the language that has most of them leaves."""
    held: defaultdict[str, Tokens] = defaultdict(Tokens)
    total = 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            before = len(held[lang])
            held[lang].add(text)
            total += len(held[lang]) - before
            if total >= PART:
                most = max(held, key=lambda k: len(held[k]))
                total -= len(held[most])
                yield most, held.pop(most)
    yield from ((lang, tokens) for lang, tokens in held.items() if len(tokens))


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), plain("text").alias("text"))


def count_words(rows: DataFrame) -> tuple[DataFrame, int]:
    """Staged (lang, word, h, f) of every word, and the seed of its hashes, with which no two words of a language share one."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, tokens in _parts(batches):
            codes, words = tokens.codes, tokens.words
            counts = np.bincount(codes[codes >= 0], minlength=len(words))
            yield pd.DataFrame({"lang": lang, "word": [w.decode("utf-8") for w in words], "f": counts})

    counted = stage(rows.mapInPandas(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f")))
    for seed in range(100):
        def named(batches: Iterator[pd.DataFrame], seed: int = seed) -> Iterator[pd.DataFrame]:
            for batch in batches:
                hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8"), seed) for w in batch["word"]), np.uint64, len(batch))
                yield batch.assign(h=hashes.view(np.int64))

        words = counted.mapInPandas(named, "lang string, word string, f long, h long")
        if words.groupBy("lang", "h").count().where("count > 1").isEmpty():
            return words, seed
    raise RuntimeError("no seed tells all words apart")


def count_grams(rows: DataFrame, length: int, seed: int, kept: Bloom, grown: Bloom | None, least: int) -> DataFrame:
    """(lang, h1 .. hn, a) of the phrases of ``length`` words met ``least`` times. ``kept`` holds the words (for pairs) or the pairs (for
    longer ones) that all parts must be, ``grown`` the pairs that the phrase must start with."""
    names = [f"h{k + 1}" for k in range(length)]
    held = rows.sparkSession.sparkContext.broadcast((kept, grown))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, grown = held.value
        for lang, tokens in _parts(batches):
            own, hashes, codes = _U(_language(lang)), tokens.hashes(seed), tokens.codes
            good = np.append(kept.holds(_mix(own, hashes)) if length == 2 else np.ones(len(hashes), bool), False)[codes]
            at = np.flatnonzero(good[:-1] & good[1:])
            size = len(hashes)
            pair, counts = np.unique(codes[at] * size + codes[at + 1], return_counts=length == 2) if length == 2 else (None, None)
            if length == 3:
                pair, place = np.unique(codes[at] * size + codes[at + 1], return_inverse=True)
                mixed = _mix(own, hashes[pair // size], hashes[pair % size])
                often, first = kept.holds(mixed), grown.holds(mixed)
                of = np.full(len(codes), -1)
                of[at] = place
                at = at[(of[at] >= 0) & (at + 2 < len(codes))]
                at = at[of[at + 1] >= 0]
                at = at[first[of[at]] & often[of[at + 1]]]
                triple, counts = np.unique(of[at] * size + codes[at + 2], return_counts=True)
                left = pair[triple // size]
                found = [left // size, left % size, triple % size]
            else:
                found = [pair // size, pair % size]
            if len(counts):
                yield pd.DataFrame({"lang": lang} | {n: hashes[c].view(np.int64) for n, c in zip(names, found)} | {"a": counts})

    schema = "lang string, " + ", ".join(f"{n} long" for n in names) + ", a long"
    return rows.mapInPandas(run, schema).groupBy("lang", *names).agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 * a * a / (left * right)), exact: products are decimals of up to 38 digits, for counts below 10^15."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * a * a, left * right).cast("long")


def _score_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs with l, r, score and ``bound``, the most that a phrase grown from them can score."""
    def of(place: str, name: str) -> DataFrame:
        return words.select("lang", F.col("h").alias(place), F.col("f").alias(name))

    known = pairs.join(of("h1", "l"), ["lang", "h1"]).join(of("h2", "r"), ["lang", "h2"])
    return known.select("lang", "h1", "h2", "a", "l", "r", score_of(F.col("a"), F.col("l"), F.col("r")).alias("score"),
                        score_of(F.col("a"), F.col("a"), F.col("l")).alias("bound"))


def _score_triples(triples: DataFrame, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Three-word phrases with the counts of their lowest cut, the first of equal ones."""
    head = pairs.select("lang", "h1", "h2", F.col("a").alias("f12"), F.col("l").alias("f1"))
    tail = pairs.select("lang", F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    known = triples.join(head, ["lang", "h1", "h2"]).join(tail, ["lang", "h2", "h3"])
    cuts = [F.struct(score_of(F.col("a"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))
            for k, left, right in ((1, F.col("f1"), F.col("f23")), (2, F.col("f12"), F.col("f3")))]
    return known.select("lang", "h1", "h2", "h3", "a", F.least(*cuts).alias("cut")).select(
        "lang", "h1", "h2", "h3", "a", "cut.l", "cut.r", "cut.score")


def _thresholds(known: DataFrame, frontier: DataFrame) -> DataFrame:
    """(lang, t): a score, a multiple of ``STEPS``, that about ``frontier`` known phrases (lang, score) reach; 0 if fewer do.

    At most a thousand and one steps of a language are ordered."""
    steps = known.groupBy("lang", F.floor(F.col("score") / STEPS).alias("step")).agg(F.count("*").alias("n"))
    running = steps.withColumn("reached", F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("step"))))
    found = running.join(frontier, "lang").where("reached >= frontier").groupBy("lang").agg((F.max("step") * STEPS).alias("t"))
    return frontier.join(found, "lang", "left").select("lang", F.coalesce("t", F.lit(0)).cast("long").alias("t"))


def _wanted(pairs: DataFrame, limits: DataFrame) -> DataFrame:
    """Pairs to grow at (lang, t): those whose bound reaches t, and those that may hold half of a pair scoring t that follows them."""
    at = pairs.join(limits, "lang")
    # The least half among scoring pairs that start with a word is what a pair ending in it must reach.
    need = at.where("score >= t").groupBy("lang", F.col("h1").alias("h2")).agg(F.min("a").alias("held"))
    before = at.join(need, ["lang", "h2"], "left")
    return before.where((F.col("bound") >= F.col("t")) | (100 * F.col("a") >= SHARE * F.col("held"))).select("lang", "h1", "h2")


def _surviving(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """Pairs and three-word phrases without the pairs inside a phrase that holds their share of occurrences."""
    inside = triples.select("lang", F.explode(F.array(
        F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("p"), F.col("a").alias("longer"))
    most = inside.groupBy("lang", "p.h1", "p.h2").agg(F.max("longer").alias("longer"))
    free = pairs.join(most, ["lang", "h1", "h2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < SHARE * F.col("a")))
    columns = ["lang", "h1", "h2", "h3", "a", "l", "r", "score"]
    return free.withColumn("h3", F.lit(None).cast("long")).select(columns).unionByName(triples.select(columns))


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts reach the tasks in batches of ``BATCH`` rows at most while this lasts, as texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH, int(before)) if int(before) > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def mine(documents: DataFrame, limit: int = LIMIT, least: int = LEAST, frontier: int | None = None) -> DataFrame:
    """The first ``limit`` phrases of every language: lang, rank, phrase, a, l, r, n, score; ties in score by a, then by phrase.

    Defined cases: a null language is ``und``; null, empty and blank texts have no words; texts repeated on several rows count each time;
    a language without a phrase of ``least`` occurrences has no rows, neither has an empty table; ``doc_id``, source and other columns are
    ignored. Whole texts count, of any length. ``frontier`` (twice the limit by default) changes the number of rounds, not the result.
    """
    with _small_batches(documents.sparkSession):
        return _mine(documents, limit, least, frontier)


def _mine(documents: DataFrame, limit: int, least: int, frontier: int | None) -> DataFrame:
    rows = _rows(documents)
    counted, seed = count_words(rows)
    words = stage(counted.where(F.col("f") >= least))
    sizes = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    pairs = stage(_score_pairs(count_grams(rows, 2, seed, bloom_of(words, ["h"]), None, least), words))
    often = bloom_of(pairs, ["h1", "h2"])

    open_ = stage(pairs.groupBy("lang").agg(F.lit(frontier or 2 * limit).cast("long").alias("frontier")))
    triples, grown = None, None
    while not open_.isEmpty():
        known = pairs.select("lang", "score") if triples is None else _surviving(pairs, triples).select("lang", "score")
        limits = stage(_thresholds(known, open_))
        wanted = _wanted(pairs, limits)
        wanted = stage((wanted if grown is None else wanted.unionByName(grown)).distinct())
        added = wanted if grown is None else wanted.join(grown, ["lang", "h1", "h2"], "left_anti")
        # A wrong pass of the filter grows a pair that was not asked for, or one grown before: those counts are the same ones.
        found = _score_triples(count_grams(rows, 3, seed, often, bloom_of(added, ["h1", "h2"]), least), pairs, words)
        triples = stage(found if triples is None else found.unionByName(triples).distinct())
        grown = wanted
        reached = _surviving(pairs, triples).join(limits, "lang").where("score >= t").groupBy("lang").agg(F.count("*").alias("reached"))
        open_ = stage(open_.join(limits, "lang").where("t > 0").join(reached, "lang", "left").where(
            F.coalesce("reached", F.lit(0)) < limit).select("lang", (2 * F.col("frontier")).alias("frontier")))
    if triples is None:
        return rows.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")

    def named(place: str) -> DataFrame:
        return words.select("lang", F.col("h").alias(place), F.col("word").alias(f"w{place}"))

    phrases = _surviving(pairs, triples)
    # Steps of scores tell which phrases can be among the first: little more than the limit and its ties are spelt and ordered.
    last = _thresholds(phrases.select("lang", "score"), phrases.groupBy("lang").agg(F.lit(limit).cast("long").alias("frontier")))
    top = stage(phrases.join(last, "lang").where("score >= t").drop("t"))
    spelt = top.join(named("h1"), ["lang", "h1"]).join(named("h2"), ["lang", "h2"]).join(named("h3"), ["lang", "h3"], "left")
    ordered = spelt.select("lang", F.concat_ws(" ", "wh1", "wh2", "wh3").alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = stage(ordered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit))
    out = ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    delete_staged(top)
    return out
