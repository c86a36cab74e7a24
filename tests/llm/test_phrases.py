"""Phrase mining against plain counting, with odd texts, ties, repeated rows, several rounds and empty tables."""

import re
from collections import Counter

import numpy as np
import pytest

from colmetry.llm import phrases

SCHEMA = "doc_id long, text string, lang string, h1 long, a long, word string"


def brute(rows, limit, least):
    counts, sizes = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            sizes[lang] += len(words)
            for k in (1, 2, 3):
                counts.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    found = {}
    for key, a in counts.items():
        if len(key) > 2 and a >= least:
            lang, *words = key
            cuts = [(phrases.SCALE * a * a // (counts[(lang, *words[:k])] * counts[(lang, *words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found[key] = (score, a, counts[(lang, *words[:k])], counts[(lang, *words[k:])])
    out = []
    for lang in sizes:
        own = []
        for key, (score, a, left, right) in found.items():
            if key[0] != lang:
                continue
            around = [o for o in found if o[0] == lang and len(o) == 4 and len(key) == 3 and key[1:] in (o[1:3], o[2:4])]
            if not any(100 * found[o][1] >= 50 * a for o in around):
                own.append((-score, -a, " ".join(key[1:]).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def found(frame, **more):
    return sorted(tuple(r) for r in phrases.mine(frame, **more).collect())


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "w") for r in rows], SCHEMA)


@pytest.mark.parametrize("frontier", [1, 6, 1000])
def test_phrases_are_those_of_counting_all(spark, frontier):
    rng = np.random.default_rng(2)
    vocabulary = ["Alpha", "beta", "gamma", "delta", "eps", "zeta", "Éta", "theta", "ι", "kappa", "«", "a\x1cb", "x\x00"]
    rows = []
    for k in range(120):
        words = [vocabulary[i] for i in rng.zipf(1.5, 30) % len(vocabulary)]
        if k % 3:
            words[5:8] = ["new", "york", "city"]
        if k % 4:
            words[10:12] = ["red", "tape"]
        text = " ".join(words[:15]) + ",\t" + "  ".join(words[15:]) + ["", ".", "\r\n!"][k % 3]
        rows.append((k, text, ["en", None, "fr", "und"][k % 4]))
    rows += [rows[1], rows[1], (None, None, "en"), (1, "", "xx"), (2, " \t ", "xx"), (3, "lone", "xx"), (4, "na " * 3000, "en")]
    # Few phrases wanted, so the frontier has to grow for some languages and not for others.
    assert found(frame_of(spark, rows), limit=12, least=3, frontier=frontier) == brute(rows, 12, 3)


def test_ties_go_to_the_last_wanted_one_and_empty_tables_have_no_rows(spark):
    rows = [(k, f"p{k % 40} q{k % 40}. r{k % 40} s{k % 40}", "en") for k in range(400)]
    frame = frame_of(spark, rows)
    assert found(frame, limit=7, frontier=1) == brute(rows, 7, 10)
    assert found(frame.limit(0)) == [] and found(frame.limit(3)) == []


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    a, left, right = 123456789012345, 987654321098765, 135791357913579
    row = spark.range(1).select(phrases.score_of(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()
    assert row["s"] == phrases.SCALE * a * a // (left * right)


def test_a_small_filter_changes_nothing(monkeypatch):
    hashes = np.random.default_rng(1).integers(0, 2 ** 63, 5000, dtype=np.uint64)
    full = phrases.Bloom(len(hashes), 1 << 10)
    full.add(hashes)
    wide = phrases.Bloom(len(hashes))
    wide.add(hashes[:2500])
    assert full.holds(hashes).all() and wide.holds(hashes[:2500]).all() and wide.holds(hashes[2500:]).mean() < 0.1
