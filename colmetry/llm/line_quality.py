"""Line-first cleaning: rules judge every line, failing lines go, and a document that loses too much text is rejected.

A line with a word fails as

* navigation: two or more separators (``|``, ``»``, ``›``, ``•``, `` > ``), and more than one for every four words;
* boilerplate: it has one of the fixed phrases of licences, consent banners and page furniture, and at most ``PHRASE_WORDS`` words for
  each; a longer line only mentions them;
* repetition: one word stands four times in a row;
* punctuation: more than three in ten of its words end in symbol noise (one of ``#*$%&<>|`` or a doubled ``!`` or ``?``), or it has no
  letter, or it has more than ten words and no mark that ends or parts sentences, of any script; Thai and Lao have none and are exempt.

Blank lines neither count nor stay. A document is kept if it passes the base checks (ten words, at most a fifth of its words inside
repeated five-word windows) and its remaining lines hold at least ``min_left`` of a hundred word characters.

Defined cases: null text is empty and has no words, so it is rejected; duplicate rows are judged each on their own; an empty table
gives no rows; other columns stay out of the way, only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colmetry.llm.texts import SPACES, WORD, plain, words

WINDOW = 5
# Phrases of page furniture.
BOILERPLATE = [
    "all rights reserved", "licensed under", "this work is licensed", "license, version", "cookie", "privacy policy", "terms of use",
    "terms of service", "enable javascript", "subscribe to our", "sign up for", "log in", "click here", "share this", "read more",
]
PHRASE_WORDS = 20
# Marks that end or part sentences, by script (Latin, Greek, Armenian, Arabic, Syriac, Devanagari, Tibetan, Myanmar, Ethiopic,
# Khmer, Mongolian, general, Chinese and Japanese, half and full width).
SENTENCE_MARKS = "[.!?…:;" "·;" "։՜՞" "؛؟۔" "܀܁܂" "।॥" "།༎" "၊။" "።፤፥፧፨" "។៕៖" "᠃᠉" "‼‽⁇⁈⁉" "。" "．！？：；｡]"
UNMARKED = r"[\p{IsThai}\p{IsLao}]"
SEPARATORS = r"[|»›•]| > "
NOISY_WORD = r"(?:[#*$%&<>|]|[!?]{2,})(?=[\x20\x09-\x0D]|$)"
WORD_RUN = r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]+)(?:[\x20\x09-\x0D]+\1){3}(?:[\x20\x09-\x0D]|$)"
MIN_LEFT = 50


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule; ``line`` has at least one word."""
    n = F.regexp_count(line, F.lit(WORD + "+"))
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    furniture = F.lit(False)
    for phrase in BOILERPLATE:
        furniture = furniture | F.contains(F.lower(line), F.lit(phrase))
    # Phrases are counted only where there are any.
    furniture = furniture & (F.regexp_count(F.lower(line), F.lit("|".join(BOILERPLATE))) * PHRASE_WORDS >= n)
    return (
        ((separators >= 2) & (separators * 4 > n))
        | (F.regexp_count(line, F.lit(NOISY_WORD)) * 10 > n * 3)
        | line.rlike(WORD_RUN)
        | ~line.rlike(r"\p{L}")
        | ((n > 10) & ~line.rlike(SENTENCE_MARKS) & ~line.rlike(UNMARKED))
        | furniture
    )


def judge(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", min_left: int = MIN_LEFT) -> DataFrame:
    """One row per row of ``documents``: id, counts, ``base_failed``, ``kept`` and ``clean_text`` (the lines that stay)."""
    split = documents.select(
        F.col(doc_id).alias("id"), words(plain(text)).alias("w"), plain(text).alias("t"),
        F.filter(F.split(plain(text), "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    windows = split.select(
        "id", "lines", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0))),
            lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WINDOW))),
        )).alias("h"),
    )
    # Windows are put in order only where one of them occurs twice.
    ordered = windows.withColumn("s", F.when(
        F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    repeated = ordered.withColumn("p", F.array_sort(F.filter(F.transform("s", lambda x, k: F.when(
        (x.h == F.get("s", k + 1).h) | ((k > 0) & (x.h == F.get("s", F.greatest(k - 1, F.lit(0))).h)), x.i)), lambda i: i.isNotNull())))
    covered = F.aggregate(
        F.transform("p", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - i, F.lit(WINDOW)))),
        F.lit(0), lambda total, n: total + n)
    counted = repeated.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.filter("lines", lambda line: ~line_fails(line)).alias("good"),
    )
    left = counted.select(
        "*", F.length(F.regexp_replace(F.array_join("good", ""), SPACES, "")).cast("long").alias("left_chars"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
    )
    return left.select(
        F.col("id").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (100 * F.col("left_chars") >= min_left * F.col("word_chars"))).alias("kept"),
        "left_chars", F.array_join("good", "\n").alias("clean_text"),
    )


def clean(documents: DataFrame, min_left: int = MIN_LEFT) -> DataFrame:
    """Documents that are kept, with the text of the lines that stay; all columns of ``documents``, in order."""
    judged = judge(documents.select(F.struct("*").alias("row"), "text"), "row", "text", min_left)
    # The optimizer would move the condition below the steps of judge() and nest them all in it; it stops at a random column.
    judged = judged.withColumn("stop", F.rand(0)).where(F.col("kept") & (F.col("stop") >= 0))
    replaced = {"text": F.col("clean_text")}
    if "n_chars" in documents.columns:
        replaced["n_chars"] = F.length("clean_text").cast(documents.schema["n_chars"].dataType)
    return judged.select(*(replaced.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns))
