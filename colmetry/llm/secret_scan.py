"""Secret scan: a random forest removes false positives among candidate strings. Spark expressions and Spark's own forest only.

Candidates are strings inside the words of a text, wherever quotes, brackets, links or code put them: runs of at least ``LEAST`` characters
of the alphabets of keys and tokens; what is assigned to a key name, by ``=`` or ``:`` within the word (quoted names and link parameters
too) or in the words before, from ``SHORT`` characters and of any characters; and the password of a link's user. All need a digit or a
change of case, and rejecting is left to the forest. They are described by length, character shares and transitions, dictionary coverage,
the path the text came from, and the words before and after. The forest is trained on labelled findings, at most ``FINDINGS`` of each
label (a documented bound); where none are given, findings are labelled by the fixed formats and key names below, which the scan's features
see only in part.

Defined cases: null and empty texts have no candidates; repeated strings and rows are findings each; null path is empty; if all
findings have one label, that label decides; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colmetry.llm.texts import plain, stage, words

LEAST, SHORT, FINDINGS, TREES, DEPTH, SECRET_FROM = 12, 6, 10_000, 30, 6, 0.5
MIXED = r"[0-9]|[a-z][A-Z]"
RUN = rf"[A-Za-z0-9+/_.-]{{{LEAST},}}={{0,2}}"
ASSIGNED = rf"""([A-Za-z][A-Za-z0-9_.-]{{1,40}})["']?[:=]["']?([^\s"',;&<>(){{}}\[\]]{{{SHORT},}})"""
LINK_USER = rf"""://[^\s/:@]+:([^\s/@]{{{SHORT},}})@"""
# Quotes, brackets and marks around a word.
AROUND = r"""^["'(\[{<]+|["')\]}>,;:.!?#]+$"""
# Formats of issued keys, and names that keys are assigned to.
ISSUED = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[abpr]-[A-Za-z0-9-]{10,}$|^AIza[0-9A-Za-z_-]{35}$|^sk_live_[0-9A-Za-z]{16,}$"
KEY_NAME = r"(?i)(pass(word|wd)?|secret|token|api_?key|auth|credential|access_?key|private)"
# Words before a value that announce it.
ANNOUNCED = r"(?i)(\S*(?:pass(?:word|wd)?|secret|token|api_?key|auth|credential|access_?key|private)\S*)\s*(?:(?<=[=:])|[=:]|\bis)$"
HARMLESS = r"(?i)(example|sample|dummy|placeholder|changeme|test|fake|xxxx)"
DICTIONARY = ("about|access|account|after|before|change|client|common|data|default|document|error|example|file|first|from|http|image|index|"
              "information|level|license|list|local|message|name|number|object|other|page|people|project|public|release|sample|server|"
              "service|should|state|system|table|test|text|that|their|there|this|time|user|value|version|which|with|world|year")
FEATURES = ["length", "digits", "uppers", "symbols", "turns", "kinds", "dictionary", "harmless_path", "path_depth", "key_name", "key_before",
            "harmless_near", "vowels", "longest_letters"]


def candidates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row per candidate: id, path, place (number of the word), before, after, key (name it is assigned to, may be empty), value."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), plain(F.col(path).cast("string")).alias("path"), words(plain(text)).alias("w"))
    places = F.filter(F.transform("w", lambda w, i: F.when((F.length(w) >= SHORT) & w.rlike(MIXED), i)), lambda i: i.isNotNull())
    near = rows.select("doc_id", "path", F.explode(F.transform(places, lambda i: F.struct(
        i.alias("place"), F.get("w", i).alias("word"), F.get("w", i - 2).alias("two"), F.get("w", i - 1).alias("one"),
        F.coalesce(F.get("w", i + 1), F.lit("")).alias("after")))).alias("c")).select(
        "doc_id", "path", "c.*", F.concat_ws(" ", "c.two", "c.one").alias("before"))

    def named(key: Column, value: Column) -> Column:
        return F.struct(key.alias("key"), value.alias("value"))

    pairs = F.arrays_zip(F.regexp_extract_all("word", F.lit(ASSIGNED), 1).alias("k"), F.regexp_extract_all("word", F.lit(ASSIGNED), 2).alias("v"))
    assigned = F.filter(F.transform(pairs, lambda p: named(p["k"], F.regexp_replace(p["v"], AROUND, ""))), lambda c: c.key.rlike(KEY_NAME))
    of_user = F.transform(F.regexp_extract_all("word", F.lit(LINK_USER), 1), lambda v: named(F.lit("link_password"), v))
    bare = F.regexp_replace("word", AROUND, "")
    announced = F.col("before").rlike(ANNOUNCED) & ~bare.rlike("[:=]")
    following = F.when(announced, F.array(named(F.regexp_extract("before", ANNOUNCED, 1), bare))).otherwise(F.array())
    sure = near.withColumn("sure", F.filter(F.concat(assigned, of_user, following), lambda c: (F.length(c.value) >= SHORT) & c.value.rlike(MIXED)))
    # Runs that such a value holds already are no candidates of their own.
    runs = F.filter(F.regexp_extract_all("word", F.lit(RUN), 0), lambda run: run.rlike(MIXED) & ~F.exists("sure", lambda c: F.contains(c.value, run)))
    name = F.regexp_extract("word", ASSIGNED, 1)
    every = F.concat("sure", F.transform(runs, lambda run: named(name, run)))
    return sure.select("doc_id", "path", "place", "before", "after", F.inline(F.array_distinct(every)))


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def describe(found: DataFrame) -> DataFrame:
    """The columns of ``FEATURES`` beside the candidate's own."""
    covered = F.length(F.regexp_replace(F.lower("value"), DICTIONARY, ""))
    return found.withColumns({
        "length": F.length("value").cast("double"), "digits": _share("[0-9]"), "uppers": _share("[A-Z]"), "symbols": _share("[^A-Za-z0-9]"),
        "turns": _share("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]"),
        "kinds": F.size(F.array_distinct(F.split("value", ""))) / F.length("value"),
        "dictionary": 1 - covered / F.length("value"),
        "harmless_path": F.col("path").rlike(HARMLESS).cast("double"),
        "path_depth": (F.size(F.split("path", "/")) - 1).cast("double"),
        "key_name": F.col("key").rlike(KEY_NAME).cast("double"), "key_before": F.col("before").rlike(KEY_NAME).cast("double"),
        "harmless_near": F.concat_ws(" ", "before", "after", "key").rlike(HARMLESS).cast("double"), "vowels": _share("(?i)[aeiou]"),
        "longest_letters": F.array_max(F.transform(F.split("value", "[^A-Za-z]+"), lambda s: F.length(s))).cast("double"),
    })


def label_findings(described: DataFrame) -> DataFrame:
    """``label`` 1 for issued formats and for random strings assigned to a key name without a harmless word near, 0 for the rest."""
    assigned = F.col("key").rlike(KEY_NAME) | F.col("before").rlike(KEY_NAME.replace("(?i)", r"(?i)\b") + r"\b\S*\s*[=:]?$")
    random = (F.col("digits") > 0.1) & (F.col("digits") < 1) & (F.col("dictionary") < 0.3)
    return described.withColumn("label", (
        (F.col("value").rlike(ISSUED) | (assigned & random)) & (F.col("harmless_near") == 0)).cast("double"))


def train(findings: DataFrame, seed: int = 5):
    """A forest over rows of ``FEATURES`` and ``label``; None if there are not both labels, then the one label there is."""
    order = F.xxhash64(F.lit(seed), "doc_id", "place", "value")
    picked = None
    for label in (0.0, 1.0):
        rows = findings.where(F.col("label") == label).withColumn("o", order).orderBy("o", "doc_id", "place", "value").limit(FINDINGS)
        picked = rows if picked is None else picked.unionByName(rows)
    picked = stage(picked.select(*FEATURES, "label"))
    labels = [r["label"] for r in picked.select("label").distinct().collect()]
    if len(labels) < 2:
        return None, (labels[0] if labels else 0.0)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, labelCol="label", featuresCol="features")
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(picked)), None


def scan(documents: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One row per candidate: doc_id, place, key, value, score (forest's probability of a secret), secret."""
    described = describe(candidates(documents))
    model, only = train(findings if findings is not None else label_findings(described))
    if model is None:
        scored = described.withColumn("score", F.lit(only))
    else:
        featured = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described)
        scored = model.transform(featured).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "place", "key", "value", "score", (F.col("score") >= SECRET_FROM).alias("secret"))
