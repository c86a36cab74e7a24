"""The pipeline's stages against what plain Python says of planted documents."""

import corpus_pipeline
from colmetry.llm import decontamination, line_quality, mixing, simhash

WORDS = "river mill stone bridge water garden letter window harbour island winter summer market village teacher doctor".split()


def prose(seed):
    return " ".join(WORDS[(seed * 7 + i * (seed % 5 + 3) + i * i) % len(WORDS)] + str((seed * 13 + i) % 97) for i in range(60)) + "."


def test_stages(spark, tmp_path):
    item = "Who built the long bridge over the silver water near the harbour?\nThe doctor and the teacher built it in one summer."
    rows = [(i, prose(i), "en", f"s{i % 3}", len(prose(i))) for i in range(40)]
    rows += [(50, prose(1), "en", "s0", 1), (51, prose(2) + "\n" + item, "de", "s1", 1), (52, "HOME | ABOUT | NEWS", "en", "s2", 1),
             (53, None, None, None, None), (54, "word " * 400, "en", "s0", 2000)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        kept[k] = docs
    ids = {k: {r["doc_id"] for r in kept[k].select("doc_id").collect()} for k in range(4)}
    assert ids[0] == {*range(40), 50, 51} and ids[1] == ids[0] - {50} and ids[2] == ids[1] - {51}
    assert ids[3] < ids[2] and ids[3]
    assert {d for r in kept[4].collect() for d in r["doc_ids"]} == ids[3]
    whole = corpus_pipeline.run(spark, folder)
    assert {d for r in whole.collect() for d in r["doc_ids"]} == ids[3]


def test_no_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for out in (line_quality.clean(docs), simhash.keep_first(docs), mixing.sample(docs),
                decontamination.decontaminate(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))):
        assert out.count() == 0 and out.columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
