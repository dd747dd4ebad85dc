"""The pipeline's stages against their operators, on the smallest tables."""

import corpus_pipeline
from pyspark.sql import functions as F

from panelspark.llm import near_dedup, queries, storage

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "decontaminate", "packing"]
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {tuple(r) for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and {tuple(r) for r in docs.collect()} <= before and 0 < docs.count() <= left
        left = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}


def test_decisions_are_those_of_the_queries(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    gone = lambda stage: {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in stage(spark, docs, SF).collect()}
    stages = dict(corpus_pipeline.STAGES)
    bad = lambda name, condition: {r["doc_id"] for r in queries.QUERIES[name](spark, SF).filter(condition).collect()}
    assert gone(stages["toxicity"]) == bad("op9_lexicon", "predicted = 1")
    assert gone(stages["quality"]) == bad("op5_nbsvm", "predicted = 0")
    assert gone(stages["near_dedup"]) == {r["doc_id"] for r in near_dedup.near_duplicates(docs, 5).filter("NOT kept").collect()}
    assert gone(stages["decontaminate"]) == bad("op8_wu_manber", "contaminated")


def test_empty_and_odd_documents(spark):
    """Columns named as operators name their own, nulls, empty and very long texts, repeated rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = [(None, "word one two"), (900_007, None), (900_007, None), (900_008, ""), (900_009, "long words " * 60_000), (900_010, None)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    clashing = ["_gone", "_group", "_kept_row", "_row", "_Gone_", "score", "n_words", "component_id", "part", "block"]
    rows = rows.select("*", *(F.lit("x").alias(c) for c in clashing))
    every = {tuple(r) for r in rows.collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.limit(0), SF).count() == 0, name
        out = stage(spark, rows, SF).collect()
        if name == "packing":
            assert {r["doc_id"] for r in out} == {r[0] for r in every}
            assert sum(r["length"] for r in out if r["doc_id"] == 900_007) == 2
            continue
        assert {tuple(r) for r in out} <= every and out[0].__fields__ == rows.columns, name
        if name in ("near_dedup", "decontaminate"):  # without words, nothing is linked and nothing hit
            assert {r["doc_id"] for r in out} >= {900_007, 900_008, 900_010}, name


def test_a_run_leaves_one_table(spark):
    """Stages' tables go as soon as the next one's input is written; tables of other jobs stay."""
    other = storage.cut(spark.range(3), "other")
    before = storage.written()
    packed = corpus_pipeline.run(spark, SF)
    assert storage.written() == before + 1
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(packed.collect()) == sorted(docs.collect()) and other.count() == 3
    storage.clear(spark, before)
    assert storage.written() == before and other.count() == 3
