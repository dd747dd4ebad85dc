"""The training-data pipeline: toxicity, quality, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a table; all but the last
return the columns of documents. Stages are joined by written Parquet, so that a lost executor costs no earlier stage.

Defined cases, in all stages: an empty table gives an empty one; a null text is an empty one, and is kept or packed as such; a
null doc_id stays null; rows that repeat are kept or dropped alike, also as near-duplicates, which go by doc_id; texts are read
whole, however long; further columns stay as they are, whatever their names. Scores at a threshold decide as the stage says.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, nbsvm, near_dedup, packing, toxicity
from panelspark.llm.storage import clear, cut, written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learnt from; the others are held out for judging."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted lexicon scores below 0.3."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, _labels(spark, sf_dir)))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7."""
    return nbsvm.keep_good(docs, nbsvm.learn(docs, _labels(spark, sf_dir)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: sets of five-word shingles with a similarity of 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark windows."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 4096 tokens."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")), docs.count())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: The trained classifiers and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. What a stage wrote is deleted once its result is written; the last one's input stays."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        clear(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
