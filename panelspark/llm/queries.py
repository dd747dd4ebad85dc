"""The numbered queries: each applies one operator of this folder, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, byte_bpe, conversation_repair, decontaminate, hard_negatives, nbsvm, near_dedup, packing, perspectives, sharding, topk, toxicity, url_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = [(k, 1.0) for k in range(16)]
    out = sharding.shard_documents(_table(spark, sf_dir, "documents"), shards, (16, 1.0))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces, docs.count())


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def _folded(of: str, parts: int, out: int) -> Column:
    """Whether crc32 of the id as text, modulo parts, is `out`."""
    return F.crc32(F.col(of).cast("string").cast("binary")) % parts == out


def op1_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = brown.score(_table(spark, sf_dir, "documents"), ~_folded("doc_id", 10, 0))
    return out.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op4_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_rules.Rule("allow", "org", "/"), url_rules.Rule("block", "example.org", "/es/"), url_rules.Rule("block", "example.org", "/en/1"), url_rules.Rule("allow", "com", "/fr/"), url_rules.Rule("block", "com", "/de/")]
    return url_rules.judge(_table(spark, sf_dir, "pages"), rules)


def op5_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = nbsvm.learn(docs, labels.filter(~_folded("doc_id", 4, 2)), "quality")
    return nbsvm.scored(docs, model).select("doc_id", _folded("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(_table(spark, sf_dir, "conversations")).withColumn("mask", perspectives.mask_text())


def op9_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels.filter(~_folded("doc_id", 4, 2)), "toxic")
    return toxicity.scored(docs, lexicon).select("doc_id", _folded("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    placed = conversation_repair.mark(conversation_repair.damage(rows))
    edits, costs = conversation_repair.repair(placed)
    return conversation_repair.report(placed, edits, costs, rows)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(topk.quantised(rows.withColumn("label", moved), keep=["label"]), F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_brown_classes,
        op2_rendezvous,
        op3_ffd_packing,
        op4_association_rules,
        op5_nbsvm,
        op6_hyperminhash,
        op7_perspectives,
        op8_wu_manber,
        op9_lexicon,
        op10_ball_tree,
        op11_conversation_repair,
        op12_byte_bpe,
        op13_hard_negatives,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_rendezvous": sharding.oracle_sql(16),
    "op6_hyperminhash": near_dedup.ORACLE_SQL,
    "op7_perspectives": perspectives.ORACLE_SQL,
    "op8_wu_manber": decontaminate.ORACLE_SQL,
    "op10_ball_tree": topk.ORACLE_SQL,
    "op11_conversation_repair": conversation_repair.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
