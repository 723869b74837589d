"""Registered queries of the operators for training data, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normtrace.llm import best_fit, best_fit_decreasing, chat, fill_middle, hash_forest, html_density, language, multiset_hash, pieces, prefix_trie, quality_ledger, simhash, toxicity
from normtrace.llm.oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_decreasing.pack_matrices(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    model = language.learn(docs.where(~F.col("held_out")))
    found = F.col("l")
    return docs.select("doc_id", "held_out", language.language_of(model)("text").alias("l")).select(
        "doc_id", "held_out", found["lang_pred"].alias("lang_pred"), found["score"].alias("score"))


def op4_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_pages(table(spark, sf_dir, "pages"))


ODD_TURN = "\\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of two turns that look like the template itself, read back from the output."""
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TURN).alias("text"))
    made = chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd))
    read = chat.read_chats(made.select("conv_id", "formatted", "segments", "trained"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(read)
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(table(spark, sf_dir, "documents"))


def op8_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest_documents(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest_documents(table(spark, sf_dir, "documents"))


def op12_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ledger.judge(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_bfd_packing": op2_bfd_packing,
    "op3_language": op3_language,
    "op4_hash_forest": op4_hash_forest,
    "op5_main_text": op5_main_text,
    "op6_chat": op6_chat,
    "op7_best_fit": op7_best_fit,
    "op8_multiset_hash": op8_multiset_hash,
    "op9_pieces": op9_pieces,
    "op10_toxicity": op10_toxicity,
    "op11_fill_middle": op11_fill_middle,
    "op12_quality_ledger": op12_quality_ledger,
    "op13_prefix_trie": op13_prefix_trie,
}
