"""The registered queries: each applies an operator to whole tables and derives digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import burst_trie, chat, decontaminate, hard_negatives, jaccard_forest, licenses, line_join, mixing, pii, repetition, substring_rlz, token_store, warc
from ._store import dropped, stored, text_batches

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return warc.through_warc(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return substring_rlz.remove_repeated_spans(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = decontaminate.match_items(docs.select("doc_id", "text"), items)
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), decontaminate.items_digest(F.col("items")).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_join.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_store.token_output(docs, tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return jaccard_forest.jaccard_classes(docs)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.scan_licenses(docs).select("doc_id", "canonical_sha256", "license_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.replicate(docs).select("doc_id", "source", "n_chars", "n_copies", "copy", "shuffle_key")


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return repetition.quality_rules(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return chat.through_format(chat.threads(rows.unionByName(extra))).drop("branch")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(burst_trie.numbered_turns(_table(spark, sf_dir, "conversations")), "trie-turns")
    nodes = burst_trie.prefix_trie(burst_trie.rebuilt(turns))
    dropped(turns)
    return nodes


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.quantised(_table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pii_digests(pii.find_pii(docs))


QUERIES = {f.__name__: f for f in (op1_warc, op2_substring_dedup, op3_decontamination, op4_line_dedup, op5_token_output, op6_jaccard_join, op7_license_scan, op8_mixing, op9_repetition, op10_chat_format, op11_prefix_trie, op12_hard_negatives, op13_pii)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return {**ORACLES, "op7_license_scan": licenses.oracle_sql(), "op8_mixing": mixing.oracle_sql(), "op13_pii": pii.oracle_sql()}
