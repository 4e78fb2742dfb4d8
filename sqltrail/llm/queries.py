"""The operators over the given tables, and the same questions in SQL where SQL can ask them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltrail.llm.bpe import encode_documents
from sqltrail.llm.brown_lm import class_model_scores
from sqltrail.llm.conversation_repair import damaged, repaired_conversations
from sqltrail.llm.conversation_trie import prefix_trie, rebuilt_turns
from sqltrail.llm.decontamination import contaminated_words
from sqltrail.llm.exact_dedup import exact_groups
from sqltrail.llm.imatch import edited_likeness
from sqltrail.llm.licenses import scan_licenses
from sqltrail.llm.packing import pack_documents
from sqltrail.llm.simhash import simhash_groups
from sqltrail.llm.suffix_dedup import removal_digests
from sqltrail.llm.token_counts import count_tokens, token_blocks, write_token_files
from sqltrail.llm.toxicity import toxicity_scores


#: The end-of-text id of the vocabulary.
END_OF_TEXT = 50256


def vocabulary() -> str:
    """The vocabulary file of the encoding query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), vocabulary(), digests=True)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as flat files of tokens, and the tokens of each document found in those files again."""
    folder = write_token_files(_table(spark, sf_dir, "documents"), vocabulary(), END_OF_TEXT)
    found = count_tokens(token_blocks(spark, folder), END_OF_TEXT)
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("int")
    return found.select(part.alias("file"), "doc_no", "start", "n_tokens", "ended")


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_model_scores(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(_table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(damaged(_table(spark, sf_dir, "conversations")), copies_col="copies")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = rebuilt_turns(_table(spark, sf_dir, "conversations"))
    return prefix_trie(turns, convs)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_words(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_bpe_codec, op3_license_scan, op4_token_counts, op5_brown_lm, op6_best_fit_packing, op7_imatch, op8_simhash,
        op9_suffix_array_dedup, op10_exact_dedup, op11_conversation_repair, op12_prefix_trie, op13_decontamination,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
