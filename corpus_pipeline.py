"""A corpus from raw documents to packed sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltrail.llm.common import one_of_each, stored
from sqltrail.llm.exact_dedup import exact_groups
from sqltrail.llm.packing import pack_documents
from sqltrail.llm.simhash import simhash_groups
from sqltrail.llm.suffix_dedup import cut_repeats
from sqltrail.llm.toxicity import without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not hold for toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs, labels)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row: one with the largest id."""
    found = exact_groups(docs).where("group_size > 1")
    return one_of_each(docs, found.select("doc_id", F.col("full_hash").alias("text_sha256"), "kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked, one row: one with the smallest id; a null id is larger than any other,
    and of texts that share an id the one with the smallest hash stays."""
    found = stored(simhash_groups(docs, digest=True))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_sha256")
    first = stored(found.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_sha256") == F.col("first.text_sha256"))
    return one_of_each(docs, found.join(first, "root").select("doc_id", "text_sha256", kept.alias("kept")))


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that they share with others; `n_chars` is that of what is left."""
    return cut_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place for every token of every document in sequences of the permitted lengths."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeated_strings),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot state the first and the last stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
