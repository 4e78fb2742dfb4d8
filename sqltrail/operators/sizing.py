"""Joins that broadcast a side only after measuring it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 * 1024 * 1024

#: Words of 64 bits in a sieve, at most: 32 MB. They are sent in chunks of CHUNK_WORDS.
SIEVE_WORDS = 4 * 1024 * 1024
CHUNK_WORDS = 1024
#: Keys for which a sieve has one word, and the bits that each of them sets there.
KEYS_A_WORD = 4
BITS_A_KEY = 4
#: Types whose equal values have equal hashes.
_HASHED_ALIKE = {"string", "tinyint", "smallint", "int", "bigint", "date"}


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Count rows and text bytes of `df` in one distributed aggregate and compare with the bound."""
    width = F.octet_length(F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in df.columns]))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("size")).first()
    return row["n"] <= max_rows and (row["size"] or 0) <= max_bytes


def sieve(big: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of `big` whose key may be among those of `small`: all whose key is, and few of the others.

    A Bloom filter of the keys, sized from their number, is sent to the tasks, so rows that match nothing go before
    they are shuffled. About one other row in 150 passes. Its size is bounded: from 16 million keys on it
    grows no more and lets more rows pass, one in six at 64 million. Null keys may pass or not. Keys whose types
    differ between the sides are not sieved, as their hashes differ.
    """
    on = list(on)
    kinds = [dict(big.dtypes)[c] for c in on]
    if kinds != [dict(small.dtypes)[c] for c in on] or not set(kinds) <= _HASHED_ALIKE:
        return big
    words = min(small.count() // KEYS_A_WORD + 1, SIEVE_WORDS)
    keys = [F.col(f"`{c}`") for c in on]
    word = F.pmod(F.xxhash64(*keys), F.lit(words))
    second = F.xxhash64(F.lit("sieve"), *keys)

    def bits(number: Column) -> Column:
        """The bits of a key, each chosen by six bits of its second hash."""
        mask = F.lit(0).cast("bigint")
        for i in range(BITS_A_KEY):
            place = F.shiftrightunsigned(number, 6 * i).bitwiseAND(F.lit(63)).cast("int")
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
        return mask

    # Every word has a row, so that a chunk holds its words by position.
    every = big.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    chunks = (
        small.select(word.alias("word"), bits(second).alias("bits")).unionByName(every)
        .groupBy("word").agg(F.bit_or("bits").alias("bits"))
        .groupBy(F.floor(F.col("word") / CHUNK_WORDS).alias("_sieve_chunk"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("_sieve_words"))
    )
    wanted = F.get("_sieve_words", F.pmod(F.col("_sieve_word"), F.lit(CHUNK_WORDS)).cast("int"))
    return (
        big.withColumns({"_sieve_word": word, "_sieve_bits": bits(second)})
        .withColumn("_sieve_chunk", F.floor(F.col("_sieve_word") / CHUNK_WORDS))
        .join(F.broadcast(chunks), "_sieve_chunk")
        .filter(wanted.bitwiseAND(F.col("_sieve_bits")) == F.col("_sieve_bits"))
        .select(*[F.col(f"`{c}`") for c in big.columns])
    )


def scaled_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
    fits: bool | None = None,
    few_match: bool = False,
) -> DataFrame:
    """Join on equal columns where `big` may hold most of its rows under one key.

    A measured small side is broadcast, so `big` is not shuffled. A larger one meets it in a plain shuffle
    join, whose large partitions adaptive execution splits; no side is repeated. `fits` passes on a
    measurement already made. With `few_match`, rows of `big` that match nothing are sieved out before that
    shuffle; it is for joins that drop them.
    """
    on = list(on)
    if few_match and how not in ("inner", "left_semi"):
        raise ValueError(f"a {how} join keeps rows that match nothing")
    if fits_broadcast(small, max_rows, max_bytes) if fits is None else fits:
        return big.join(F.broadcast(small), on, how)
    return (sieve(big, small, on) if few_match else big).join(small, on, how)
