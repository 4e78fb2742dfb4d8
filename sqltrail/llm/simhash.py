"""SimHash near-dedup with deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltrail.llm.common import pieces, ship_code, stored, text_of
from sqltrail.llm.components import components

#: Words of a shingle, seed of its hash, and bits that linked fingerprints may differ in.
SHINGLE_WORDS, SEED, MOST_BITS = 3, 42, 2
#: Fingerprints of one signature that are compared in pairs; beyond it, `_ball_links` links them without pairs.
PAIRED = 24


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text: a bit is 1 if it is set in more than half of its shingles' hashes."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = list(accumulate((len(t) + 1 for t in tokens), initial=-1))
    width = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a + 1 : b], SEED) for a, b in zip(ends, ends[width:])), np.uint64, len(tokens) - width + 1
    )
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        found = np.fromiter((fingerprint(t or b"") for t in piece.column(1).to_pylist()), np.uint64, piece.num_rows)
        columns = [piece.column(0), pa.array(found.view(np.int64)), *piece.columns[2:]]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", *piece.schema.names[2:]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """`doc_id, fp`: the fingerprint as a signed 64-bit integer. `digest` adds `text_sha256`."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("binary").alias("text"),
        *([F.sha2(text_of(text_col), 256).alias("text_sha256")] if digest else []),
    )
    return ship_code(rows).mapInArrow(_fingerprints, "doc_id long, fp long" + ", text_sha256 string" * digest)


def _variants(nodes: DataFrame) -> DataFrame:
    """`key, fp`: 64 rows for each fingerprint.

    Of two segments of 32 bits, one differs by a bit at most if the whole differs by two or three. The
    key is a segment with one bit wildcarded, with its number and the wildcard's place above it.
    """
    place = F.explode(F.expr("sequence(0, 63)")).alias("place")
    segment = F.when(F.col("place") < 32, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND(0xFFFFFFFF)
    wildcard = F.expr("shiftleft(1L, place % 32)")
    key = segment.bitwiseAND(F.bitwise_not(wildcard)) + F.col("place") * F.lit(1 << 32)
    return nodes.select("fp", place).select(key.alias("key"), "fp")


def _ball_links(nodes: DataFrame) -> DataFrame:
    """Links for fingerprints that share a signature with many others, without pairing them.

    A fingerprint is entered under itself and its 64 neighbours at one bit. Two of them share an entry
    exactly if they differ by two bits or fewer, so each entry is linked to its smallest member.
    """
    flipped = F.expr("explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))))")
    entries = nodes.select("fp", flipped.alias("key"))
    least = entries.groupBy("key").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return entries.join(least, "key").where("fp <> a").select("a", F.col("fp").alias("b"))


def links(nodes: DataFrame, most_bits: int = MOST_BITS, paired: int = PAIRED) -> DataFrame:
    """`a, b`: links between distinct fingerprints (`nodes`: distinct, column `fp`) that connect all within `most_bits`.

    Signatures are counted first. Those of two fingerprints give their pair, those of up to `paired` are
    joined on the key; both are verified. Larger ones leave only their fingerprints, which are linked by
    shared neighbours (`_ball_links`), so no group is expanded into its pairs.
    """
    if most_bits != 2:
        raise ValueError("two segments with one wildcard, and the neighbours of large groups, hold for two bits")
    variants = _variants(nodes)
    counted = variants.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    counted = stored(counted)
    pairs = counted.where("n = 2").select("a", "b")
    # The signatures are shuffled for this join at every size, so that its cost grows as its input.
    members = stored(variants.join(counted.where("n > 2").select("key", "n").hint("merge"), "key"))
    some = members.where(f"n <= {paired}").select("key", "fp")
    joined = some.withColumnRenamed("fp", "a").join(some.withColumnRenamed("fp", "b"), "key").where("a < b").select("a", "b")
    verified = pairs.unionByName(joined).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits)
    large = members.where(f"n > {paired}").select("fp").distinct()
    return verified.unionByName(_ball_links(large)).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """`doc_id, fp, component_id`: fingerprints, and the smallest id reachable over links of two bits or fewer.

    A-Z are lower-cased, words are runs without ASCII white space. Null, empty and blank texts have
    fingerprint 0 and link like any other. A text of fewer than three words is one shingle. Equal
    fingerprints are one node, so copies are never paired. Rows with a null id get the component of
    their fingerprint, and a component of null ids only has a null id. Other columns are ignored.
    `digest` adds `text_sha256`, and `root`, the component's smallest fingerprint, which names it where ids repeat.
    """
    prints = stored(fingerprints(docs, id_col, text_col, digest))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(stored(links(nodes.select("fp"))))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "root").select("fp", "component_id", *["root"] * digest)
    return prints.join(by_print, "fp")
