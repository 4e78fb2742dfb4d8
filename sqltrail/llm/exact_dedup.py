"""Exact dedup by progressive refinement: length, then a hash of the prefix, then a hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltrail.llm.common import in_map, slot_map, slot_of, stored, text_of

#: Characters of the second step.
PREFIX_CHARS = 256
#: Slots of the maps that say which keys occur more than once: their size, whatever the input's.
SLOTS = 1 << 18


def _slot(*key: Column) -> Column:
    return slot_of(*key, slots=SLOTS)


def _repeated(slots: DataFrame) -> Column:
    """The map of slots in which more than one row fell."""
    return slot_map(slots.groupBy("slot").count().where("count > 1"), SLOTS)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Groups of identical texts: `doc_id, n_bytes, full_hash, keep_id, group_size, kept`, one row per input row.

    Lengths are counted first; prefixes are hashed where a length may repeat, and whole texts where
    length and prefix may. The maps of repeated keys have a fixed size and may only let through too
    much, so every equal pair reaches the SHA-256 of the whole text. `digest` adds `text_sha256` for
    all rows. Texts never move: only ids and hashes are shuffled, and a hot group is counted
    per task before it is.

    Null text is the empty text, and groups with it. The largest id of a group stays; a null id is
    smaller than any other, and rows that repeat an id and a text are all marked kept if that id is.
    A group with null ids only keeps them. Other columns are ignored. No rows give no rows.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    size = F.octet_length("text")
    prefix = F.xxhash64(F.substring("text", 1, PREFIX_CHARS))

    lengths = _repeated(rows.select(_slot(size).alias("slot")))
    sized = rows.where(in_map(lengths, _slot(size)))
    starts = _repeated(sized.select(_slot(size, prefix).alias("slot")))
    survives = in_map(lengths, _slot(size)) & in_map(starts, _slot(size, prefix))

    columns = [F.col("doc_id"), size.cast("long").alias("n_bytes"), F.when(survives, F.sha2("text", 256)).alias("full_hash")]
    if digest:
        columns.append(F.sha2("text", 256).alias("text_sha256"))
    hashed = stored(rows.select(*columns))

    rest = hashed.where("full_hash IS NOT NULL")
    groups = rest.groupBy("n_bytes", "full_hash").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = rest.join(groups, ["n_bytes", "full_hash"])
    alone = hashed.where("full_hash IS NULL").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    return found.unionByName(alone.select(*found.columns)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
