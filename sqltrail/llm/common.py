"""Helpers of the operators: stored intermediate results, and Arrow batches in bounded pieces."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import sqltrail
from sqltrail.session import ensure_checkpoint_dir

#: Bytes of text that a task works on at a time; a longer text is a piece of its own.
PIECE_BYTES = 8 << 20
#: Slots of the map of texts that are dropped; its size, whatever the input's.
TEXT_SLOTS = 1 << 20


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet below the shared checkpoint folder and read it back.

    The lineage ends there, so neither a lost executor nor a second use computes the rows again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def text_of(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def remainder(column: str, by: int) -> Column:
    """crc32 of an id as text, modulo `by`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))) % by


def slot_of(*key: Column, slots: int) -> Column:
    """The slot of a key in a map of `slots` bytes."""
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def slot_map(found: DataFrame, slots: int, literal: bool = False) -> Column:
    """A bit for each slot, 1 for those in `found` (column `slot`), seven to a byte so that a byte is an ASCII sign.

    At most slots / 7 bytes reach the driver and every task. The map is stored and read as a subquery, so that no plan
    holds it as a literal: the driver keeps the texts of plans, and each would repeat the map for each of its uses.
    Functions over arrays do not take subqueries; a small map can be a `literal` for them.
    """
    bit = F.expr("shiftleft(1, slot % 7)")
    byte = found.groupBy(F.expr("slot div 7").cast("int").alias("byte")).agg(F.bit_or(bit).cast("byte").alias("bits")).toArrow()
    marks = np.zeros(slots // 7 + 1, np.uint8)
    marks[byte["byte"].to_numpy()] = byte["bits"].to_numpy()
    if literal:
        return F.lit(marks.tobytes())
    return stored(found.sparkSession.createDataFrame([(marks.tobytes(),)], "marks binary")).scalar()


def in_map(marks: Column, slot: Column) -> Column:
    sign = F.ascii(F.substring(marks, F.floor(slot / 7).cast("int") + 1, F.lit(1)).cast("string"))
    return F.getbit(sign, slot % 7) == 1


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`docs` with exactly one row of each group of copies, given rows of groups as `doc_id, text_sha256, kept`.

    Rows with an id and a text that are not kept go. Where several rows have the id and the text that is kept, the one
    whose columns have the least hash stays; such rows are combined in each task before they are shuffled.
    """
    found = stored(found.groupBy("doc_id", "text_sha256", "kept").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR NOT kept"))
    rest = without(docs, found)
    several = found.where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha256"))
    if several.isEmpty():
        return rest
    sha = F.sha2(text_of(), 256)
    held = slot_map(several.select(slot_of(F.col("_kept_sha256"), slots=TEXT_SLOTS).alias("slot")), TEXT_SLOTS)
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*hashed)).alias("_row")
    rows = docs.where(in_map(held, slot_of(sha, slots=TEXT_SLOTS)))
    single = rows.groupBy(F.col("doc_id").alias("_doc_id"), sha.alias("_text_sha256")).agg(row)
    same = F.col("_doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_text_sha256") == F.col("_kept_sha256"))
    return rest.unionByName(single.join(several, same, "left_semi").select("_row.*"))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """`docs` without the rows whose id and text are in `dropped` (`doc_id, text_sha256`); a null id is equal to itself.

    Null text is the empty text. Texts that are not in `dropped` are not shuffled, as far as a map of fixed size tells.
    """
    sha = F.sha2(text_of(), 256)
    listed = stored(dropped.select(F.col("doc_id").alias("dropped_id"), F.col("text_sha256").alias("dropped_sha256")).distinct())
    held = slot_map(listed.select(slot_of(F.col("dropped_sha256"), slots=TEXT_SLOTS).alias("slot")), TEXT_SLOTS)
    listed_slot = in_map(held, slot_of(sha, slots=TEXT_SLOTS))
    same = F.col("doc_id").eqNullSafe(F.col("dropped_id")) & (F.col("sha256") == F.col("dropped_sha256"))
    some = docs.where(listed_slot).select(whole_row(docs), "doc_id", sha.alias("sha256")).join(listed, same, "left_anti")
    return docs.where(~listed_slot).unionByName(some.select("row.*"))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one, `row`, so that no name of theirs meets one of an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def pieces(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of a piece hold about `most` bytes."""
    for batch in batches:
        start = held = 0
        for i, size in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
            if held and held + (size or 0) > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Hand memory that is free back to the system: a worker lives on between tasks and would keep what its largest one took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def ship_code(df: DataFrame) -> DataFrame:
    """`df`, after this package is on its way to the Python workers, which may not have it on their path."""
    context = df.sparkSession.sparkContext
    if not getattr(context, "_sqltrail_shipped", None):
        package = Path(sqltrail.__file__).resolve().parent
        # Kept as long as the driver runs, which serves it to executors that start later.
        context._sqltrail_shipped = folder = tempfile.TemporaryDirectory(prefix="sqltrail-code-")
        target = os.path.join(folder.name, "sqltrail.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, str(file.relative_to(package.parent)))
        context.addPyFile(target)
    return df
