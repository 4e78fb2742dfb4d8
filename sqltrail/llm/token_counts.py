"""Tokens per document in flat token files that have no index, by a scan for the end-of-document id."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sqltrail.llm.bpe import encoder
from sqltrail.llm.common import pieces, ship_code, text_of
from sqltrail.session import ensure_checkpoint_dir

#: Tokens of a block, which is scanned at once; and blocks of a run, which are summed before runs are.
BLOCK_TOKENS, RUN_BLOCKS = 1 << 20, 1024
#: Blocks that a task scans, one after another.
TASK_BLOCKS = 16
#: Bytes of an id in the files.
WIDTHS = {2: "<u2", 4: "<u4"}


def write_token_files(docs: DataFrame, path: str, end: int, folder: str | None = None, text_col: str = "text") -> str:
    """Encode texts into flat files of little-endian 16-bit ids, each text followed by the id `end`; the folder.

    The files hold nothing else: no index, no header. Null is the empty text. `path` is a byte-level BPE
    vocabulary of at most 65,536 ids; special tokens in a text are ordinary text. Without `folder` the files
    go below the shared checkpoint folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, special=False)
        for piece in pieces(batches, column=0, most=6 << 20):
            codes = coder.encode(piece.column(0).to_pylist())
            flat = [np.frombuffer(code, "<u4").astype("<u2").tobytes() for code in codes]
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.binary())], ["ids"])

    spark = docs.sparkSession
    if folder is None:
        ensure_checkpoint_dir(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    ids = ship_code(docs.select(text_of(text_col).alias("text"))).mapInArrow(run, "ids binary")
    # A line of the text writer is any bytes, and what ends it is the end id: the file is ids and nothing else.
    separator = end.to_bytes(2, "little").decode("latin-1")
    ids.select(F.col("ids").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", separator).text(folder)
    return folder


def _scan(end: int, kind: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, block = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                data = batch.column(2)[i].as_py() if batch.num_columns > 2 else read_range(file, block * size, size)
                ids = np.frombuffer(data, kind, len(data) // np.dtype(kind).itemsize)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block]), pa.array([len(ids)], pa.int64()), pa.array([np.nonzero(ids == end)[0]], pa.list_(pa.int64()))],
                    ["file", "block", "size", "ends"],
                )

    return run


def read_range(path: str, start: int, size: int) -> bytes:
    """Up to `size` bytes of a file from `start` on, from any file system that Arrow opens."""
    if path.startswith("file:"):
        system, name = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as file:
        return file.read_at(size, start)


def token_blocks(spark: SparkSession, folder: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """`file, block`: the blocks of `block_tokens` ids that the files of a folder have, by their lengths alone.

    What is in a block is read by the task that scans it. Blocks are dealt to tasks by a hash, TASK_BLOCKS to each, so
    a file may have any length.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where("length > 0")
    last = F.expr(f"(length - 1) div {block_tokens * width}")
    number = files.agg(F.coalesce(F.sum(last + 1), F.lit(0))).first()[0]
    blocks = files.select(F.col("path").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    return blocks.repartition(max(1, -(-number // TASK_BLOCKS)), "file", "block")


def count_tokens(blocks: DataFrame, end: int, width: int = 2, block_tokens: int = BLOCK_TOKENS, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """`file, doc_no, start, n_tokens, ended` for each document of flat token files, in file order.

    `blocks` has `file, block`, and `data` or else `file` is read: little-endian ids of `width` bytes, `block_tokens` in
    each block but a file's last. A task holds one block at a time. Every block is searched on its own. A prefix scan over the blocks' counts and last ends gives
    each block the number of documents before it and the start of the one it goes on with; it runs over runs of
    `run_blocks` blocks, and over the runs, so no task holds all blocks of a large file. What follows the last
    end of a file is a document with `ended` false. An end id right after another is a document of no tokens.
    Bytes short of an id at the end of a file are left out. No blocks give no rows.
    """
    given = ["data"] if "data" in blocks.columns else []
    rows = ship_code(blocks.select("file", F.col("block").cast("long").alias("block"), *given))
    scanned = rows.mapInArrow(_scan(end, WIDTHS[width], block_tokens * width), "file string, block long, size long, ends array<long>")
    offset = F.col("block") * block_tokens
    scanned = scanned.withColumns(
        {
            "run": F.expr(f"block div {run_blocks}"),
            "n": F.size("ends").cast("long"),
            "last": F.when(F.size("ends") > 0, offset + F.element_at("ends", -1)),
            "stop": offset + F.col("size"),
        }
    )
    inside = W.partitionBy("file", "run").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    runs = scanned.groupBy("file", "run").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("stop").alias("stop"))
    before = W.partitionBy("file").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    carried = runs.select(
        "file", "run",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("end_before"),
    )
    placed = (
        scanned.withColumns(
            {"docs_in_run": F.coalesce(F.sum("n").over(inside), F.lit(0)), "end_in_run": F.max("last").over(inside)}
        )
        .join(carried, ["file", "run"])
        .select(
            "file",
            (F.col("docs_before") + F.col("docs_in_run")).alias("base"),
            F.coalesce("end_in_run", "end_before").alias("carry"),
            F.transform("ends", lambda e: e + F.col("block") * block_tokens).alias("at"),
        )
    )
    starts = F.concat(F.array(F.col("carry")), F.col("at"))
    ended = placed.where(F.size("at") > 0).select(
        "file", "base", F.posexplode(F.arrays_zip(F.col("at").alias("stop"), F.slice(starts, 1, F.size("at")).alias("carry"))).alias("i", "x")
    ).select(
        "file",
        (F.col("base") + F.col("i")).alias("doc_no"),
        (F.col("x.carry") + 1).alias("start"),
        (F.col("x.stop") - F.col("x.carry") - 1).alias("n_tokens"),
        F.lit(True).alias("ended"),
    )
    whole = runs.groupBy("file").agg(F.sum("n").alias("doc_no"), F.coalesce(F.max("last"), F.lit(-1)).alias("carry"), F.max("stop").alias("stop"))
    rest = whole.where("stop > carry + 1").select(
        "file", "doc_no", (F.col("carry") + 1).alias("start"), (F.col("stop") - F.col("carry") - 1).alias("n_tokens"), F.lit(False).alias("ended")
    )
    return ended.unionByName(rest)
