"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltrail.llm.common import ship_code, text_of

#: Permitted lengths of a sequence, in tokens.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: A sequence of c tokens costs c * (1 + c / ATTENTION): the second part is the attention over it.
ATTENTION = 16384
#: Tokens that one task packs, about.
SHARD_TOKENS = 4_000_000


def cost(capacity: int) -> float:
    return capacity * (1 + capacity / ATTENTION)


def best_fit(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the final capacity of each bin.

    `lengths` descend and fit the largest capacity. A piece goes to the open bin that it leaves least
    room in. If none has room, a bin is opened whose cost per token is least, counting on the pieces
    that are left and fit the rest. In the end each bin shrinks to the smallest capacity that holds it.
    """
    capacities = sorted(capacities)
    # Tokens of all pieces of a length or less: what could still fill a bin that is opened for a longer one.
    up_to = np.cumsum(np.bincount(lengths, lengths, capacities[-1] + 1)).astype(np.int64) if len(lengths) else []
    room: list[tuple[int, int]] = []
    used: list[int] = []
    bins, offsets = [], []
    for length in lengths.tolist():
        at = bisect_left(room, (length, -1))
        if at < len(room):
            left, number = room.pop(at)
        else:
            left = min(
                (c for c in capacities if c >= length),
                key=lambda c: (cost(c) / (length + min(c - length, int(up_to[min(c - length, length)]))), c),
            )
            number = len(used)
            used.append(0)
        bins.append(number)
        offsets.append(used[number])
        used[number] += length
        if left > length:
            insort(room, (left - length, number))
    return bins, offsets, [capacities[bisect_left(capacities, u)] for u in used]


def _pack(capacities: Sequence[int]):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets, sizes = best_fit(group["length"].to_numpy(), capacities)
        number = pa.array(bins, pa.int64())
        return pa.table(
            {
                "doc_id": group["doc_id"],
                "piece": group["piece"],
                "start": group["start"],
                "length": group["length"],
                "shard": group["shard"],
                "bin": number,
                "offset": pa.array(offsets, pa.int64()),
                "capacity": pa.array(sizes, pa.int64()).take(number) if sizes else pa.array([], pa.int64()),
            }
        )

    return run


def word_tokens(text: Column) -> Column:
    """Words of a text and one end token."""
    return (F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")) + 1).cast("long")


def pack(docs: DataFrame, lengths: Column, capacities: Sequence[int] = CAPACITIES, id_col: str = "doc_id") -> DataFrame:
    """`doc_id, piece, start, length, shard, bin, offset, capacity`: a place for every token.

    `lengths` gives a row's tokens. A document over the largest capacity is cut into full pieces and a
    rest. Pieces are dealt to shards of about SHARD_TOKENS, whose number follows the tokens, by a hash of their row and of
    where it was read, so that equal rows are spread too; each shard is packed on its own, and (shard, bin) names a sequence. Null, zero and negative
    lengths give no rows. Rows that repeat an id are packed each, in the order of their position. Other
    columns are ignored.
    """
    largest = max(capacities)
    sized = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), lengths.cast("long").alias("n"), F.monotonically_increasing_id().alias("read_at")
    ).where("n > 0")
    total = sized.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = max(1, -(-total // SHARD_TOKENS))
    cut = sized.select("doc_id", "n", "read_at", F.posexplode(F.expr(f"sequence(0L, n - 1, {largest}L)")).alias("piece", "start"))
    pieces = cut.select(
        "doc_id", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(largest)).cast("long").alias("length"),
        F.pmod(F.xxhash64("doc_id", "piece", "n", "read_at"), F.lit(shards)).alias("shard"),
    )
    schema = "doc_id long, piece int, start long, length long, shard long, bin long, offset long, capacity long"
    return ship_code(pieces).groupBy("shard").applyInArrow(_pack(tuple(capacities)), schema)


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, text_col: str = "text") -> DataFrame:
    """`pack` with a text's words and one end token as its length; null counts as empty."""
    return pack(docs, word_tokens(text_of(text_col)), capacities)
