"""Repeated substrings over a sparse suffix array: sampled suffixes, range-partitioned, sorted and compared with neighbours.

A suffix array of every byte would move each text a few hundred times. Here suffixes start at sampled places
only: in each window of `WINDOW` bytes, where the hash of `LEAD` bytes is least. The choice depends on the
window's bytes alone, so two equal windows hold the same sampled suffix at the same distance from their starts,
and every repeated window shows up as two equal suffixes with equal bytes before them. What lies around a
sampled place, its context, is `LEFT` bytes before and `WINDOW` bytes from it on.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sqltrail.llm.common import give_back, in_map, pieces, ship_code, slot_map, slot_of, stored, text_of, whole_row

#: Bytes of a string that counts as repeated, of the part that a suffix is sampled by, and before it.
WINDOW, LEAD = 200, 48
LEFT = WINDOW - LEAD
#: Contexts that a task sorts, about, beyond what the session's partitions give.
SORTED_ROWS = 64_000
#: Contexts of one lead that are compared in one task; leads with more are compared over many.
GROUP_ROWS = 32_000
#: Slots of the map of documents that may hold repeats; its size, whatever the input's.
SLOTS = 1 << 20
#: Bytes whose hashes are computed at a time.
BLOCK = 1 << 16
#: Contexts that are copied or compared at a time.
STEP_ROWS = 4_096

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _lead_hashes(data: np.ndarray, lead: int) -> np.ndarray:
    """A hash of the `lead` bytes from each place on, built from hashes of 1, 2, 4, ... bytes."""
    base = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64)[data]
    power, width, done, out, shift = _ODD, 1, 0, None, np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if lead & width:
                part = base[done : done + len(data) - lead + 1]
                out = part.copy() if out is None else out * power + part
                done += width
            if done == lead:
                break
            n = len(base) - width
            base = base[:n] * power + base[width : width + n]
            power, width = power * power, width * 2
        out ^= out >> np.uint64(31)
        out *= _MIX
        out ^= out >> np.uint64(29)
    return out


def _sliding(values: np.ndarray, width: int, choose) -> np.ndarray:
    """`choose` (minimum or maximum) over each `width` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = choose(out[: len(out) - step], out[step:])
        have += step
    return out


def _sampled(data: np.ndarray, ends: np.ndarray, window: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled places in texts that stand one after another and end at `ends`, and the hashes of their leads."""
    if len(data) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = window - lead + 1
    h = _lead_hashes(data, lead) | np.uint64(1)
    least = _sliding(h, width, np.minimum).copy()
    # Windows that reach over the end of a text are none.
    for end in ends.tolist():
        least[max(0, end - window + 1) : end] = 0
    # A place is sampled if some window that holds it has its hash as the least.
    edge = np.zeros(width - 1, np.uint64)
    at = np.nonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == h)[0]
    return at, h[at]


def sampled_places(texts: list[bytes], window: int = WINDOW, lead: int = LEAD) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of a text, where sampled suffixes start in it, and the hashes of their first `lead` bytes.

    Short texts are worked on together, long ones in parts that overlap by a window.
    """
    held: list[int] = []

    def together():
        ends = np.cumsum([len(texts[i]) for i in held])
        at, h = _sampled(np.frombuffer(b"".join(texts[i] for i in held), np.uint8), ends, window, lead)
        cuts = np.searchsorted(at, ends)
        for i, low, high, start in zip(held, [0, *cuts[:-1]], cuts, [0, *ends[:-1]]):
            if high > low:
                yield i, at[low:high] - start, h[low:high]
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        if len(text) < window:
            continue
        if len(text) > BLOCK:
            data, found = np.frombuffer(text, np.uint8), []
            for start in range(0, len(text) - window + 1, BLOCK):
                part = data[start : start + BLOCK + window - 1]
                at, h = _sampled(part, np.array([len(part)]), window, lead)
                found.append((at + start, h))
            places, first = np.unique(np.concatenate([at for at, _ in found]), return_index=True)
            yield i, places, np.concatenate([h for _, h in found])[first]
            continue
        held.append(i)
        size += len(text)
        if size > BLOCK:
            yield from together()
            size = 0
    if held:
        yield from together()


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for piece in pieces(batches, column=2):
        doc, tag = piece.column(0).to_numpy(), piece.column(1).to_numpy()
        texts = piece.column(2).to_pylist()
        docs, leads, places, contexts = [], [], [], []
        for i, at, lead in sampled_places(texts):
            docs.append(np.full(len(at), doc[i]))
            leads.append(lead)
            places.append(at | (int(tag[i]) << 32))
            text = texts[i]
            contexts += [digest(text[max(0, p - LEFT) : p + WINDOW], min(p, LEFT)) for p in at.tolist()]
        if docs:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(leads).view(np.int64)),
                    pa.array(np.array(contexts, np.uint64).view(np.int64)),
                    pa.array(np.concatenate(docs)),
                    pa.array(np.concatenate(places)),
                ],
                ["lead", "context", "doc", "place"],
            )


def _keyed(docs: DataFrame) -> DataFrame:
    """All columns, and `_doc, _tag, _text`: two hashes of id and text, 95 bits together, so that rows that share an id but
    not a text stay apart, and the text's bytes."""
    text, named = text_of("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    return docs.withColumns(
        {
            "_doc": F.xxhash64(named, text),
            "_tag": F.xxhash64(F.lit(1), text, named).bitwiseAND(0x7FFFFFFF),
            "_text": text.cast("binary"),
        }
    )


def _marks(docs: DataFrame) -> DataFrame:
    """`doc, place, dup, rep`: sampled places whose lead occurs more than once.

    `dup`: the whole context occurs again. `rep`: one place of its context where the lead has others.
    A place is the tag of its document above 32 bits of position.
    """
    rows = ship_code(_keyed(docs).select("_doc", "_tag", "_text"))
    places = stored(rows.mapInArrow(_sample, "lead long, context long, doc long, place long"))
    hot = stored(places.groupBy("lead").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > GROUP_ROWS).select("lead"))
    marks = _ordered_marks(places.join(hot, "lead", "left_anti")).unionByName(_counted_marks(places.join(hot, "lead", "left_semi")))
    return marks.where("dup OR rep")


def _ordered_marks(places: DataFrame) -> DataFrame:
    """`_marks` of leads with up to GROUP_ROWS places, by the neighbours in a lead's order."""
    ordered = W.partitionBy("lead").orderBy("context", "doc", "place")
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before, after = F.lag("context").over(ordered), F.lead("context").over(ordered)
    return places.select(
        "doc",
        "place",
        (before.eqNullSafe(F.col("context")) | after.eqNullSafe(F.col("context"))).alias("dup"),
        (~before.eqNullSafe(F.col("context")) & (F.first("context").over(whole) != F.last("context").over(whole))).alias("rep"),
    )


def _counted_marks(places: DataFrame) -> DataFrame:
    """`_marks` of leads with more places, by counts that are combined before they are shuffled; no task gets a whole lead.

    `rep` is the place of its context whose hash is least, not the first.
    """
    at = F.xxhash64("doc", "place")
    contexts = stored(places.groupBy("lead", "context").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("chosen")))
    leads = contexts.groupBy("lead").agg((F.min("context") != F.max("context")).alias("several"))
    counted = contexts.join(leads, "lead").select("lead", "context", "n", "chosen", "several")
    return places.join(counted, ["lead", "context"]).select(
        "doc", "place", (F.col("n") > 1).alias("dup"), (F.col("several") & (at == F.col("chosen"))).alias("rep")
    )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes from each place on, and those before it from right to left."""
    for piece in pieces(batches, column=1, most=2 << 20):
        doc, tag = piece.column(0), piece.column(2)
        out: list[tuple] = []
        for i, (text, reps) in enumerate(zip(piece.column(1).to_pylist(), piece.column(3).to_pylist())):
            high = tag[i].as_py() << 32
            key = doc[i].as_py()
            for p in reps:
                at = p["at"]
                out.append((key, high | at, p["dup"], text[at : at + WINDOW], text[max(0, at - LEFT) : at][::-1]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["doc", "place", "dup", "right", "left"])


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of rows of 64-bit words: three-way partitions by a word, and by the next one within equal ones."""
    order = np.arange(len(words))
    stack = [(0, len(words), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2 or depth == words.shape[1]:
            continue
        part = order[low:high]
        if high - low <= 64:
            order[low:high] = part[np.lexsort(words[part, depth:].T[::-1])]
            continue
        keys = words[part, depth]
        pivot = np.sort(keys[[0, len(keys) // 2, -1]])[1]
        less, more = keys < pivot, keys > pivot
        same = part[~(less | more)]
        order[low:high] = np.concatenate([part[less], same, part[more]])
        first, last = low + int(less.sum()), high - int(more.sum())
        stack += [(low, first, depth), (first, last, depth + 1), (last, high, depth)]
    return order


def _matrix(rows: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows filled up with zero bytes, and their lengths; the bytes are copied once, from one Arrow buffer."""
    array = pa.concat_arrays([chunk.cast(pa.binary()) for chunk in rows.chunks])
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(ends)
    filled = np.zeros((len(array), width), np.uint8)
    if len(sizes) and (sizes == width).all():
        filled[:] = data[ends[0] : ends[-1]].reshape(-1, width)
        return filled, sizes
    for low in range(0, len(sizes), STEP_ROWS):
        part = sizes[low : low + STEP_ROWS]
        held = np.arange(width) < part[:, None]
        filled[low : low + STEP_ROWS][held] = data[ends[low] : ends[low + len(part)]]
    return filled, sizes


def _shared_bytes(matrix: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading bytes each row in `order` shares with the next."""
    found = np.zeros(len(order) - 1, np.int64)
    for low in range(0, len(found), STEP_ROWS):
        part = order[low : low + STEP_ROWS + 1]
        differ = matrix[part[:-1]] != matrix[part[1:]]
        found[low : low + STEP_ROWS] = np.where(differ.any(1), differ.argmax(1), matrix.shape[1])
    return np.minimum(found, np.minimum(sizes[order[:-1]], sizes[order[1:]]))


class _Contexts:
    """Contexts of one task, and what comparing neighbours in an order shows.

    `a` and `b` are the bytes before and from the place on that repeated windows cover, `before` and `after`
    the most that any other context shares on either side.
    """

    def __init__(self, right: pa.ChunkedArray, left: pa.ChunkedArray):
        self.rights, self.right_sizes = _matrix(right, WINDOW)
        self.lefts, self.left_sizes = _matrix(left, LEFT)
        n = len(right)
        self.a, self.b, self.before, self.after = (np.zeros(n, np.int64) for _ in range(4))

    def right(self, i: int) -> bytes:
        return self.rights[i, : self.right_sizes[i]].tobytes()

    def left(self, i: int) -> bytes:
        return self.lefts[i, : self.left_sizes[i]].tobytes()

    def words(self, *parts: np.ndarray) -> np.ndarray:
        """Rows as numbers whose order is that of their bytes."""
        joined = np.ascontiguousarray(np.concatenate(parts, axis=1)).view(np.uint64)
        return joined.byteswap(inplace=True) if sys.byteorder == "little" else joined

    def compare(self, order: np.ndarray) -> np.ndarray:
        """Take the repeats that neighbours in `order` share; True between neighbours of one lead."""
        if len(order) < 2:
            return np.zeros(0, bool)
        b = _shared_bytes(self.rights, self.right_sizes, order)
        a = _shared_bytes(self.lefts, self.left_sizes, order)
        alike = b >= LEAD
        a, b = np.where(alike, a, 0), np.where(alike, b, 0)
        whole = a + b >= WINDOW
        for rows in (order[:-1], order[1:]):
            np.maximum.at(self.before, rows, a)
            np.maximum.at(self.after, rows, b)
            np.maximum.at(self.a, rows, np.where(whole, a, 0))
            np.maximum.at(self.b, rows, np.where(whole, b, 0))
        return alike

    def incomplete(self) -> np.ndarray:
        """Rows that might have windows beyond what their neighbours show."""
        return (self.before + self.after >= WINDOW) & ((self.a < self.before) | (self.b < self.after))

    def settle(self, rows: np.ndarray, group: np.ndarray) -> None:
        """All repeats among `rows`, whose leads are whole and numbered by `group`, after a first comparison by suffix."""
        number = group[rows].astype(">u8").view(np.uint8).reshape(-1, 8)
        self.compare(rows[multikey_quicksort(self.words(number, self.lefts[rows], self.rights[rows]))])
        unsure = np.unique(group[rows][self.incomplete()[rows]])
        by_group = rows[np.argsort(group[rows], kind="stable")]
        lows, highs = np.searchsorted(group[by_group], unsure), np.searchsorted(group[by_group], unsure, "right")
        for low, high in zip(lows, highs):
            self.enumerate_windows(by_group[low:high])

    def enumerate_windows(self, rows: np.ndarray) -> None:
        """Compare every window of contexts of one lead."""
        seen: dict[tuple, int] = {}
        spans = [(int(i), range(max(0, WINDOW - int(self.after[i])), int(self.before[i]) + 1)) for i in rows]
        keys = lambda i, span: [(left[:o], right[: WINDOW - o]) for left, right in [(self.left(i), self.right(i))] for o in span]
        for i, span in spans:
            for key in keys(i, span):
                seen[key] = seen.get(key, 0) + 1
        for i, span in spans:
            for o, key in zip(span, keys(i, span)):
                if seen[key] > 1:
                    self.a[i] = max(self.a[i], o)
                    self.b[i] = max(self.b[i], WINDOW - o)


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, _Contexts] | None:
    """All rows of a task without their contexts, and these; None if there are no rows."""
    held = list(batches)
    table = pa.Table.from_batches(held) if held else None
    if table is None or not table.num_rows:
        return None
    return table.drop_columns(["right", "left"]), _Contexts(table.column("right"), table.column("left"))


SORTED = "doc long, place long, a int, b int, bound int, part int, edge int, right binary, left binary"


def _rows_out(doc, place, a, b, bound, part, edge, right, left) -> pa.RecordBatch:
    small = [pa.array(np.asarray(x, np.int32)) for x in (a, b, bound, np.full(len(a), part), edge)]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(place), *small, pa.array(right, pa.binary()), pa.array(left, pa.binary())],
        ["doc", "place", "a", "b", "bound", "part", "edge", "right", "left"],
    )


def _sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort a task's suffixes, and settle the leads that lie within the task.

    A lead at either end of the task may go on in the next one. Its rows are handed on with their contexts and
    with what the sort by suffix shows; the outermost rows are marked (edge 1: first, 2: last).
    """
    if (gathered := _gathered(batches)) is None:
        return
    table, rows = gathered
    doc, place, dup = (table.column(c).to_numpy() for c in ("doc", "place", "dup"))
    order = multikey_quicksort(rows.words(rows.rights, rows.lefts))
    alike = rows.compare(order)
    group = np.zeros(len(order), np.int64)
    group[order] = np.concatenate([[0], np.cumsum(~alike)])
    last = group[order[-1]]
    open_ = (group == 0) | (group == last)
    edge = np.zeros(len(order), np.int64)
    edge[order[0]] += 1
    edge[order[-1]] += 2
    part = TaskContext.get().partitionId()
    o = np.nonzero(open_)[0]
    yield _rows_out(doc[o], place[o], rows.a[o], rows.b[o], rows.after[o], part, edge[o], [rows.right(i) for i in o], [rows.left(i) for i in o])
    inner = np.nonzero(~open_)[0]
    if len(inner):
        rows.settle(inner, group)
        found = inner[(rows.b[inner] > 0) & ~dup[inner]]
        none = [None] * len(found)
        yield _rows_out(doc[found], place[found], rows.a[found], rows.b[found], rows.after[found], part, np.full(len(found), -1), none, none)
    del gathered, table, rows, order
    give_back()


def _settle_leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All repeats of the leads that have come together in a task."""
    if (gathered := _gathered(batches)) is None:
        return
    table, rows = gathered
    order = multikey_quicksort(rows.words(rows.rights, rows.lefts))
    group = np.zeros(len(order), np.int64)
    group[order] = np.concatenate([[0], np.cumsum(~rows.compare(order))])
    rows.settle(np.arange(len(order)), group)
    at = np.nonzero(rows.b)[0]
    columns = [table.column("doc").to_numpy()[at], table.column("place").to_numpy()[at], rows.a[at].astype(np.int32), rows.b[at].astype(np.int32)]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "place", "a", "b"])


def _sort_lefts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort contexts of open leads by lead and the bytes before the place, and compare neighbours."""
    if (gathered := _gathered(batches)) is None:
        return
    table, rows = gathered
    order = multikey_quicksort(rows.words(rows.rights[:, :LEAD], rows.lefts, rows.rights[:, LEAD:]))
    rows.compare(order)
    edge = np.zeros(len(order), np.int64)
    edge[order[0]] += 1
    edge[order[-1]] += 2
    keep = lambda value: [value(i) if e else None for i, e in enumerate(edge)]
    doc, place = table.column("doc").to_numpy(), table.column("place").to_numpy()
    yield _rows_out(doc, place, rows.a, rows.b, rows.before, TaskContext.get().partitionId(), edge, keep(rows.right), keep(rows.left))


def _across_edges(found: DataFrame, side: str) -> DataFrame:
    """What the last row of each task shares with the first of the next; two rows of each task reach the driver."""
    made = []
    by_part: dict[int, dict[int, object]] = {}
    for row in found.where("edge > 0").collect():
        for bit in (1, 2):
            if row["edge"] & bit:
                by_part.setdefault(row["part"], {})[bit] = row
    parts = sorted(by_part)
    for here, there in zip(parts, parts[1:]):
        # Other leads may stand at the ends; a lead that goes on has its rows at both.
        if 2 not in by_part[here] or 1 not in by_part[there]:
            continue
        pair = (by_part[here][2], by_part[there][1])
        both = _Contexts(*(pa.chunked_array([pa.array([bytes(r[c]) for r in pair], pa.binary())]) for c in ("right", "left")))
        both.compare(np.arange(2))
        bound = both.after if side == "right" else both.before
        made += [(r["doc"], r["place"], int(both.a[i]), int(both.b[i]), int(bound[i])) for i, r in enumerate(pair)]
    return found.sparkSession.createDataFrame(made, "doc long, place long, a int, b int, bound int")


def _tasks(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SORTED_ROWS))


def _open_repeats(found: DataFrame) -> DataFrame:
    """`doc, place, a, b` for places whose lead reaches over the end of a task."""
    lead = F.substring("right", 1, LEAD)
    opened = found.where("edge >= 0").withColumn("lead", lead)
    sizes = stored(opened.groupBy("lead").agg(F.count(F.lit(1)).alias("rows")))
    few = opened.join(sizes.where(f"rows <= {GROUP_ROWS}").select("lead"), "lead").select("doc", "place", "right", "left", "lead")
    settled = few.repartition("lead").drop("lead").mapInArrow(_settle_leads, "doc long, place long, a int, b int")
    if sizes.where(f"rows > {GROUP_ROWS}").isEmpty():
        return settled
    large = stored(opened.join(sizes.where(f"rows > {GROUP_ROWS}").select("lead"), "lead").drop("lead"))
    return settled.unionByName(_large_repeats(large))


def _large_repeats(opened: DataFrame) -> DataFrame:
    """`doc, place, a, b` for the leads that no task holds whole, given their rows after the sort by suffix.

    The same contexts are sorted by the bytes before the place too, and neighbours compared across tasks in both
    orders. Where that leaves windows in doubt, all windows of the lead's contexts are counted by their hash.
    """
    columns = ["doc", "place", "a", "b", "bound"]
    lead = F.substring("right", 1, LEAD)
    rights = opened.select(*columns).unionByName(_across_edges(opened, "right"))
    ordered = opened.select("doc", "place", "right", "left").repartitionByRange(_tasks(opened, opened.count()), lead, "left", "right")
    lefts = stored(ordered.mapInArrow(_sort_lefts, SORTED))
    lefts = lefts.select(*columns).unionByName(_across_edges(lefts, "left"))
    sides = rights.withColumns({"after": F.col("bound"), "before": F.lit(0)}).unionByName(
        lefts.withColumns({"after": F.lit(0), "before": F.col("bound")})
    )
    known = stored(sides.groupBy("doc", "place").agg(*[F.max(c).alias(c) for c in ("a", "b", "after", "before")]))
    unsure = F.expr(f"before + after >= {WINDOW} AND (a < before OR b < after)")
    contexts = opened.select("doc", "place", "right", "left", lead.alias("lead")).join(known, ["doc", "place"])
    leads = contexts.where(unsure).select("lead").distinct()
    offsets = F.explode(F.expr(f"sequence(greatest(0, {WINDOW} - after), before)")).alias("o")
    wide = contexts.join(leads, "lead", "left_semi").where(f"before + after >= {WINDOW}")
    windows = wide.select("doc", "place", "right", "left", offsets).select(
        "doc", "place", "o", F.md5(F.concat(F.expr("substring(left, 1, o)"), F.expr(f"substring(right, 1, {WINDOW} - o)"))).alias("key")
    )
    again = windows.groupBy("o", "key").count().where("count > 1").select("o", "key")
    more = windows.join(again, ["o", "key"]).groupBy("doc", "place").agg(
        F.max("o").alias("a"), (F.lit(WINDOW) - F.min("o")).alias("b")
    )
    return known.where("b > 0").select("doc", "place", "a", "b").unionByName(more)


def repeats(docs: DataFrame) -> DataFrame:
    """`_doc, _tag, _spans`: for documents with repeats, what repeated windows cover, as (start, end) that may overlap."""
    marks = stored(_marks(docs))
    places = marks.where("rep").select(
        F.col("doc").alias("_doc"),
        F.shiftright("place", 32).alias("_tag"),
        F.struct(F.col("place").bitwiseAND(0x7FFFFFFF).cast("int").alias("at"), "dup").alias("p"),
    )
    held = slot_map(places.select(slot_of(F.col("_doc"), F.col("_tag"), slots=SLOTS).alias("slot")), SLOTS)
    grouped = places.groupBy("_doc", "_tag").agg(F.collect_list("p").alias("reps"))
    # Rows that repeat an id and a text have the same contexts; one of them is enough.
    texts = _keyed(docs).select("_doc", "_text", "_tag").where(in_map(held, slot_of(F.col("_doc"), F.col("_tag"), slots=SLOTS)))
    with_reps = texts.join(grouped, ["_doc", "_tag"]).select("_doc", "_text", "_tag", "reps")
    contexts = with_reps.mapInArrow(_contexts, "doc long, place long, dup boolean, right binary, left binary")
    ordered = contexts.repartitionByRange(_tasks(docs, marks.where("rep").count()), "right", "left")
    found = stored(ordered.mapInArrow(_sort_suffixes, SORTED))
    closed = found.where("edge = -1").select("doc", "place", "a", "b")
    whole = marks.where("dup").select("doc", "place", F.lit(LEFT).alias("a"), F.lit(WINDOW).alias("b"))
    covers = whole.unionByName(closed).unionByName(_open_repeats(found))
    at = F.col("place").bitwiseAND(0x7FFFFFFF).cast("int")
    spans = covers.select(
        F.col("doc").alias("_doc"),
        F.shiftright("place", 32).alias("_tag"),
        F.struct(F.greatest(F.lit(0), at - F.col("a")).alias("start"), (at + F.col("b")).alias("end")).alias("span"),
    )
    return spans.groupBy("_doc", "_tag").agg(F.collect_list("span").alias("_spans"))


def merged(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs of what the spans cover in a text of `size` bytes."""
    found: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], min(s["end"], size)) for s in spans):
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], max(found[-1][1], end))
        else:
            found.append((start, end))
    return found


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, end in runs:
        out.append(text[at:start])
        at = end
    return b"".join([*out, text[at:]])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        rows = []
        for text, spans in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist()):
            runs = merged(spans, len(text))
            rows.append((len(text), sum(e - s for s, e in runs), len(runs), hashlib.sha256(_kept(text, runs)).hexdigest()))
        sizes, removed, runs_, digests = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [piece.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs_, pa.int64()), pa.array(digests)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _split(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with repeats, with their `_spans`; and the others. Texts without repeats are not shuffled, as far as a
    map of fixed size tells them apart."""
    spans = stored(repeats(docs))
    slot = slot_of(F.col("_doc"), F.col("_tag"), slots=SLOTS)
    held = slot_map(spans.select(slot.alias("slot")), SLOTS)
    keyed = _keyed(docs)
    some = keyed.where(in_map(held, slot)).join(spans, ["_doc", "_tag"], "left")
    return some, keyed.where(~in_map(held, slot))


def removal_digests(docs: DataFrame) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256`, one row per input row.

    Removed is each byte covered by a string of WINDOW bytes that also starts elsewhere, in another row or at
    another place of the same one; overlapping strings count, and strings are judged on the input. Null text is
    empty. Texts shorter than WINDOW keep everything. Rows that repeat an id and a text are copies of each other.
    Null ids are allowed. Other columns are ignored.
    """
    some, others = _split(docs.select("doc_id", "text"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    spans = F.coalesce("_spans", F.expr("array()").cast("array<struct<start: int, end: int>>")).alias("_spans")
    cut = some.select(F.col("doc_id").cast("long").alias("doc_id"), "_text", spans).mapInArrow(_digests, schema)
    zero = F.lit(0).cast("long")
    return cut.unionByName(
        others.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.octet_length("_text").cast("long").alias("n_bytes"),
            zero.alias("n_removed"),
            zero.alias("n_spans"),
            F.sha2("_text", 256).alias("kept_sha256"),
        )
    )


def _whole_signs(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs narrowed so that no character is cut."""
    found = []
    for start, end in runs:
        while start < end and text[start] & 0xC0 == 0x80:
            start += 1
        while end < len(text) and end > start and text[end] & 0xC0 == 0x80:
            end -= 1
        if end > start:
            found.append((start, end))
    return found


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        for piece in pieces([batch], column=names.index("_text")):
            texts = []
            for text, spans in zip(piece.column("_text").to_pylist(), piece.column("_spans").to_pylist()):
                texts.append(_kept(text, _whole_signs(text, merged(spans, len(text)))).decode())
            yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(texts, pa.string())], ["row", "text"])


def cut_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with repeated strings cut out of `text`, as in `removal_digests` but by whole characters.

    All other columns pass unchanged; no row is dropped. Rows without repeats keep their text, null included.
    """
    rest = docs.select(whole_row(docs.drop("text")), "doc_id", "text")
    some, others = _split(rest)
    covered = some.where("_spans IS NOT NULL").select("row", "_text", "_spans")
    cut = covered.mapInArrow(_cut_texts, covered.select("row", F.lit("").alias("text")).schema)
    left = some.where("_spans IS NULL").select("row", "text")
    rows = cut.unionByName(left).unionByName(others.select("row", "text"))
    return rows.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
