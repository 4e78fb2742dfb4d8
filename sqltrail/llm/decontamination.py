"""Benchmark decontamination by a Wu-Manber search over words.

Test strings are windows of consecutive words of the benchmark's items. A table says for each block of two words how far
the search may move on; where it may not, the block's bucket gives the test strings that end with it, and those that
also start alike are compared word by word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltrail.llm.common import pieces, ship_code, stored

#: Consecutive words that make a test string.
WINDOW_WORDS = 10
#: Bytes of benchmark text whose tables a task holds at a time; a larger benchmark is searched for in several passes.
MOST_BYTES = 2 << 20
#: Words of an item that stay together; longer items are cut into runs that overlap by a window.
RUN_WORDS = 4_096
#: Bytes of a text whose words a task holds at a time.
SLICE_BYTES = 1 << 20

# A word is a run of ASCII digits and letters and of anything that is not ASCII, in UTF-8.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def word_slices(text: str | None, size: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in lists of about `size` bytes; no word is cut."""
    data = (text or "").encode().lower()
    start = 0
    while start < len(data):
        gap = _GAP.search(data, start + size) if start + size < len(data) else None
        end = gap.start() if gap else len(data)
        yield _WORD.findall(data, start, end)
        start = end


def item_runs(text: str | None, window: int, most: int = RUN_WORDS) -> Iterator[list[bytes]]:
    """Runs of an item's words that have the same windows as the item; none if it has no words."""
    held: list[bytes] = []
    fresh = 0
    for words in word_slices(text):
        for word in words:
            held.append(word)
            fresh += 1
            if len(held) == most + window - 1:
                yield held
                held, fresh = held[-(window - 1):] if window > 1 else [], 0
    if fresh:
        yield held


class Search:
    """The tables for test strings of one length: shifts by block, and buckets by last and by first block."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.shift: dict = {}
        self.buckets: dict = {}
        self._strings: dict[bytes, tuple[list[bytes], set[str]]] = {}

    def add(self, words: list[bytes], item: str) -> None:
        """Every window of `words` as a test string of `item`."""
        m, b = self.length, self.block
        for end in range(b - 1, len(words)):
            key = (words[end - 1], words[end]) if b == 2 else words[end]
            # The first window holds this block furthest from its end; later ones end with it.
            move = max(0, m - 1 - end)
            if self.shift.get(key, m) > move:
                self.shift[key] = move
        for start in range(len(words) - m + 1):
            string = words[start : start + m]
            known = self._strings.get(joined := b" ".join(string))
            if known is None:
                known = self._strings[joined] = (string, set())
                last = (string[-2], string[-1]) if b == 2 else string[-1]
                self.buckets.setdefault(last, {}).setdefault(string[0], []).append(known)
            known[1].add(item)

    def find(self, words: list[bytes], start: int) -> Iterator[tuple[int, set[str]]]:
        """Ends of test strings in `words`, from position `start` on, with their items."""
        m, shift, buckets = self.length, self.shift, self.buckets
        default, two = m - self.block + 1, self.block == 2
        end, n = max(start, m - 1), len(words)
        while end < n:
            key = (words[end - 1], words[end]) if two else words[end]
            move = shift.get(key, default)
            if move:
                end += move
                continue
            for string, items in buckets.get(key, {}).get(words[end - m + 1], ()):
                if words[end - m + 1 : end + 1] == string:
                    yield end, items
            end += 1


def searches(runs: list[tuple[str, str]], window: int) -> list[Search]:
    """A search for each length of test string: `window`, and shorter ones for items that have fewer words."""
    found: dict[int, Search] = {}
    for item, run in runs:
        words = run.encode().split(b" ")
        length = min(window, len(words))
        found.setdefault(length, Search(length)).add(words, item)
    return list(found.values())


def hits(text: str | None, tables: list[Search], window: int) -> tuple[int, list[list[int]], set[str]]:
    """Words of a text, runs of words (first, after the last) inside test strings, and the items of these."""
    runs: list[list[int]] = []
    items: set[str] = set()
    tail: list[bytes] = []
    seen = 0
    for fresh in word_slices(text):
        words = tail + fresh
        offset = seen - len(tail)
        ends: list[tuple[int, int]] = []
        for table in tables:
            for end, owners in table.find(words, len(tail)):
                ends.append((offset + end - table.length + 1, offset + end + 1))
                items |= owners
        runs += merged([list(run) for run in ends])
        seen += len(fresh)
        tail = words[-(window - 1):] if window > 1 else []
    return seen, merged(runs), items


def merged(runs: list[list[int]]) -> list[list[int]]:
    """Runs that touch or overlap as one, in order."""
    out: list[list[int]] = []
    for first, after in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], after)
        else:
            out.append([first, after])
    return out


def _runs_of_items(window: int):
    schema = pa.schema([("item", pa.string()), ("run", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for run in item_runs(text, window):
                    yield pa.RecordBatch.from_pydict({"item": [item], "run": [b" ".join(run).decode()]}, schema)

    return work


def _search(runs: list[tuple[str, str]], window: int, schema: pa.Schema, last: bool):
    """Adds what a pass finds to what earlier passes found; the last pass gives no texts back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = searches(runs, window)
        for batch in pieces(batches):
            counts, spans, items = [], [], []
            for text, spans_before, items_before in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4)), strict=True):
                n, found, owners = hits(text, tables, window)
                counts.append(n)
                spans.append([{"first": a, "after": b} for a, b in merged([[s["first"], s["after"]] for s in spans_before] + found)])
                items.append(sorted(owners.union(items_before)))
            texts = pa.nulls(len(counts), pa.string()) if last else batch.column(1)
            arrays = [batch.column(0), texts, pa.array(counts, pa.int64()), pa.array(spans, schema.field(3).type), pa.array(items, schema.field(4).type)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    return work


def item_chunks(benchmark: DataFrame, item_col: str, text_col: str, window: int, most_bytes: int) -> tuple[DataFrame, int]:
    """`item, run, chunk` and the number of chunks, each of which is measured to hold at most `most_bytes`, or one run."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text_col}`").alias("text"))
    runs = stored(ship_code(rows).mapInArrow(_runs_of_items(window), "item string, run string").distinct())
    size = F.octet_length("item") + F.octet_length("run")
    total, largest = runs.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    number = max(1, math.ceil(total / most_bytes))
    while True:
        dealt = runs.withColumn("chunk", F.pmod(F.xxhash64("item", "run"), F.lit(number)).cast("int"))
        fullest = dealt.groupBy("chunk").agg(F.sum(size).alias("size")).agg(F.max("size")).first()[0] or 0
        if fullest <= max(most_bytes, largest):
            return dealt, number
        number = number * 2


def contaminated_words(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW_WORDS, most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """`doc_id, n_words, spans, items` for every row: runs of words inside test strings, and the items these are from.

    Words are runs of ASCII letters (A-Z lower-cased) and digits and of other characters than ASCII. A test string is any
    `window` consecutive words of an item, or all words of an item that has fewer; an item without words has none.
    `spans` are maximal runs (`first` word from 0, `after` the last); test strings that touch form one. `items` are ids as
    text in code point order, each once.

    Documents are not shuffled. The benchmark is measured; beyond `most_bytes` it is dealt into chunks of at most that
    many bytes, and the documents are read once for each chunk, carrying what was found. Long texts are searched in slices
    that overlap by a window, long items are cut into runs that do.

    Null and empty texts have no words. Rows that repeat an id have a row each. A null item id counts as the empty text;
    items that share an id count once. An empty benchmark finds nothing, no documents give no rows. Other columns are
    ignored.
    """
    dealt, number = item_chunks(benchmark, item_col, item_text_col, window, most_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    found = "array<struct<first:bigint,after:bigint>>"
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast(found).alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    schema = f"doc_id {kind}, text string, n_words bigint, spans {found}, items array<string>"
    arrow = pa.schema([
        ("doc_id", _arrow_type(docs, id_col)), ("text", pa.string()), ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))), ("items", pa.list_(pa.string())),
    ])
    for chunk in range(number):
        runs = [(r["item"], r["run"]) for r in dealt.where(F.col("chunk") == chunk).select("item", "run").collect()]
        rows = ship_code(rows).mapInArrow(_search(runs, window, arrow, chunk == number - 1), schema)
        if chunk < number - 1:
            rows = stored(rows)
    return rows.drop("text")


def _arrow_type(docs: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[column].dataType)
