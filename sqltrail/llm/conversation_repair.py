"""Repair of conversations by weighted CYK parsing over spans of turns.

The grammar is that of an optional system turn and then user and assistant turns in alternation. Its nonterminals say
from which state to which other a span takes the conversation, so it is in Chomsky normal form: a nonterminal is an
edited turn, or two nonterminals that meet in a state. A cell of the chart holds, for each nonterminal of a span, the
least (cost, audit), where the audit is the text of the edits' initials. Insertions are closed over in the cells of
single turns.

Equal costs mean that neither audit starts the other (a longer one would cost more), so the least audits of two spans
make the least audit of both, and since every state is a nonterminal's end, one split of a span finds all its parses.
Spans double in length from one level to the next, and spans that different tasks hold are combined the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sqltrail.llm.common import ship_code, stored

#: Costs of the edits; a truncated turn that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a conversation that a task holds; a longer one is put together from its spans.
HELD_ROWS = 4_096

# States: nothing yet, after a system, a user, an assistant turn. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Role of a turn that is inserted or gets another role, by the state before it.
ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
LEGAL = {"su", "ua", "au"}

Cell = list[tuple[int, str] | None]


def _next(state: int) -> int:
    return STEP[state, ROLE[state][0]]


def _insertions() -> Cell:
    """The cell of an empty span: turns are only inserted."""
    cell: Cell = [None] * (STATES * STATES)
    for first in range(STATES):
        state, cost, audit = first, 0, ""
        while cell[first * STATES + state] is None:
            cell[first * STATES + state] = (cost, audit)
            state, cost, audit = _next(state), cost + INSERT, audit + "I"
    return cell


def _splits(reached: Cell) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each nonterminal the pairs that make it up: states lead on only as insertions and kept turns do."""
    leads = {(p, q) for p in range(STATES) for q in range(STATES) if reached[p * STATES + q] or (p, q) == (START, SYSTEM)}
    return [
        (p * STATES + q, [(p * STATES + r, r * STATES + q) for r in range(STATES) if (p, r) in leads and (r, q) in leads])
        for p, q in sorted(leads)
    ]


EMPTY = _insertions()
_RULES = _splits(EMPTY)


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of a span from those of its two parts."""
    out: Cell = [None] * (STATES * STATES)
    for target, pairs in _RULES:
        best = audit = None
        for i, j in pairs:
            a, b = left[i], right[j]
            if a is None or b is None:
                continue
            cost = a[0] + b[0]
            if best is None or cost < best or (cost == best and a[1] + b[1] < audit):
                best, audit = cost, a[1] + b[1]
        if best is not None:
            out[target] = (best, audit)
    return out


def _closed(cell: Cell) -> Cell:
    """A cell with turns inserted before and after."""
    return combined(combined(EMPTY, cell), EMPTY)


@cache
def turn_cell(initial: str, fault: str) -> Cell:
    """The cell of one turn: kept, with another role, or deleted; blank and repeated turns are always deleted."""
    if fault in ("blank", "duplicate"):
        return deleted_cell(1)
    cell: Cell = [None] * (STATES * STATES)
    extra = TRUNCATED if fault == "truncated" else 0
    for state in range(STATES):
        cell[state * STATES + state] = (DELETE, "D")
        options = [(_next(state), extra + REROLE, "R")]
        if (state, initial) in STEP:
            options.append((STEP[state, initial], extra, "K"))
        for after, cost, letter in options:
            at = state * STATES + after
            cell[at] = min(x for x in (cell[at], (cost, letter)) if x is not None)
    return _closed(cell)


def deleted_cell(number: int) -> Cell:
    """The cell of turns that are all deleted. Insertions between them are no better than after them."""
    cell: Cell = [None] * (STATES * STATES)
    for state in range(STATES):
        cell[state * STATES + state] = (DELETE * number, "D" * number)
    return _closed(cell)


def parsed(cells: list[Cell]) -> Cell:
    """The cell of consecutive spans, combined level by level, each level's spans twice as long."""
    while len(cells) > 1:
        cells = [combined(cells[i], cells[i + 1]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else EMPTY


def best_parse(cell: Cell) -> tuple[int, str, int]:
    """Cost, audit and last state of a whole conversation."""
    return min((*cell[START * STATES + state], state) for state in (START, ASSISTANT) if cell[START * STATES + state])


class Repair:
    """The turns of a conversation after its edits, and the SHA-256 of their lines."""

    def __init__(self):
        self.state = START
        self.hash = hashlib.sha256()
        self.some = False
        self.edits: Iterator[str] = iter("")

    def _line(self, role: str, text: str) -> None:
        self.state = STEP[self.state, role[:1]]
        self.hash.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
        self.some = True

    def begin(self, audit: str) -> None:
        """Ends one span's edits and takes up the next one's."""
        for _ in self.edits:
            self._line(ROLE[self.state], "")
        self.edits = iter(audit)

    def turn(self, role: str, text: str, copies: int) -> None:
        while copies:
            edit = next(self.edits)
            if edit == "I":
                self._line(ROLE[self.state], "")
                continue
            copies -= 1
            if edit != "D":
                self._line(role if edit == "K" else ROLE[self.state], text)

    def digest(self) -> str:
        self.begin("")
        return self.hash.hexdigest()


class Span:
    """What is known of consecutive rows of a conversation."""

    def __init__(self):
        self.cells: list[Cell] = []
        self.first = self.last = None
        self.first_turn = self.last_turn = None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0

    def add(self, turn: int | None, role: str, blank: bool, cut: bool, seen: bool, copies: int) -> None:
        """Equal rows stand together and come as one with their number; all but the first repeat it."""
        if not copies:
            return
        initial = role[:1]
        known = initial if initial in "sua" else ""
        if blank:
            self.blank += copies
            self.cells.append(deleted_cell(copies))
        else:
            fault = "duplicate" if seen else "truncated" if cut else ""
            self.duplicate += copies - (not seen)
            self.truncated += fault == "truncated"
            self.cells.append(turn_cell(known, fault))
            if copies > 1:
                self.cells.append(deleted_cell(copies - 1))
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += (copies - 1) * (initial * 2 not in LEGAL)
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None:
            if turn != self.last_turn:
                self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def cell(self) -> Cell:
        self.cells = [parsed(self.cells)]
        return self.cells[0]

    def counts(self) -> dict:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


def _joined(spans: Iterable[dict]) -> Span:
    """Counts of consecutive spans as one; cells are left out."""
    whole = Span()
    for span in spans:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(whole, name, getattr(whole, name) + span[name])
        if span["first"] is not None:
            whole.illegal += whole.last is not None and whole.last + span["first"] not in LEGAL
            whole.first, whole.last = whole.first or span["first"], span["last"]
        if span["turns"]:
            whole.turns += span["turns"] - (span["first_turn"] == whole.last_turn)
            whole.first_turn = span["first_turn"] if whole.first_turn is None else whole.first_turn
            whole.last_turn = span["last_turn"]
    return whole


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_RESULT = ", ".join(f"{c} bigint" for c in (*_COUNTS, "cost")) + ", audit string, repaired_sha256 string"
_CELLS = "array<struct<pair:int,cost:bigint,audit:string>>"
_SPAN = f"first string, last string, first_turn bigint, last_turn bigint, turns bigint, cells {_CELLS}"
_ROW = "block int, place bigint, role string, text string, copies bigint"
_INT_RESULT = [(c, pa.int64()) for c in (*_COUNTS, "cost")]
_ARROW_CELLS = pa.list_(pa.struct([("pair", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _listed(cell: Cell) -> list[dict]:
    return [{"pair": i, "cost": x[0], "audit": x[1]} for i, x in enumerate(cell) if x is not None]


def _unlisted(cells: list[dict]) -> Cell:
    cell: Cell = [None] * (STATES * STATES)
    for x in cells:
        cell[x["pair"]] = (x["cost"], x["audit"])
    return cell


def _first_pass(schema: pa.Schema, held_rows: int):
    """Sorted rows to results of whole conversations, and to spans and rows of those that other tasks may share.

    These are the first and the last conversation of a task, and those of more than `held_rows` rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        out: list[dict] = []
        held: list[tuple] = []
        span, current, began, shared, place = Span(), None, False, False, 0

        def row(turn: tuple, at: int) -> dict:
            return {"kind": "row", "conv_id": current, "block": block, "place": at, "role": turn[0], "text": turn[1], "copies": turn[2]}

        def whole() -> dict:
            cost, audit, _ = best_parse(span.cell())
            repair = Repair()
            repair.begin(audit)
            for turn in held:
                repair.turn(*turn)
            return {"kind": "whole", "conv_id": current, **span.counts(), "cost": cost, "audit": audit, "repaired_sha256": repair.digest()}

        def part() -> list[dict]:
            facts = {c: getattr(span, c) for c in ("blank", "duplicate", "truncated", "illegal", "first", "last", "first_turn", "last_turn", "turns")}
            return [*(row(turn, place - len(held) + i) for i, turn in enumerate(held)), {"kind": "span", "conv_id": current, "block": block, **facts, "cells": _listed(span.cell())}]

        def flushed() -> Iterator[pa.RecordBatch]:
            for start in range(0, len(out), 1024):
                yield pa.RecordBatch.from_pylist(out[start : start + 1024], schema)
            out.clear()

        for batch in batches:
            for conv, turn, role, text, blank, cut, seen, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not began or conv != current:
                    if began:
                        out.extend(part() if shared else [whole()])
                    shared = not began
                    span, current, began, place = Span(), conv, True, 0
                    held.clear()
                span.add(turn, role, blank, cut, seen, copies)
                if copies:
                    held.append((role, text, copies))
                    place += 1
                shared = shared or len(held) > held_rows
                if shared and held:
                    out.extend(row(turn, place - len(held) + i) for i, turn in enumerate(held))
                    held.clear()
                if len(span.cells) >= held_rows:
                    span.cell()
            yield from flushed()
        if began:
            out.extend(part())
        yield from flushed()

    return work


def _spans_combined(schema: pa.Schema):
    """Spans of a conversation, by block, to its result and to the edits of each span."""

    def work(table: pa.Table) -> pa.Table:
        spans = sorted(table.to_pylist(), key=lambda s: s["block"])
        conv = spans[0]["conv_id"]
        levels = [[_unlisted(s["cells"]) for s in spans]]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([combined(below[i], below[i + 1]) if i + 1 < len(below) else below[i] for i in range(0, len(below), 2)])
        cost, audit, last = best_parse(levels[-1][0])
        # From the whole down: which nonterminal of each part the best parse uses.
        ends = [(START, last)]
        for below in reversed(levels[:-1]):
            ends = [pair for i, (p, q) in enumerate(ends) for pair in _parts(below[2 * i : 2 * i + 2], p, q)]
        out = [{"kind": "whole", "conv_id": conv, **_joined(spans).counts(), "cost": cost, "audit": audit}]
        for span, cell, (p, q) in zip(spans, levels[0], ends, strict=True):
            out.append({"kind": "edits", "conv_id": conv, "block": span["block"], "audit": cell[p * STATES + q][1]})
        return pa.Table.from_pylist(out, schema)

    return work


def _parts(cells: list[Cell], p: int, q: int) -> list[tuple[int, int]]:
    if len(cells) == 1:
        return [(p, q)]
    left, right = cells
    met = [(a[0] + b[0], a[1] + b[1], r) for r in range(STATES) if (a := left[p * STATES + r]) and (b := right[r * STATES + q])]
    middle = min(met)[2]
    return [(p, middle), (middle, q)]


def _digests(schema: pa.Schema):
    """Rows and edits, sorted by conversation, block and place (edits first), to the SHA-256 of the repaired lines."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, repair = None, None
        for batch in batches:
            out = []
            for conv, place, role, text, copies, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if repair is None or conv != current:
                    if repair is not None:
                        out.append({"conv_id": current, "sha": repair.digest()})
                    current, repair = conv, Repair()
                if place < 0:
                    repair.begin(audit)
                else:
                    repair.turn(role, text, copies)
            yield pa.RecordBatch.from_pylist(out, schema)
        if repair is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": current, "sha": repair.digest()}], schema)

    return work


def _with_earlier(rows: DataFrame) -> DataFrame:
    """Adds `seen`: the role and text stand in an earlier row of the conversation."""
    several = rows.where("copies > 0").groupBy("same").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("turn").isNull()).alias("untimed"), F.min("turn").alias("least")
    ).where("n > 1")
    first = F.col("turn").isNull() | (~F.col("untimed") & (F.col("turn") == F.col("least")))
    joined = rows.join(several.withColumnRenamed("same", "_same"), F.col("same") == F.col("_same"), "left")
    return joined.withColumn("seen", F.col("_same").isNotNull() & ~first)


def repaired_conversations(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    copies_col: str | None = None, held_rows: int = HELD_ROWS,
) -> DataFrame:
    """`conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`: a row for each conversation.

    Rows are taken by turn, null first; rows of a turn by a hash of role and text, equal rows together. A row's first fault
    counts: blank (nothing but ASCII white space), duplicate (role and text stand in an earlier row),
    truncated (its last other character is none of `.!?`). `gaps` are turns missing between the least and the greatest,
    `illegal` neighbours are other than system-user, user-assistant, assistant-user by their roles' initials.

    The edits are the cheapest that leave an optional system turn and then any number of user-assistant pairs: Keep (0),
    Rerole (1), Delete (2), Insert (5); blank and duplicate rows are deleted, truncated ones that stay cost 5 more. Of
    equally cheap edits the audit, their initials in order, is the least. `repaired_sha256` is that of the lines
    `role:text` after them.

    Null roles and texts count as one space, and no role but those that start with s, u or a can be kept; a null id is an
    id. Rows that repeat are counted before they are shuffled. `copies_col` says how often a row stands; a conversation
    that only has rows of 0 copies has zeros, an empty audit and the hash of the empty text. No rows give no rows. Other
    columns are ignored.

    Rows are sorted over all tasks, so a conversation of any length is spread over several; the tasks parse the spans they
    hold. The spans' cells, which hold as many letters as the conversation has rows, are then combined, and its lines are
    hashed as a stream.
    """
    space = F.lit(" ")
    same = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.char_length("role").cast("string"), F.concat("role", "text")), 256)
    rows = (
        conversations.select(
            F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
            F.coalesce(F.col(f"`{role_col}`"), space).alias("role"), F.coalesce(F.col(f"`{text_col}`"), space).alias("text"),
            (F.col(f"`{copies_col}`") if copies_col else F.lit(1)).cast("long").alias("copies"),
        )
        .groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
        .withColumn("same", same)
    )
    rows = stored(rows)
    ends = r"[^\x20\x09-\x0D]"
    facts = _with_earlier(rows).select(
        "conv_id", "turn", "role", "text", (~F.col("text").rlike(ends)).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z")).alias("cut"), "seen", "copies", "same",
    )
    order = ["conv_id", "turn", "same"]
    dealt = facts.repartitionByRange(*order).sortWithinPartitions(*order).drop("same")

    kind = rows.schema["conv_id"].dataType
    arrow_id = ("conv_id", to_arrow_type(kind))
    fields = [("kind", pa.string()), arrow_id, *_INT_RESULT, ("audit", pa.string()), ("repaired_sha256", pa.string())]
    span_fields = [("first", pa.string()), ("last", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("cells", _ARROW_CELLS)]
    row_fields = [("block", pa.int32()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())]
    identity = f"kind string, conv_id {kind.simpleString()}"
    passed = stored(
        ship_code(dealt).mapInArrow(_first_pass(pa.schema([*fields, *span_fields, *row_fields]), held_rows), f"{identity}, {_RESULT}, {_SPAN}, {_ROW}")
    )
    result = ["conv_id", *_COUNTS, "cost", "audit", "repaired_sha256"]
    whole = passed.where("kind = 'whole'").select(*result)

    spans = passed.where("kind = 'span'").drop("kind", "gaps", "cost", "audit", "repaired_sha256", "place", "role", "text", "copies")
    edits = stored(spans.groupBy("conv_id").applyInArrow(_spans_combined(pa.schema([*fields, ("block", pa.int32())])), f"{identity}, {_RESULT}, block int"))
    lines = passed.where("kind = 'row'").select("conv_id", "block", "place", "role", "text", "copies", F.lit(None).cast("string").alias("audit")).unionByName(
        edits.where("kind = 'edits'").select("conv_id", "block", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), "audit")
    )
    streamed = lines.repartition("conv_id").sortWithinPartitions("conv_id", "block", "place").drop("block")
    digests = ship_code(streamed).mapInArrow(_digests(pa.schema([arrow_id, ("sha", pa.string())])), f"conv_id {kind.simpleString()}, sha string")
    found = edits.where("kind = 'whole'").alias("e").join(digests.alias("d"), F.col("e.conv_id").eqNullSafe(F.col("d.conv_id")))
    shared = found.select("e.conv_id", *_COUNTS, "cost", "audit", F.col("sha").alias("repaired_sha256"))
    return whole.unionByName(shared)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by a hash of id and turn: dropped (0 copies), emptied, without `.!?`, twice, or of a user.

    Nulls count as one space. Columns: `conv_id, turn, role, text, copies`.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    fault = F.crc32(key) % 20
    text = F.coalesce("text", space)
    dropped = fault == 0
    return conversations.select(
        "conv_id", F.when(~dropped, F.col("turn")).alias("turn"),
        F.when(dropped, space).when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(dropped, space).when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(dropped, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )
