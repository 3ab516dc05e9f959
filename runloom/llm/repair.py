"""Conversation repair: weighted interval parsing over the roles of a conversation's rows.

A repaired conversation has the role initials ``(s?(ua)+)?``. The grammar that reads damaged rows is in
Chomsky normal form. Its symbols X[p,q] stand for a span whose edits take the wanted sequence from
state p to state q:

    X[p,r] -> X[p,q] X[q,r]      a span of two spans
    X[p,q] -> row                one row kept, given another role or deleted, insertions around it

The cell of a span holds for each symbol the cheapest edits as (cost, audit), of equal costs the least
audit. Cells are combined bottom-up by span length. The rules let every split of a span name the same
edits, so the cell of a span is that of any one of its splits: halves are enough, and a long
conversation is parsed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import Rows, durable
from runloom.operators.numbering import BLOCK_BITS, placed

# States of the wanted sequence: nothing yet, after a system, user or assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FINAL = (START, ASSISTANT)
NEXT = {(START, "s"): SYSTEM, (ASSISTANT, "u"): USER, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT}
FULL = {"u": "user", "a": "assistant"}

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
OK, BLANK, DUPLICATE, CUT = range(4)

# The cheapest edits (cost, audit) of each symbol X[p,q] of a span.
Cell = dict[tuple[int, int], tuple[int, str]]


def better(cell: Cell, symbol: tuple[int, int], edits: tuple[int, str]) -> None:
    if symbol not in cell or edits < cell[symbol]:
        cell[symbol] = edits


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of a span from the cells of its two parts, by the rules X[p,r] -> X[p,q] X[q,r]."""
    cell: Cell = {}
    for (p, q), (cost, audit) in left.items():
        for r in STATES:
            more = right.get((q, r))
            if more is not None:
                better(cell, (p, r), (cost + more[0], audit + more[1]))
    return cell


def insertions() -> Cell:
    """The cell of an empty span: no edit, or insertions one after the other until nothing improves."""
    closure: Cell = {(p, p): (0, "") for p in STATES}
    one = {(p, NEXT[p, role]): (INSERT, "I") for p in STATES for role in FULL if (p, role) in NEXT}
    while True:
        longer = combine(closure, one)
        size = dict(closure)
        for symbol, edits in longer.items():
            better(closure, symbol, edits)
        if closure == size:
            return closure


EMPTY = insertions()


def row_cell(initial: str, fault: int) -> Cell:
    """The cell of one row, insertions before and after it included."""
    cell: Cell = {}
    extra = TRUNCATED if fault == CUT else 0
    for p in STATES:
        better(cell, (p, p), (DELETE, "D"))
        if fault in (BLANK, DUPLICATE):
            continue
        if (p, initial) in NEXT:
            better(cell, (p, NEXT[p, initial]), (KEEP + extra, "K"))
        for role in FULL:
            if (p, role) in NEXT:
                better(cell, (p, NEXT[p, role]), (REROLE + extra, "R"))
    return combine(combine(EMPTY, cell), EMPTY)


ROW_CELLS = {(initial, fault): row_cell(initial, fault) for initial in ("s", "u", "a", "") for fault in range(4)}


def cell_of_row(initial: str, fault: int) -> Cell:
    return ROW_CELLS[initial if initial in "sua" else "", fault]


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[START, q] for q in FINAL if (START, q) in cell)


class Spans:
    """Cells of neighbouring spans, of falling length; equal lengths are combined at once."""

    def __init__(self):
        self.open: list[tuple[int, Cell]] = []

    def add(self, cell: Cell) -> None:
        length = 1
        while self.open and self.open[-1][0] == length:
            length, cell = 2 * length, combine(self.open.pop()[1], cell)
        self.open.append((length, cell))

    def cell(self) -> Cell:
        """The cell of all that was added, the short spans at the end first."""
        whole = None
        for _, cell in reversed(self.open):
            whole = cell if whole is None else combine(cell, whole)
        return EMPTY if whole is None else whole


def cell_text(cell: Cell) -> str:
    return ",".join(f"{p}{q}{cost}{audit}" for (p, q), (cost, audit) in sorted(cell.items()))


def cell_from(text: str) -> Cell:
    cell: Cell = {}
    for part in text.split(","):
        audit = part[2:].lstrip("0123456789")
        cell[int(part[0]), int(part[1])] = (int(part[2 : len(part) - len(audit)]), audit)
    return cell


# What is counted of a span beside its cell: (faults by kind, illegal pairs, first and last initial,
# distinct turns, first and last turn). Rows of a span are in order, so its ends are enough.
class Counts:
    def __init__(self):
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.last = None
        self.low = self.high = None

    def add(self, faults, illegal, first, last, turns, low, high) -> None:
        self.faults = [a + b for a, b in zip(self.faults, faults)]
        if first is not None:
            self.illegal += illegal + (self.last is not None and self.last + first not in ("su", "ua", "au"))
            self.first, self.last = first if self.first is None else self.first, last
        if low is not None:
            self.turns += turns - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high

    def add_row(self, initial: str, fault: int, turn: int | None) -> None:
        faults = [0, 0, 0, 0]
        faults[fault] = 1
        self.add(faults, 0, initial, initial, 1, turn, turn)

    def values(self) -> tuple:
        return (self.faults, self.illegal, self.first, self.last, self.turns, self.low, self.high)


WHITE = " \t\n\x0b\x0c\r"
SEGMENT = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("block", pa.int64()),
        ("cell", pa.string()),
        ("faults", pa.list_(pa.int64())),
        ("illegal", pa.int64()),
        ("first", pa.string()),
        ("last", pa.string()),
        ("turns", pa.int64()),
        ("low", pa.int64()),
        ("high", pa.int64()),
    ]
)
SEGMENT_DDL = """conv_id bigint, block bigint, cell string, faults array<bigint>, illegal bigint, first string,
    last string, turns bigint, low bigint, high bigint"""
SUMMARY = pa.schema(
    [("conv_id", pa.int64())]
    + [(name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string())]
)
SUMMARY_DDL = """conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint,
    cost bigint, audit string"""


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest): nulls of role and text are one space; equal rows have one digest."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    told = F.concat(F.length(role), F.lit(":"), role, text)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.sha2(told, 256)).alias("digest"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, block, _at, turn, initial, fault) of marked rows, without their texts.

    Rows are placed in order and cut into blocks of neighbours, whatever conversation they are of. Of
    equal rows of a conversation the first place is found by an aggregate, so no group is gathered.
    """
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    slim = rows.select(
        "conv_id",
        "turn",
        F.left("role", F.lit(1)).alias("initial"),
        F.when(end == "", BLANK).when(end.isin(".", "!", "?"), OK).otherwise(CUT).alias("own"),
        "digest",
    )
    order = placed(slim, ["conv_id", "turn", "digest"])
    first = order.groupBy("conv_id", "digest").agg(F.min("_at").alias("_at")).select("_at", F.lit(True).alias("first"))
    fault = F.when((F.col("own") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("own"))
    return order.join(first, "_at", "left").select(
        "conv_id", F.shiftright("_at", BLOCK_BITS).alias("block"), "_at", "turn", "initial", fault.alias("fault")
    )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def parse_blocks(rows: DataFrame) -> DataFrame:
    """One cell and the counts for each conversation's rows in a block of at most 1,024."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(SEGMENT)
        for (conv_id, block), members in groupby(_stream(batches), itemgetter(0, 1)):
            spans, counts = Spans(), Counts()
            for _, _, _, turn, initial, fault in members:
                spans.add(cell_of_row(initial, fault))
                counts.add_row(initial, fault, turn)
            text = cell_text(spans.cell())
            yield from out.add((conv_id, block, text, *counts.values()), len(text))
        yield from out.flush()

    inside = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "_at")
    return inside.mapInArrow(parse, SEGMENT_DDL)


def parse_conversations(blocks: DataFrame, all_ids: DataFrame) -> DataFrame:
    """One row for each id of ``all_ids``: the counts, and the cheapest edits of the whole."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(SUMMARY)
        for conv_id, parts in groupby(_stream(batches), itemgetter(0)):
            spans, counts = Spans(), Counts()
            for _, _, text, *counted in parts:
                if text is not None:
                    spans.add(cell_from(text))
                    counts.add(*counted)
            cost, audit = best(spans.cell())
            gaps = 0 if counts.low is None else counts.high - counts.low + 1 - counts.turns
            _, blank, duplicate, cut = counts.faults
            yield from out.add(
                (conv_id, gaps, blank, duplicate, cut, counts.illegal, cost, audit), len(audit)
            )
        yield from out.flush()

    both = blocks.unionByName(all_ids, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(parse, SUMMARY_DDL)


REPAIRED = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
)
REPAIRED_DDL = "conv_id bigint, place bigint, edit string, role string, text string"


def apply_edits(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: a conversation's are in one partition, in order.

    Each text moves once. A conversation passes through one task as a stream, none of it is kept.
    """

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(REPAIRED)
        for conv_id, members in groupby(_stream(batches), itemgetter(0)):
            state = place = 0
            audit = next(members)[4]
            for letter in audit:
                role, text = "", ""
                if letter != "I":
                    _, _, _, _, role, text = next(members)
                if letter == "D":
                    continue
                if letter != "K":
                    role = FULL["a" if state == USER else "u"]
                state = NEXT[state, role[:1]]
                yield from out.add((conv_id, place, letter, role, text), len(text))
                place += 1
        yield from out.flush()

    # The audit comes before the rows of its conversation.
    audits = summary.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.unhex(F.lit("")).alias("digest"),
        F.col("audit").alias("role"), F.lit("").alias("text"),
    )
    told = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "role", "text")
    together = audits.unionByName(told).repartition("conv_id")
    return together.sortWithinPartitions("conv_id", "kind", "turn", "digest").mapInArrow(edit, REPAIRED_DDL)


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, repaired) of conversation rows (conv_id, turn, role, text).

    ``summary`` has one row per conversation: gaps in its turn numbers, rows by their first fault
    (blank, duplicate of an earlier row's role and text, truncated: no ``.!?`` at the end), illegal
    pairs of neighbouring role initials (none of su, ua, au), and the cheapest repair's cost and
    audit, one letter an edit: K keeps a row (cost 0), R makes it a user or assistant row (2), D
    deletes it (3; blank and duplicate rows have to go), I inserts an empty user or assistant row
    (2); a truncated row that stays costs 1 more. Among equally cheap ones the audit is least in
    ASCII. ``repaired`` has the rows (conv_id, place, edit, role, text) of the repaired conversations.

    Rows are taken by turn, nulls first; rows of one turn in order of a digest, so equal ones follow
    each other. A null role or text is one space, an initial other than s, u and a fits nowhere. Null
    ids make one conversation. ``conversations`` (conv_id) names those that have a summary without
    having rows: zeros and no edits; an empty table gives empty results. Other columns are left out.
    A block of at most 1,024 rows is parsed in memory; a conversation's audit is one text.
    """
    told = marked(rows)
    ids = told if conversations is None else conversations
    all_ids = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    summary = durable(parse_conversations(parse_blocks(with_faults(told)), all_ids))
    return summary, apply_edits(told, summary)
