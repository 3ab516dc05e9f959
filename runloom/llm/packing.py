"""Bounded-space online packing of token ids into sequences."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import Rows, durable, utf8
from runloom.llm.tokens import WordEncoder, pack

# Windows that one task keeps open.
OPEN_WINDOWS = 64
# Tasks whose open windows meet in one task of the next round.
FAN_IN = 64

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.binary()),
        ("task", pa.int64()),
        ("open", pa.bool_()),
    ]
)
PIECES_DDL = (
    "doc_id long, start long, doc_tokens long, sequence_id long, offset long, ids binary,"
    " task long, open boolean"
)
# A piece: document, ids before it, ids of its document, its own ids (4 bytes each).
Piece = tuple[int | None, int, int, bytes]


class Packer:
    """Places pieces best-fit into at most ``windows`` open windows of ``capacity`` ids.

    ``put`` returns the windows that it filled. If a piece fits into none and no further
    window may be opened, the fullest one takes as much of it as fits and is given out.
    """

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows = capacity, windows
        self.open: list[tuple[int, int]] = []  # (ids, key), ascending
        self.held: dict[int, list[Piece]] = {}
        self.keys = 0

    def put(self, piece: Piece) -> Iterator[list[Piece]]:
        doc_id, start, total, ids = piece
        while ids:
            n = len(ids) // 4
            fits = bisect_right(self.open, (self.capacity - n, self.keys)) - 1
            if fits >= 0:
                used, key = self.open.pop(fits)
            elif n >= self.capacity or len(self.open) < self.windows:
                used, key = 0, self.keys
                self.keys += 1
                self.held[key] = []
            else:
                used, key = self.open.pop()
            taken = min(n, self.capacity - used)
            self.held[key].append((doc_id, start, total, ids[: 4 * taken]))
            if used + taken == self.capacity:
                yield self.held.pop(key)
            else:
                insort(self.open, (used + taken, key))
            start, ids = start + taken, ids[4 * taken :]

    def rest(self) -> Iterator[list[Piece]]:
        for _, key in self.open:
            yield self.held.pop(key)
        self.open = []

    def last(self) -> Iterator[list[Piece]]:
        """Join what is open; the last, shorter window is cut at powers of two."""
        pieces = [piece for window in self.rest() for piece in window]
        joined = Packer(self.capacity, 1)
        for piece in pieces:
            yield from joined.put(piece)
        for window in joined.rest():
            size = sum(len(ids) for *_, ids in window) // 4
            while size:
                part = 1 << size.bit_length() - 1
                cut = Packer(part, 1)
                filled = [w for piece in window for w in cut.put(piece)]
                window = [p for w in filled[1:] for p in w] + [p for w in cut.rest() for p in w]
                yield filled[0]
                size -= part


def _rows(pieces: Iterator[Piece], capacity: int, windows: int, level: int, final: bool):
    """Packs one task's pieces. Sequence ids: round, task and number within the task."""
    packer, task, number = Packer(capacity, windows), TaskContext.get().partitionId(), 0
    rows = Rows(PIECES)

    def give(found: list[Piece], unfinished: bool):
        nonlocal number
        sequence, offset = (level << 56) | (task << 32) | number, 0
        number += 1
        for doc_id, start, total, ids in found:
            row = (doc_id, start, total, sequence, offset, ids, task, unfinished)
            yield from rows.add(row, len(ids))
            offset += len(ids) // 4

    for piece in pieces:
        for window in packer.put(piece):
            yield from give(window, False)
    for window in packer.last() if final else packer.rest():
        yield from give(window, not final)
    yield from rows.flush()


def _first(tokenizer: str, end_id: int, capacity: int, windows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder.of_worker(tokenizer), pack([end_id])

        def pieces() -> Iterator[Piece]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                    ids = encoder.encode(text) + end
                    yield doc_id, 0, len(ids) // 4, ids

        yield from _rows(pieces(), capacity, windows, 0, False)

    return run


def _again(capacity: int, windows: int, level: int, final: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (
            piece
            for batch in batches
            for piece in zip(*(batch.column(k).to_pylist() for k in range(4)))
        )
        yield from _rows(pieces, capacity, windows, level, final)

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = 2048,
    windows: int = OPEN_WINDOWS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` ids.

    (doc_id, start, doc_tokens, sequence_id, offset, ids): ``ids`` are the piece's ids as
    little-endian unsigned 32-bit integers, ``start`` the document's ids before it, ``offset``
    the ids before it in its sequence. Every document ends with ``end_id``, so a null or empty
    text is one id. Rows that repeat an id are documents of their own. Sequence ids are unique,
    not dense.

    Documents are packed where they are read. The windows a task leaves open go, ``FAN_IN``
    tasks together, through the same packer until one task has the rest; at most
    ``windows`` x ``FAN_IN`` windows meet in a task, whatever the input's size. All sequences
    are full but those the very last window is cut into, whose lengths are powers of two.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    packed = durable(
        slim.mapInArrow(_first(tokenizer, end_id, capacity, windows), PIECES_DDL), "open"
    )
    done, level = packed.where("not open"), 0
    while True:
        left = packed.where("open")
        tasks = left.agg(F.countDistinct("task")).first()[0]
        if not tasks:
            break
        level, groups = level + 1, -(-tasks // FAN_IN)
        if groups == 1:
            group = F.lit(0)
        else:
            group = F.floor(F.col("task") / FAN_IN)
        packed = durable(
            left.select("doc_id", "start", "doc_tokens", "ids", group.alias("group"))
            .repartition(groups, "group")
            .mapInArrow(_again(capacity, windows, level, groups == 1), PIECES_DDL),
            "open",
        )
        done = done.unionByName(packed.where("not open"))
    return done.select("doc_id", "start", "doc_tokens", "sequence_id", "offset", "ids")
