"""Periodic runs of words, by uniting suffix classes in order of decreasing common prefix.

Suffixes whose first words agree form a class; with a shorter prefix, classes unite. Each keeps its
positions in order. Two positions that become neighbours at a distance within their common prefix
are the beginning of a run: a stretch in which words that far apart are equal.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import Rows, utf8

LEAST_LENGTH = 12
PIECE = 512
MIX = np.uint64(0x9E3779B97F4A7C15)


class Positions:
    """An ordered set of positions in pieces, so that putting one in costs little in a large set."""

    def __init__(self, first: int):
        self.pieces, self.n = [[first]], 1

    def __iter__(self) -> Iterator[int]:
        for piece in self.pieces:
            yield from piece

    def add(self, position: int) -> tuple[int, int]:
        """Put ``position`` in and return its neighbours, -1 where there is none."""
        pieces = self.pieces
        at = 0
        if len(pieces) > 1:
            at = max(bisect_left(pieces, position, key=lambda piece: piece[0]) - 1, 0)
        piece = pieces[at]
        i = bisect_left(piece, position)
        before = piece[i - 1] if i else -1
        if i < len(piece):
            after = piece[i]
        else:
            after = pieces[at + 1][0] if at + 1 < len(pieces) else -1
        piece.insert(i, position)
        self.n += 1
        if len(piece) > PIECE:
            half = len(piece) // 2
            pieces[at : at + 1] = [piece[:half], piece[half:]]
        return before, after


def ranks_of_grams(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank, size) of the class of every position's next ``width`` words; what follows the text is
    less than any word. The rank is the place of the class's first member among all positions.
    """
    n = len(words)
    rank, covered = words.astype(np.int64) + 1, 1

    def behind(distance: int) -> np.ndarray:
        return np.concatenate((rank[distance:], np.zeros(min(distance, n), np.int64)))

    while covered < width:
        step = min(covered, width - covered)
        _, rank = np.unique(rank * np.int64(n + 2) + behind(step), return_inverse=True)
        rank, covered = rank + 1, covered + step
    _, rank, sizes = np.unique(rank, return_inverse=True, return_counts=True)
    return (np.cumsum(sizes) - sizes)[rank], sizes[rank]


def sorted_suffixes(words: np.ndarray, width: int) -> tuple[list[int], list[bool]]:
    """The positions whose next ``width`` words occur twice, in the order of their suffixes, and
    whether each shares them with the one before.

    By doubling; only classes of several members are refined, and their ranks stay comparable with
    those of all other positions.
    """
    n = len(words)
    first, size = ranks_of_grams(words, width)
    rank = np.append(first, -1)
    starts = np.flatnonzero(size > 1)
    starts = starts[np.argsort(first[starts], kind="stable")]
    active, step = starts, width
    while len(active):
        own, after = rank[active], rank[np.minimum(active + step, n)]
        order = np.lexsort((after, own))
        active, own, after = active[order], own[order], after[order]
        new_class = np.concatenate(([True], own[1:] != own[:-1]))
        new_part = new_class | np.concatenate(([True], after[1:] != after[:-1]))
        at = np.arange(len(active))
        class_start = np.maximum.accumulate(np.where(new_class, at, 0))
        part_start = np.maximum.accumulate(np.where(new_part, at, 0))
        rank[active] = own + part_start - class_start
        alone = new_part & np.append(new_part[1:], True)
        active, step = active[~alone], step * 2
    order = starts[np.argsort(rank[starts], kind="stable")]
    same = np.concatenate(([False], first[order[1:]] == first[order[:-1]]))
    return order.tolist(), same.tolist()


def common_prefixes(words: list[int], order: list[int], same: list[bool]) -> list[int]:
    """For every suffix in ``order`` how many words it shares with the one before it; 0 where not ``same``.

    In order of position: a suffix shares at most one word less than the suffix before it does.
    """
    n, h = len(words), 0
    before = [-1] * n
    for k, i in enumerate(order):
        if same[k]:
            before[i] = order[k - 1]
    shared = [0] * n
    for i, j in enumerate(before):
        if j < 0:
            h = 0
            continue
        while i + h < n and j + h < n and words[i + h] == words[j + h]:
            h += 1
        shared[i] = h
        h -= 1
    return [shared[i] for i in order]


def may_repeat(words: np.ndarray, width: int) -> bool:
    """Whether some ``width`` words occur twice, by their hashes: never False where they do."""
    if len(words) <= width:
        return False
    mixed = (words.astype(np.uint64) + np.uint64(1)) * MIX
    mixed ^= mixed >> np.uint64(29)
    hashed = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        hashed = hashed * MIX + mixed[k : k + len(hashed)]
    hashed.sort()
    return bool((hashed[1:] == hashed[:-1]).any())


def unite(large: Positions, small: Positions) -> Iterator[tuple[int, int]]:
    """Put ``small`` into ``large`` and yield the pairs of neighbours that this makes."""
    last = after = -1
    for i in list(small):
        # A pair counts unless the next position parts it.
        if after >= 0 and after < i:
            yield last, after
        before, after = large.add(i)
        if before >= 0 and before != last:
            yield before, i
        last = i
    if after >= 0:
        yield last, after


def find_runs(words: np.ndarray, least: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a text given as numbers of its words, by start, then period.

    A run of at least ``least`` words shares half of them with itself one period on, so only
    positions whose next ``(least + 1) // 2`` words recur are sorted and united.
    """
    width = (least + 1) // 2
    if len(words) < least or not may_repeat(words, width):
        return []
    order, same = sorted_suffixes(words, width)
    text = words.tolist()
    shared = common_prefixes(text, order, same)
    edges = sorted((k for k, h in enumerate(shared) if h >= width), key=lambda k: -shared[k])
    owner = list(range(len(order)))
    classes: dict[int, Positions] = {}
    runs = []

    def find(k: int) -> int:
        while owner[k] != k:
            owner[k] = owner[owner[k]]
            k = owner[k]
        return k

    for k in edges:
        h, a, b = shared[k], find(k - 1), find(k)
        large = classes.pop(a, None) or Positions(order[a])
        small = classes.pop(b, None) or Positions(order[b])
        if large.n < small.n:
            large, small, a, b = small, large, b, a
        for i, j in unite(large, small):
            q = j - i
            # Other pairs of a run begin later in it; its first one is not extended to the left.
            if q <= h and q + h >= least and (i == 0 or text[i - 1] != text[j - 1]):
                runs.append((i, q + h, q))
        owner[b], classes[a] = a, large
    runs.sort(key=lambda run: (run[0], run[2]))
    return runs


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words are left if each run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.binary())])
FOUND_DDL = """doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>,
    collapsed binary"""


def periodic_runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of (doc_id, text).

    Words are what ASCII white space separates, numbered from 0. A run (start, length, period) is a
    stretch of at least ``least`` words and two periods, period the smallest, that cannot be made
    longer; runs may overlap and are ordered by start, then period. ``collapsed`` is the text of the
    words, joined by one space, that no run has after its first period.

    A null or empty text has no words, no runs and the empty text; repeated rows are rows of their
    own; a null id stays null; other columns are left out. Texts are read whole, one at a time, and
    take about 300 bytes of memory a word where words recur, in n log n time.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(FOUND)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = text.split()
                numbers: dict[bytes, int] = {}
                found = []
                if len(words) >= least:
                    text_numbers = [numbers.setdefault(word, len(numbers)) for word in words]
                    found = find_runs(np.array(text_numbers, np.int64), least)
                if found:
                    kept = kept_words(len(words), found)
                    collapsed = b" ".join(word for word, keep in zip(words, kept.tolist()) if keep)
                else:
                    collapsed = b" ".join(words)
                named = [{"start": s, "length": n, "period": p} for s, n, p in found]
                yield from rows.add((doc_id, len(words), named, collapsed), len(collapsed) + 64 * len(found))
        yield from rows.flush()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(search, FOUND_DDL).withColumn("collapsed", F.col("collapsed").cast("string"))
