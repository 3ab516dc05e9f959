"""Word passages that repeat: a compressed FM-index per shard, searched backwards."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from runloom.llm.repeats import HOT_CHUNKS, HOT_RUNS, PLACE_BYTES, Unit, remove_repeats

GRAM = 8


class Bits:
    """A bit vector of one bit per symbol with a running count per 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]])

    def ones(self, ends: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = ends >> 6
        mask = (np.uint64(1) << (ends & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """The levels of a wavelet tree over whole numbers, each level one bit vector.

    Symbols are divided by their highest bit, then each half by the next, and so on; a level
    keeps all zeros before all ones.
    """

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels: list[tuple[int, int, Bits]] = []
        for shift in range(max(largest.bit_length(), 1) - 1, -1, -1):
            bits = (symbols >> shift & 1).astype(np.uint8)
            zeros = int(len(bits) - bits.sum())
            self.levels.append((shift, zeros, Bits(bits)))
            symbols = symbols[np.argsort(bits, kind="stable")]
        self.first = self.descend(np.arange(largest + 1), np.zeros(largest + 1, np.int64))

    def descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for shift, zeros, bits in self.levels:
            ones = bits.ones(place)
            place = np.where(symbol >> shift & 1, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self.descend(symbol, place) - self.first[symbol]


class FMIndex:
    """Index over pieces of text; ``pieces`` are sequences of whole numbers from 1 on."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, width: int):
        n, self.width = len(symbols) + len(lengths), width
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = symbols
        self.text, self.ends, self.lengths = text, ends, lengths
        self.largest = int(symbols.max(initial=1))
        # The separators are 0 to the tree, but sort by place, so no two suffixes are equal.
        rank = np.where(inside, text + len(lengths), np.cumsum(~inside) - 1)
        self.suffixes, same = _sort_suffixes(rank, width)
        self.tree = WaveletTree(text[self.suffixes - 1], self.largest)
        counts = np.bincount(text, minlength=self.largest + 1)
        self.smaller = np.concatenate([[0], np.cumsum(counts)[:-1]])
        # Suffixes that agree on a whole window stand together: the interval of that window.
        self.group = np.cumsum(~same) - 1
        self.begin = np.flatnonzero(~same)
        self.end = np.append(self.begin[1:], n)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """One step of backward search: intervals of each symbol followed by each match."""
        base = self.smaller[symbol]
        return base + self.tree.rank(symbol, low), base + self.tree.rank(symbol, high)

    def windows(self, value: np.ndarray) -> np.ndarray:
        """The least value of the places where each window of the pieces occurs.

        ``value`` has a number per piece. Pieces are streamed from their last word to their
        first, all together, one step a word. A match of a whole window is widened to
        all suffixes that begin with it before the next step, so every later window costs one
        step; as the shard holds the pieces themselves, no step can fail.
        """
        of_piece = np.repeat(np.arange(len(self.lengths)), self.lengths + 1)
        least = np.minimum.reduceat(value[of_piece[self.suffixes]], self.begin)
        counts = self.lengths - self.width + 1
        out = np.empty(int(counts.sum()), np.int64)
        first = np.cumsum(counts) - counts
        order = np.argsort(-self.lengths, kind="stable")
        low = np.zeros(len(order), np.int64)
        high = np.full(len(order), len(self.text))
        for step in range(int(self.lengths.max(initial=0))):
            active = int(np.searchsorted(-self.lengths[order], -step, "left"))
            piece, low, high = order[:active], low[:active], high[:active]
            low, high = self.extend(self.text[self.ends[piece] - 1 - step], low, high)
            if step >= self.width - 1:
                group = self.group[low]
                low, high = self.begin[group], self.end[group]
                out[first[piece] + self.lengths[piece] - 1 - step] = least[group]
        return out


def _sort_suffixes(rank: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order by doubling, and for each whether it shares a window with the one before."""
    n, span, size = len(rank), None, 1
    while True:
        if 2 * size > width and span is None:
            span = (rank, size)
        order = np.argsort(rank, kind="stable")
        new = np.append(True, np.diff(rank[order]) != 0)
        if new.all():
            break
        shifted = np.append(rank[size:], np.zeros(min(size, n), np.int64))[:n]
        key = rank.astype(np.int64) * (n + 1) + shifted
        order = np.argsort(key, kind="stable")
        new = np.append(True, np.diff(key[order]) != 0)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        size *= 2
    if span is None:
        return order, np.zeros(n, bool)
    # Two suffixes share a window if its first and its last part agree.
    part, size = span
    later = np.append(part[width - size :], np.full(width - size, -1))[:n]
    same = (np.diff(part[order]) == 0) & (np.diff(later[order]) == 0) & (later[order][1:] >= 0)
    return order, np.append(False, same)


def least_documents(pieces: list[Sequence[bytes]], least: np.ndarray, unit: Unit) -> np.ndarray:
    known: dict[bytes, int] = {}
    symbols = [known.setdefault(word, len(known) + 1) for piece in pieces for word in piece]
    lengths = np.array([len(piece) for piece in pieces])
    return FMIndex(np.array(symbols, np.int64), lengths, unit.width).windows(least)


def remove_repeated_words(
    docs: DataFrame,
    width: int = 50,
    gram: int = GRAM,
    doc_id: str = "doc_id",
    text: str = "text",
    hot_chunks: int = HOT_CHUNKS,
    hot_runs: int = HOT_RUNS,
    place_bytes: int = PLACE_BYTES,
) -> DataFrame:
    """Remove words covered by ``width`` consecutive words that a smaller document also has.

    Words are runs of characters other than ASCII white space. See ``remove_repeats`` for the
    columns and for nulls; ``kept`` are the remaining words joined by one space.
    """
    return remove_repeats(
        docs, Unit(True, width, gram), least_documents, doc_id, text, hot_chunks, hot_runs, place_bytes
    )
