"""Benchmark passages in documents, found by greedy string tiling."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

WORD = re.compile(r"[^\W_]+")
# Shortest tile in words, and the share of an item that tiles must cover.
SHORTEST = 5
COVERAGE = 0.8
# Bytes of benchmark text that travel to every task at a time; more are searched in turn.
BLOCK_BYTES = 4 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
MATCH = pa.struct(
    [
        ("item_id", pa.int64()),
        ("item_words", pa.int32()),
        ("covered", pa.int32()),
        ("tiles", pa.int32()),
    ]
)
MATCH_DDL = "array<struct<item_id:long,item_words:int,covered:int,tiles:int>>"


def word_codes(text: str) -> np.ndarray:
    """A 64-bit code of every word: runs of letters and digits, in lower case."""
    import xxhash

    words = WORD.findall(text.lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Rolling:
    """Karp-Rabin hashes of all stretches of a sequence, from running sums of one polynomial."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        sums = np.zeros(len(codes) + 1, np.uint64)
        # sums[k] / BASE^k would be the usual prefix value; with inverse powers it is one sum.
        sums[1:] = np.cumsum(codes * _powers(len(codes), INVERSE))
        self.sums = sums

    def stretches(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each place on."""
        n = len(self.codes) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        return (self.sums[size:] - self.sums[:n]) * _powers(n, BASE)


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        size = max(1 << 12, 1 << max(n - 1, 1).bit_length())
        known = np.ones(size, np.uint64)
        known[1:] = base
        known = np.multiply.accumulate(known)
        _POWERS[int(base)] = known
    return known[:n]


def greedy_tiles(item: np.ndarray, text: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Tiles (place in the item, place in the text, words), longest first.

    Again and again, the longest stretch that both have, outside earlier tiles, becomes a tile;
    ties go to the earliest in the text, then in the item. So passages count in any order.
    """
    one, two = Rolling(item), Rolling(text)
    free_one, free_two = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []

    def open_places(free: np.ndarray, size: int) -> np.ndarray:
        taken = np.concatenate([[0], np.cumsum(~free)])
        return np.flatnonzero(taken[size:] == taken[: len(free) - size + 1])

    def common(size: int):
        a, b = open_places(free_one, size), open_places(free_two, size)
        if not len(a) or not len(b):
            return a, b[:0], None, None
        ha, hb = one.stretches(size)[a], two.stretches(size)[b]
        return a, b[np.isin(hb, ha)], ha, two.stretches(size)

    longest = min(len(item), len(text))
    while longest >= shortest:
        low, high = shortest - 1, longest  # something is common at low, or low is too short
        while low < high:
            middle = (low + high + 1) // 2
            if len(common(middle)[1]):
                low = middle
            else:
                high = middle - 1
        size = low
        if size < shortest:
            break
        a, b, ha, hb = common(size)
        while len(b):
            at = int(b[0])
            for k in a[ha == hb[at]].tolist():
                if free_one[k : k + size].all() and (item[k : k + size] == text[at : at + size]).all():
                    tiles.append((k, at, size))
                    free_one[k : k + size] = False
                    free_two[at : at + size] = False
                    b = b[b >= at + size]
                    break
            else:
                b = b[1:] if at != b[-1] else b[:0]
                # No free place of the item is left for this stretch: neither for its copies.
                b = b[hb[b] != hb[at]]
        longest = size - 1
    return tiles


@dataclass
class Items:
    """Benchmark items as word codes, with the places of their shortest stretches by hash."""

    ids: list[int | None]
    codes: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: Sequence[tuple[int | None, str | None]], shortest: int) -> Items:
        found = [(item_id, word_codes(text or "")) for item_id, text in rows]
        found = [(item_id, codes) for item_id, codes in found if len(codes)]
        by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, (_, codes) in enumerate(found):
            size = min(shortest, len(codes))
            by_size.setdefault(size, []).append((Rolling(codes).stretches(size), k))
        seeds = {}
        for size, parts in by_size.items():
            hashes = np.concatenate([h for h, _ in parts])
            item = np.concatenate([np.full(len(h), k) for h, k in parts])
            place = np.concatenate([np.arange(len(h)) for h, _ in parts])
            order = np.argsort(hashes, kind="stable")
            seeds[size] = hashes[order], item[order], place[order]
        return cls([i for i, _ in found], [c for _, c in found], seeds)


def matches(text: str | None, items: Items, coverage: float, shortest: int = 0) -> list[tuple]:
    """(item id, words, covered words, tiles) of each item of which enough is covered.

    An item of fewer than ``shortest`` words only counts if it is the whole text.
    """
    codes = word_codes(text or "")
    out = []
    for size, (hashes, item, place) in items.seeds.items():
        if size < shortest and size != len(codes):
            continue
        grams = Rolling(codes).stretches(size)
        if not len(grams):
            continue
        low = np.searchsorted(hashes, grams, "left")
        hit = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == grams)
        if not len(hit):
            continue
        distinct, first = np.unique(low[hit], return_index=True)
        high = np.searchsorted(hashes, grams[hit[first]], "right")
        seed = np.concatenate([np.arange(a, b) for a, b in zip(distinct, high)])
        for k in np.unique(item[seed]).tolist():
            words = items.codes[k]
            reach = np.zeros(len(words) + 1, np.int64)
            np.add.at(reach, place[seed[item[seed] == k]], 1)
            np.add.at(reach, place[seed[item[seed] == k]] + size, -1)
            # Tiles lie within the stretches that share a seed.
            if np.count_nonzero(np.cumsum(reach)[:-1]) < coverage * len(words):
                continue
            near = np.isin(grams[hit], hashes[seed[item[seed] == k]])
            tiles = greedy_tiles(words, _around(codes, hit[near], size), size)
            covered = sum(n for *_, n in tiles)
            if covered >= coverage * len(words):
                out.append((items.ids[k], len(words), covered, len(tiles)))
    return sorted(out, key=lambda row: (row[0] is None, row[0] or 0))


def _around(codes: np.ndarray, hit: np.ndarray, size: int) -> np.ndarray:
    """The words inside shared seeds; stretches that do not touch are kept apart by a 0."""
    begin = hit[np.append(True, np.diff(hit) > size)]
    end = hit[np.append(np.diff(hit) > size, True)] + size
    parts = [x for a, b in zip(begin, end) for x in (codes[a:b], np.zeros(1, np.uint64))]
    return np.concatenate(parts)


def _match(items: Items, coverage: float, shortest: int) -> Callable:
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            found = [matches(text, items, coverage, shortest) for text in batch.to_pylist()]
            rows = [dict(zip(MATCH.names, m)) for one in found for m in one]
            ends = np.cumsum([0, *map(len, found)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows, MATCH))

    return run


def benchmark_blocks(
    benchmark: DataFrame, item_id: str = "item_id", text: str = "text", shortest: int = SHORTEST
) -> Iterator[Items]:
    """The benchmark in blocks of about ``BLOCK_BYTES`` of text, each fit to travel to all tasks."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        yield Items.of([(r[0], r[1]) for r in part.collect()], shortest)


def contaminations(items: Items, text: Column, coverage: float = COVERAGE, shortest: int = 0) -> Column:
    """array<struct(item_id, item_words, covered, tiles)>: the items that a whole text contains.

    An item counts if tiles of at least ``SHORTEST`` words (all of a shorter item's) cover
    ``coverage`` of its words; one of fewer than ``shortest`` words only as the whole text. Null texts,
    and items without words, match nothing.
    """
    found = F.arrow_udf(_match(items, coverage, shortest), MATCH_DDL, ArrowUDFType.SCALAR_ITER)
    return found.asNondeterministic()(text)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, item_words, covered, tiles): every document and item found in it.

    Documents are read once for each block of the benchmark and never move. Repeated rows of
    either table give repeated results; null ids are carried along.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for items in benchmark_blocks(benchmark):
        found = slim.select("doc_id", contaminations(items, F.col("text")).alias("found"))
        part = found.select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.*")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns.

    An item of fewer than ``SHORTEST`` words, which ``contaminated`` reports wherever it stands, takes
    out only documents that are nothing else: a common word is no leak.
    """
    for items in benchmark_blocks(benchmark):
        docs = docs.where(F.size(contaminations(items, F.col(text), shortest=SHORTEST)) == 0)
    return docs
