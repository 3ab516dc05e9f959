"""Byte passages that repeat: suffix arrays of shards by induced sorting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from runloom.llm.repeats import HOT_CHUNKS, HOT_RUNS, PLACE_BYTES, Unit, remove_repeats

GRAM = 16
# Buckets are worked off as a whole if they hold so many symbols on average.
BUCKET_MEAN = 64


def smaller_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S-type); the last one is."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int64)))
    # A suffix has the type of the next place at which neighbouring symbols differ.
    place = np.where(step != 0, np.arange(n - 1), n)
    place = np.minimum.accumulate(place[::-1])[::-1]
    types = np.ones(n, bool)
    known = place < n
    types[:-1][known] = step[place[known]] > 0
    return types


def _bounds(text: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(text, minlength=alphabet)
    ends = np.cumsum(counts)
    return ends - counts, ends


def _spread(symbols: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by symbol, each one's place within its symbol, and counts."""
    order = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols, minlength=alphabet)
    inside = np.arange(len(symbols)) - (np.cumsum(counts) - counts)[symbols[order]]
    return order, inside, counts


def _induce_by_bucket(text, smaller, seeds, alphabet) -> np.ndarray:
    """Induce the order of all suffixes from ``seeds``, whole stretches of a bucket at a time."""
    starts, ends = _bounds(text, alphabet)
    suffixes = np.full(len(text), -1, np.int64)
    order, inside, counts = _spread(text[seeds], alphabet)
    seed_starts = ends - counts
    suffixes[seed_starts[text[seeds][order]] + inside] = seeds[order]
    used = np.flatnonzero(ends > starts).tolist()
    heads, tails = starts.copy(), ends.copy()

    def larger(batch: np.ndarray) -> None:
        found = batch[batch > 0] - 1
        found = found[~smaller[found]]
        if len(found):
            symbols = text[found]
            order, inside, counts = _spread(symbols, alphabet)
            suffixes[heads[symbols[order]] + inside] = found[order]
            np.add(heads, counts, out=heads)

    for c in used:
        at = starts[c]
        while at < heads[c]:
            at, begin = heads[c], at
            larger(suffixes[begin:at])
        larger(suffixes[seed_starts[c] : ends[c]])

    def lesser(batch: np.ndarray) -> None:
        found = batch[batch > 0] - 1
        found = found[smaller[found]]
        if len(found):
            symbols = text[found]
            order, inside, counts = _spread(symbols, alphabet)
            suffixes[tails[symbols[order]] - 1 - inside] = found[order]
            np.subtract(tails, counts, out=tails)

    suffixes[0] = len(text) - 1
    tails[0] = 0
    for c in reversed(used):
        at = ends[c]
        while at > tails[c]:
            at, end = tails[c], at
            lesser(suffixes[at:end][::-1])
        lesser(suffixes[starts[c] : heads[c]][::-1])
    return suffixes


def _induce_by_suffix(text, smaller, seeds, alphabet) -> np.ndarray:
    """The same, suffix by suffix: for alphabets about as large as the text."""
    starts, ends = _bounds(text, alphabet)
    order, inside, counts = _spread(text[seeds], alphabet)
    suffixes = np.full(len(text), -1, np.int64)
    suffixes[(ends - counts)[text[seeds][order]] + inside] = seeds[order]
    out, symbols, types = suffixes.tolist(), text.tolist(), smaller.tolist()
    heads, tails = starts.tolist(), ends.tolist()
    for at in range(len(out)):
        j = out[at] - 1
        if j >= 0 and not types[j]:
            c = symbols[j]
            out[heads[c]] = j
            heads[c] += 1
    for at in range(len(out) - 1, -1, -1):
        j = out[at] - 1
        if j >= 0 and types[j]:
            c = symbols[j]
            tails[c] -= 1
            out[tails[c]] = j
    out[0] = len(out) - 1
    return np.array(out, np.int64)


def suffix_array(text: np.ndarray, alphabet: int) -> np.ndarray:
    """All suffixes in order. The last symbol is 0 and stands nowhere else."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    induce = _induce_by_bucket if n >= BUCKET_MEAN * alphabet else _induce_by_suffix
    smaller = smaller_types(text)
    leftmost = np.append(False, smaller[1:] & ~smaller[:-1])
    seeds = np.flatnonzero(leftmost)
    # Inducing from the unsorted leftmost-smaller places sorts the substrings between them.
    suffixes = induce(text, smaller, seeds, alphabet)
    ordered = suffixes[leftmost[suffixes]]
    number = np.cumsum(leftmost) - 1
    end = np.append(seeds[1:], n - 1)[number[ordered]]
    names = np.cumsum(np.append(True, _differ(text, ordered, end)))
    if names[-1] < len(seeds):
        reduced = np.empty(len(seeds), np.int64)
        reduced[number[ordered]] = names - 1
        ordered = seeds[suffix_array(reduced, int(names[-1]))]
    return induce(text, smaller, ordered, alphabet)


def _differ(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each substring (both ends included) differs from the one before it."""
    one, two = begin[:-1], begin[1:]
    size = end - begin
    differ = size[:-1] != size[1:]
    left = np.flatnonzero(~differ)
    step = 0
    while len(left):
        unequal = text[one[left] + step] != text[two[left] + step]
        differ[left[unequal]] = True
        left = left[~unequal & (size[1:][left] > step)]
        step += 1
    return differ


def permuted_prefixes(data: np.ndarray, suffixes: np.ndarray, most: int) -> np.ndarray:
    """For each place of ``data`` in text order: what its suffix shares with the one before it
    in suffix order, counted up to ``most`` bytes, eight at a time."""
    n = len(data)
    before = np.empty(n, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    before[suffixes[0]] = n  # nothing before: compared with the padding
    padded = np.concatenate([data.astype(np.uint8), np.zeros(most + 16, np.uint8)])
    eight = np.zeros(n + most + 8, "<u8")
    for k in range(8):
        eight |= padded[k : k + len(eight)].astype("<u8") << np.uint64(8 * k)
    shared = np.zeros(n, np.int64)
    left = np.flatnonzero(before < n)
    for step in range(0, most, 8):
        other = eight[left + step] ^ eight[before[left] + step]
        low = other & (~other + np.uint64(1))
        shared[left] = step + np.where(other == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        left = left[other == 0]
    return np.minimum(shared, most)


def least_documents(pieces: list[Sequence], least: np.ndarray, unit: Unit) -> np.ndarray:
    """The least document of every window of the pieces, from the shard's suffix array."""
    lengths = np.array([len(piece) for piece in pieces])
    ends = np.cumsum(lengths + 1) - 1
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    between = np.zeros(len(data), bool)
    between[ends] = True
    # 0 closes the text, 1 separates pieces; a byte is its own value and 2.
    text = np.append(np.where(between, 1, data.astype(np.int64) + 2), 0)
    suffixes = suffix_array(text, 258)[1:]
    # A window lies within its piece, so a byte that only looks like a separator is told apart.
    shared = permuted_prefixes(data, suffixes, unit.width)
    room = np.repeat(ends, lengths + 1) - np.arange(len(data))
    alike = (shared >= unit.width)[suffixes] & (room[suffixes] >= unit.width)
    alike &= np.append(False, room[suffixes][:-1] >= unit.width)
    group = np.cumsum(~alike) - 1
    of_piece = np.repeat(np.arange(len(pieces)), lengths + 1)
    lowest = np.minimum.reduceat(least[of_piece[suffixes]], np.flatnonzero(~alike))
    out = np.empty(len(data), np.int64)
    out[suffixes] = lowest[group]
    return out[room >= unit.width]


def remove_repeated_bytes(
    docs: DataFrame,
    width: int = 50,
    gram: int = GRAM,
    doc_id: str = "doc_id",
    text: str = "text",
    hot_chunks: int = HOT_CHUNKS,
    hot_runs: int = HOT_RUNS,
    place_bytes: int = PLACE_BYTES,
) -> DataFrame:
    """Remove UTF-8 bytes covered by ``width`` bytes that a smaller document also has.

    See ``remove_repeats`` for the columns and for nulls; ``kept`` is binary, as a cut may fall
    inside a character.
    """
    return remove_repeats(
        docs, Unit(False, width, gram), least_documents, doc_id, text, hot_chunks, hot_runs, place_bytes
    )
