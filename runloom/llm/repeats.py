"""Passages that start in more than one document: routing of candidates to shards.

A *window* is ``width`` consecutive symbols (words or bytes) of one document. Every window has
an *anchor*: its least n-gram by hash, the leftmost on ties, so equal windows have equal anchors
at equal offsets. Consecutive windows with the same anchor occurrence are a *run*, some twenty
symbols apart; its *piece* is the text that its windows cover.

1. Tasks cut their documents into runs. Anchors go, packed, to buckets by hash, each with a code of
   what stands before it and after it. A window holds one of these two sides, so buckets tell the
   sides that lie in several documents from the others. Runs whose sides all lie in several
   documents of one chunk need no answer: one witness of them travels.
2. Documents meet the answers. Pieces, as far as windows with a shared side reach, go to shards by
   anchor. Of equal pieces in one group of documents only the one of the smallest document travels;
   in the others all of it is repeated, which is known there and then.
3. A shard joins equal pieces, leaves out pieces that share too little with any other, and indexes
   the rest, some anchors at a time: a function given by the operator returns the least document of
   every window.
4. Documents meet their spans.

An anchor with very many runs is *hot*: the contexts around its passage could fill a shard, so its
pieces travel as single windows, by the hash of the window; equal pieces and equal windows are
joined before. All this is exact: hashes only decide where things meet.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import durable, partitions, utf8

# Symbols that are cut into runs at a time; a position must fit into POSITION_BITS.
CHUNK = 1 << 22
STRETCH = 1 << 17
POSITION_BITS = 24
# An anchor is hot with so many runs, whatever the size of the input: with shorter pieces than two
# windows this bounds what one anchor brings to a shard.
HOT_RUNS = 1 << 15
# It is also hot if it lies in so many chunks and in so large a share of them.
HOT_CHUNKS = 1024
HOT_SHARE = 0.01
# Text that a bucket, a group of documents and a shard hold of the input, on average.
PLACE_BYTES = 32 << 20
# Values of the code of an anchor's side; 0 stands for no side.
SIDE_CODES = (1 << 16) - 1
LEFT, RIGHT = 1, 2
# Text that a shard indexes at a time; only one anchor's pieces may be more, and those are bounded.
INDEX_BYTES = 1 << 20

TAIL = np.uint64(0xFFFFFFFF)
U64 = np.uint64


@dataclass(frozen=True)
class Unit:
    """What documents are made of, and how long windows and anchors are."""

    words: bool
    width: int
    gram: int

    @property
    def reach(self) -> int:
        """Each window holds its anchor and at least so many symbols on one side of it."""
        return -(-(self.width - self.gram) // 2)

    def split(self, text: bytes) -> Sequence:
        return text.split() if self.words else text

    def join(self, part: Sequence) -> bytes:
        return b" ".join(part) if self.words else part

    def hashes(self, symbols: Sequence) -> np.ndarray:
        if not self.words:
            return np.frombuffer(symbols, np.uint8).astype(np.uint64)
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, symbols), np.uint64, len(symbols))


# --- blobs ------------------------------------------------------------------


def _flat(value: np.ndarray | list[bytes]) -> tuple:
    """Integers by place value, rising ones as their steps, and texts in one: these compress well."""
    if isinstance(value, list):
        return _flat(np.array(list(map(len, value)), np.uint32)), b"".join(value)
    rising = bool((value[1:] >= value[:-1]).all())
    if rising:
        value = np.concatenate([value[:1], np.diff(value)])
    size = value.dtype.itemsize
    planes = np.ascontiguousarray(value).view(np.uint8).reshape(len(value), size).T
    return value.dtype.str, rising, planes.tobytes()


def _unflat(flat: tuple) -> np.ndarray | list[bytes]:
    if len(flat) == 2:
        ends = np.cumsum(_unflat(flat[0]), dtype=np.int64).tolist()
        return [flat[1][begin:end] for begin, end in zip([0, *ends], ends)]
    kind, rising, data = flat
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(size, len(data) // size)
    value = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
    return np.cumsum(value, dtype=kind) if rising else value


def pack(*values: np.ndarray | list[bytes]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(
        pickle.dumps(tuple(map(_flat, values)), protocol=5)
    )


def unpack(blob: bytes) -> tuple:
    import zstandard

    return tuple(map(_unflat, pickle.loads(zstandard.ZstdDecompressor().decompress(blob))))


ROUTED = pa.schema([("place", pa.int32()), ("kind", pa.string()), ("blob", pa.binary())])
ROUTED_DDL = "place int, kind string, blob binary"


def _routed(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, ROUTED)], schema=ROUTED
    )


def slices(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of ``key`` with the places that hold it, in order."""
    order = np.argsort(key, kind="stable")
    if len(order):
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(order, cuts):
            yield int(key[part[0]]), part


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    return x


def group_of(doc_id: np.ndarray, version: np.ndarray, groups: int) -> np.ndarray:
    mixed = _mix(_mix(doc_id.astype(np.int64).view(U64)) + version.astype(np.int64).view(U64))
    return ((mixed >> U64(17)) % U64(groups)).astype(np.int64)


# --- anchors ----------------------------------------------------------------


def gram_hashes(symbols: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols from each place on, put together from parts of 1, 2, 4, ... symbols."""
    done, at, size, part = None, 0, 1, _mix(symbols + U64(1))
    while True:
        if n & size:
            tail = part[at:]
            if done is None:
                done = tail
            else:
                done = _mix(done[: len(tail)] * U64(0xC2B2AE3D27D4EB4F) + tail[: len(done)])
            at += size
        if size * 2 > n:
            return done
        part = _mix(part[:-size] * U64(0xC2B2AE3D27D4EB4F) + part[size:])
        size *= 2


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while 2 * size <= n:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[: len(values) - (n - size)], values[n - size :]) if size < n else values


@dataclass
class Runs:
    part: np.ndarray
    start: np.ndarray
    count: np.ndarray
    offset: np.ndarray
    key: np.ndarray
    left: np.ndarray
    right: np.ndarray


def _side(hashes: np.ndarray, place: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Code of the n-gram at each place, 0 where a run has no window that holds it."""
    code = _mix(hashes[np.where(there, place, 0)]) % U64(SIDE_CODES) + U64(1)
    return np.where(there, code, U64(0)).astype(np.uint16)


def cut_runs(symbols: np.ndarray, lengths: np.ndarray, unit: Unit) -> Runs | None:
    """Runs of parts that lie one after the other: their part, first window in it, number of
    windows, the anchor's offset in the first window, the anchor's hash, and codes of its sides:
    of the n-grams ``reach`` before it and after it."""
    windows = len(symbols) - unit.width + 1
    if windows < 1:
        return None
    ends = np.cumsum(lengths)
    valid = np.zeros(windows + 1, np.int8)
    # A window starts in a part and ends in it.
    begin, stop = (ends - lengths), np.maximum(ends - unit.width + 1, ends - lengths)
    np.add.at(valid, np.minimum(begin, windows), 1)
    np.add.at(valid, np.minimum(stop, windows), -1)
    valid = np.cumsum(valid, dtype=np.int8)[:-1].astype(bool)
    hashes = gram_hashes(symbols, unit.gram)
    low = U64((1 << POSITION_BITS) - 1)
    ranked = hashes & ~low
    ranked |= np.arange(len(hashes), dtype=U64)
    anchor = sliding_min(ranked, unit.width - unit.gram + 1)
    change = np.ones(windows + 1, bool)
    np.not_equal(anchor[1:], anchor[:-1], out=change[1:-1])
    change[1:-1] |= valid[1:] != valid[:-1]
    first = np.flatnonzero(change[:-1] & valid)
    if not len(first):
        return None
    last = np.flatnonzero(change[1:] & valid)
    place = (anchor[first] & low).astype(np.int64)
    part = np.searchsorted(ends, first, "right")
    left = _side(hashes, place - unit.reach, place - unit.reach >= first)
    right = _side(hashes, place + unit.reach, place + unit.reach + unit.gram <= last + unit.width)
    return Runs(part, first - begin[part], last - first + 1, place - first, hashes[place], left, right)


def _runs_of(lengths: np.ndarray, symbols: np.ndarray, unit: Unit) -> Runs | None:
    """``cut_runs`` over a few parts at a time, which fit into a processor's cache."""
    ends = np.cumsum(lengths)
    cuts = np.unique(np.searchsorted(ends, np.arange(STRETCH, ends[-1] + STRETCH, STRETCH)))
    found, at = [], 0
    for cut in cuts.tolist():
        upto = min(cut + 1, len(lengths))
        if upto > at:
            start = ends[at] - lengths[at]
            runs = cut_runs(symbols[start : ends[upto - 1]], lengths[at:upto], unit)
            if runs is not None:
                runs.part += at
                found.append(runs)
        at = max(at, upto)
    if not found:
        return None
    names = ("part", "start", "count", "offset", "key", "left", "right")
    return Runs(*(np.concatenate([getattr(r, name) for r in found]) for name in names))


def _chunks(batches: Iterator[pa.RecordBatch], unit: Unit):
    """(doc ids, versions, offsets, lengths, symbol hashes) of parts of documents, a chunk at a time.

    A document longer than a chunk is cut into parts that overlap by all but one of a window.
    """
    ids, versions, offsets, parts, size = [], [], [], [], 0
    for batch in batches:
        texts = utf8(batch.column(2))
        for doc_id, version, text in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts
        ):
            symbols = unit.hashes(unit.split(text))
            for at in range(0, max(len(symbols) - unit.width + 1, 0), CHUNK):
                part = symbols[at : at + CHUNK + unit.width - 1]
                ids.append(doc_id)
                versions.append(version)
                offsets.append(at)
                parts.append(part)
                size += len(part)
                if size >= CHUNK:
                    yield _arrays(ids, versions, offsets, parts)
                    ids, versions, offsets, parts, size = [], [], [], [], 0
    if parts:
        yield _arrays(ids, versions, offsets, parts)


def _arrays(ids, versions, offsets, parts):
    numbers = [np.array(x, np.int64) for x in (ids, versions, offsets)]
    return *numbers, np.array([len(p) for p in parts]), np.concatenate(parts)


def _several(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each place: whether its key lies in several documents."""
    order = np.lexsort((doc, key))
    starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    ends = np.append(starts[1:], len(order)) - 1
    shared = doc[order[starts]] < doc[order[ends]]
    out = np.empty(len(key), bool)
    out[order] = np.repeat(shared, ends - starts + 1)
    return out


def _settled(runs: Runs, doc: np.ndarray) -> np.ndarray:
    """Runs whose sides, or whose only side, lie in several documents."""
    at = np.flatnonzero(_several(runs.key, doc))
    if not len(at):
        return at
    settled = np.ones(len(at), bool)
    for side in (runs.left[at], runs.right[at]):
        # Sides that only look alike are sent in vain.
        settled &= (side == 0) | _several(_mix(runs.key[at]) + side.astype(U64), doc[at])
    return at[settled]


def _numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row among the distinct ones, and a place that holds each of these."""
    order = np.lexsort(columns)
    first = np.ones(len(order), bool)
    first[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(first) - 1
    return number, order[first]


def _find_anchors(unit: Unit, buckets: int, groups: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, version, offset, lengths, symbols in _chunks(batches, unit):
            runs = _runs_of(lengths, symbols, unit)
            if runs is None:
                continue
            bucket = ((runs.key >> U64(32)) % U64(buckets)).astype(np.int64)
            tail = (runs.key & TAIL).astype(np.uint32)
            start = (runs.start + offset[runs.part]).astype(np.int64)
            own = doc[runs.part]
            at, rows = _settled(runs, own), []
            asks = np.ones(len(own), bool)
            asks[at] = False
            asks = np.flatnonzero(asks)
            for place, which in slices(bucket[asks]):
                rows.append((place, "ask", _ask(runs, asks[which], doc, version, start, tail)))
            # One witness of alike runs, with their number and the groups that hold them.
            alike, first = _numbered(runs.right[at], runs.left[at], runs.key[at])
            witness, times = at[first], np.bincount(alike, minlength=len(first))
            holder, group = _holders(alike, group_of(own[at], version[runs.part][at], groups), groups)
            begin = np.searchsorted(holder, np.arange(len(first)), "left")
            held = np.searchsorted(holder, np.arange(len(first)), "right") - begin
            for place, which in slices(bucket[witness]):
                mine, many = witness[which], held[which]
                inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                holders = group[np.repeat(begin[which], many) + inside].astype(np.int32)
                blob = pack(own[mine], runs.left[mine], runs.right[mine], tail[mine],
                            times[which].astype(np.uint32), many.astype(np.uint32), holders)
                rows.append((place, "seen", blob))
            sides = LEFT * (runs.left[at] > 0) + RIGHT * (runs.right[at] > 0)
            rows += _hits(own[at], version[runs.part][at], start[at], runs.count[at],
                          runs.offset[at], sides, bucket[at], tail[at], groups)
            yield _routed(rows)

    return run


def _holders(key: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a key and a group, by key."""
    order = np.lexsort((group, key))
    key, group = key[order], group[order]
    first = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))[: len(key)]
    return key[first], group[first]


def _ask(runs: Runs, at, doc, version, start, tail) -> bytes:
    parts, inside = np.unique(runs.part[at], return_inverse=True)
    return pack(
        doc[parts], version[parts], inside.astype(np.uint32), start[at].astype(np.uint32 if start[at].max() < 1 << 32 else np.int64),
        runs.count[at].astype(np.uint8), runs.offset[at].astype(np.uint8), runs.left[at], runs.right[at], tail[at],
    )


def _hits(doc, version, start, count, offset, sides, bucket, tail, groups: int) -> list[tuple]:
    rows = []
    for group, at in slices(group_of(doc, version, groups)):
        blob = pack(doc[at], version[at], start[at], count[at].astype(np.uint8),
                    offset[at].astype(np.uint8), sides[at].astype(np.uint8),
                    bucket[at].astype(np.int32), tail[at])
        rows.append((group, "hit", blob))
    return rows


def _answer(groups: int, hot_chunks: int, hot_runs: int) -> Callable:
    """What one bucket knows: anchors with a side in several documents, and the hot ones among them.

    The groups that hold a hot anchor are told so, each one those that it holds.
    """

    def run(table: pa.Table) -> pa.Table:
        rows, asks, seen = [], [], []
        for place, kind, blob in zip(*(c.to_pylist() for c in table.columns)):
            if kind == "hit":
                rows.append((place, kind, blob))
            elif kind == "seen":
                seen.append(unpack(blob))
            else:
                asks.append(unpack(blob))
        if asks or seen:
            doc = np.concatenate([*(a[0][a[2]] for a in asks), *(w[0] for w in seen)])
            left, right, tail = (
                np.concatenate([*(a[k] for a in asks), *(w[k - 5] for w in seen)]) for k in (6, 7, 8)
            )
            asked = sum(len(a[2]) for a in asks)
            sides = np.zeros(len(doc), np.uint8)
            for flag, side in ((LEFT, left), (RIGHT, right)):
                code = tail.astype(np.int64) << 16 | side
                # A witness stands for several documents: it is enough to know of one other.
                shared = _several(code, doc) | np.isin(code, code[asked:])
                sides |= (flag * (shared & (side > 0))).astype(np.uint8)
            at = np.flatnonzero(sides[:asked])
            group = np.empty(0, np.int64)
            if len(at):
                version = np.concatenate([a[1][a[2]] for a in asks])[at]
                start, count, offset = (
                    np.concatenate([a[k].astype(np.int64) for a in asks])[at] for k in (3, 4, 5)
                )
                bucket = np.full(len(at), table.column(0)[0].as_py())
                group = group_of(doc[at], version, groups)
                rows += _hits(doc[at], version, start, count, offset, sides[at], bucket, tail[at], groups)
            chunk = np.repeat(
                np.arange(len(asks) + len(seen)),
                [len(a[2]) for a in asks] + [len(w[0]) for w in seen],
            )
            sent = np.append(at, np.arange(asked, len(doc)))
            pairs = np.unique(tail[sent].astype(np.int64) << 31 | chunk[sent]) >> 31
            values, counts = np.unique(pairs, return_counts=True)
            least = max(hot_chunks, HOT_SHARE * max(len(asks), len(seen)))
            times = np.concatenate([np.ones(len(at), np.int64), *(w[4] for w in seen)])
            _, of = np.unique(tail[sent], return_inverse=True)
            runs = np.bincount(of, times)
            hot = (counts >= least) | (runs >= hot_runs)
            if hot.any():
                held = np.concatenate([tail[at], *(np.repeat(w[3], w[5]) for w in seen)]).astype(np.int64)
                holder = np.concatenate([group, *(w[6] for w in seen)]).astype(np.int64)
                is_hot = np.isin(held, values[hot])
                own = table.column(0)[0].as_py()
                for group, at in slices(holder[is_hot]):
                    mark = own << 32 | np.unique(held[is_hot][at])
                    rows.append((group, "hot", pack(mark)))
        return pa.Table.from_batches([_routed(rows)])

    return run


# --- pieces -----------------------------------------------------------------


def _zip_texts(groups: int) -> Callable:
    """Documents by group, those of a batch packed for the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = np.array(batch.column(0).is_valid(), np.uint8)
            ids = np.array([i or 0 for i in batch.column(0).to_pylist()], np.int64)
            versions = np.array(batch.column(1).to_pylist(), np.int64)
            texts, rows = utf8(batch.column(2)), []
            for place, at in slices(group_of(ids, versions, groups)):
                head = pack(named[at], ids[at], versions[at])
                rows.append((place, head, pack([texts[k] for k in at.tolist()])))
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))],
                names=["place", "head", "texts"],
            )

    return run


def zipped(docs: DataFrame, groups: int) -> DataFrame:
    return docs.mapInArrow(_zip_texts(groups), "place int, head binary, texts binary")


def _headers(docs: pa.Table) -> dict[tuple, int]:
    """The rows of a group, without null ids, and which of the texts with its id each has, by version."""
    known: dict[int, set] = {}
    for head in docs.column("head").to_pylist():
        named, ids, versions = unpack(head)
        for doc_id, version in zip(ids[named > 0].tolist(), versions[named > 0].tolist()):
            known.setdefault(doc_id, set()).add(version)
    return {(d, v): k for d, versions in known.items() for k, v in enumerate(sorted(versions))}


def _unzip(docs: pa.Table) -> Iterator[tuple[int | None, int, bytes]]:
    """Id, version and text of the rows of a group."""
    for head, blob in zip(*(docs.column(name).to_pylist() for name in ("head", "texts"))):
        columns = [c.tolist() for c in unpack(head)]
        for there, doc_id, version, text in zip(*columns, *unpack(blob)):
            yield doc_id if there else None, version, text


def _spans(group, doc, copy, start, end) -> list[tuple]:
    """Spans by group; a group's documents are told apart by id and the number of the text with it."""
    rows = []
    for place, at in slices(np.asarray(group)):
        at = at[np.lexsort((start[at], copy[at], doc[at]))]
        rows.append((place, "span", pack(doc[at], copy[at], start[at], end[at])))
    return rows


def _cut_pieces(unit: Unit, groups: int, shards: int) -> Callable:
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        found, marks = [], [np.empty(0, np.int64)]
        for kind, blob in zip(told.column("kind").to_pylist(), told.column("blob").to_pylist()):
            (found if kind == "hit" else marks).append(unpack(blob) if kind == "hit" else unpack(blob)[0])
        if not len(docs) or not found:
            return pa.Table.from_batches([_routed([])])
        doc, version, start, count, offset, sides, bucket, tail = (
            np.concatenate([f[k].astype(np.int64) for f in found]) for k in range(8)
        )
        # Windows with the side that is shared, where only one is.
        skip = np.where(sides == RIGHT, np.maximum(offset + unit.gram + unit.reach - unit.width, 0), 0)
        count = np.where(sides == LEFT, np.minimum(count, offset - unit.reach + 1), count - skip)
        start, offset = start + skip, offset - skip
        order = np.lexsort((start, version, doc))
        same = (np.diff(doc[order]) == 0) & (np.diff(version[order]) == 0)
        by_doc = {
            (int(doc[p[0]]), int(version[p[0]])): p
            for p in np.split(order, np.flatnonzero(~same) + 1)
        }
        is_hot = np.isin(bucket << 32 | tail, np.concatenate(marks))
        # A piece's text says all about it: its windows, its anchor and where that is.
        first: dict[bytes, int] = {}
        source: list[tuple[int, int, int, int]] = []  # shard, tail, windows, offset of each
        piece_of: list[int] = []
        places: list[np.ndarray] = []  # of each document: its hits, in the order of piece_of
        hot_piece: list[bool] = []
        group, copies, copy = docs.column("place")[0].as_py(), _headers(docs), []
        for doc_id, own, text in _unzip(docs):
            at = by_doc.pop((doc_id, own), None)  # rows that repeat a document say nothing new
            if at is None:
                continue
            copy.append(np.full(len(at), copies[doc_id, own]))
            symbols = unit.split(text)
            places.append(at)
            begin = start[at]
            stop = begin + count[at] + (unit.width - 1)
            for k, s, e in zip(at.tolist(), begin.tolist(), stop.tolist()):
                piece = unit.join(symbols[s:e])
                number = first.setdefault(piece, len(source))
                if number == len(source):
                    source.append((int(bucket[k]), int(tail[k]), int(count[k]), int(offset[k])))
                    hot_piece.append(bool(is_hot[k]))
                piece_of.append(number)
        rows: list[tuple] = []
        if source:
            at = np.concatenate(places)
            where = np.column_stack([doc[at], np.concatenate(copy), start[at]])
            piece = np.array(piece_of, np.int64)
            about = np.array(source, np.int64)
            least = np.full(len(source), np.iinfo(np.int64).max)
            np.minimum.at(least, piece, where[:, 0])
            later = where[:, 0] > least[piece]
            if later.any():
                end = where[later, 2] + about[piece[later], 2] + unit.width - 1
                rows += _spans(np.full(len(end), group), *where[later].T, end)
            piece, where, texts = piece[~later], where[~later], list(first)
            loose = np.array(hot_piece)[piece]
            rows += _sent(texts, about, piece[~loose], where[~loose], group)
            if loose.any():
                windows, about, piece, where = _as_windows(
                    unit, shards, texts, about[:, 2], piece[loose], where[loose]
                )
                least = np.full(len(windows), np.iinfo(np.int64).max)
                np.minimum.at(least, piece, where[:, 0])
                later = where[:, 0] > least[piece]
                if later.any():
                    joined = _joined(where[later], unit.width)
                    rows += _spans(np.full(len(joined), group), *joined.T)
                rows += _sent(windows, about, piece[~later], where[~later], group)
        return pa.Table.from_batches([_routed(rows)])

    return run


def _sent(texts: list[bytes], about: np.ndarray, piece: np.ndarray, where: np.ndarray, group: int) -> list[tuple]:
    """Pieces by shard, each text once and those of an anchor together, with the places where they are."""
    rows = []
    for place, at in slices(about[piece, 0]):
        own, of = np.unique(piece[at], return_inverse=True)
        order = np.lexsort((about[own, 3], about[own, 1]))
        rank = np.argsort(order)[of]
        at = at[np.lexsort((where[at, 2], where[at, 0], rank))]
        own, times = own[order], np.bincount(rank)
        blob = pack(
            [texts[k] for k in own.tolist()],
            about[own, 1].astype(np.uint32),
            about[own, 2].astype(np.uint8),
            about[own, 3].astype(np.uint8),
            times.astype(np.uint32),
            np.array([group]),
            *np.ascontiguousarray(where[at].T),
        )
        rows.append((place, "piece", blob))
    return rows


def _as_windows(unit: Unit, shards: int, texts: list[bytes], counts, piece, where):
    """Pieces cut into windows: their texts, what is to know of each, and each one's places."""
    import xxhash

    first: dict[bytes, int] = {}
    own, of = np.unique(piece, return_inverse=True)
    numbers = []
    for k in own.tolist():
        symbols = unit.split(texts[k])
        for i in range(int(counts[k])):
            numbers.append(first.setdefault(unit.join(symbols[i : i + unit.width]), len(first)))
    codes = np.array([xxhash.xxh3_64_intdigest(window) for window in first], U64)
    about = np.ones((len(first), 4), np.int64)
    about[:, 0] = (codes >> U64(32)) % U64(shards)
    about[:, 1] = codes & TAIL
    about[:, 3] = 0
    times = counts[own]
    starts = (np.cumsum(times) - times)[of]
    row = np.repeat(np.arange(len(piece)), times[of])
    inside = np.arange(len(row)) - np.repeat(np.cumsum(times[of]) - times[of], times[of])
    where = where[row]
    where[:, 2] += inside
    return list(first), about, np.array(numbers, np.int64)[starts[row] + inside], where


def _joined(where: np.ndarray, width: int) -> np.ndarray:
    """Windows that start one after the other, as (document, copy, start, end) of each stretch."""
    where = where[np.lexsort(where.T[::-1])]
    cut = np.flatnonzero(np.any(np.diff(where, axis=0) != [0, 0, 1], axis=1)) + 1
    begin, last = np.append(0, cut), np.append(cut, len(where)) - 1
    return np.column_stack([where[begin], where[last, 2] + width])


# --- shards -----------------------------------------------------------------

# (pieces as sequences of symbols, least document of each piece, unit) -> least document of
# each window, the pieces' windows one after the other.
Index = Callable[[list[Sequence], np.ndarray, Unit], np.ndarray]


def _partners(pieces: list[Sequence], tails, counts, offsets, unit: Unit) -> list[int]:
    """Pieces that share an anchor and one side of it with another piece.

    A window holds ``reach`` symbols before or after its anchor, so pieces with an equal window
    are kept.
    """
    def sides(k: int):
        a, piece = int(offsets[k]), pieces[k]
        after = a + unit.gram + unit.reach
        if after <= len(piece):
            yield tails[k], 0, unit.join(piece[a:after])
        if a >= unit.reach:
            yield tails[k], 1, unit.join(piece[a - unit.reach : a + unit.gram])

    of = np.unique(tails, return_inverse=True)[1]
    several = np.flatnonzero(np.bincount(of)[of] > 1).tolist()
    seen: dict[tuple, int] = {}
    for k in several:
        for side in sides(k):
            seen[side] = seen.get(side, 0) + 1
    return [k for k in several if any(seen[side] > 1 for side in sides(k))]


def _by_anchor(tails: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces in parts of about ``INDEX_BYTES``, all those of an anchor in one: equal windows have one anchor."""
    order = np.argsort(tails, kind="stable")
    before = np.cumsum(size[order]) - size[order]
    first = np.append(True, tails[order][1:] != tails[order][:-1])
    # Every anchor belongs to the part in which its first piece begins.
    part = before[np.flatnonzero(first)][np.cumsum(first) - 1] // INDEX_BYTES
    yield from np.split(order, np.flatnonzero(np.diff(part)) + 1)


def _covered(lowest: np.ndarray, own: np.ndarray, least: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """(piece, begin, end) of the stretches of each piece whose windows a smaller document has."""
    covered = lowest < np.repeat(least, n)
    ends = np.cumsum(n)
    inside = np.arange(len(covered)) - np.repeat(ends - n, n)
    of = np.repeat(own, n)
    other = of[1:] != of[:-1]
    begin = covered & np.append(True, ~covered[:-1] | other)
    finish = covered & np.append(~covered[1:] | other, True)
    return np.column_stack([of[begin], inside[begin], inside[finish] + width])


def _search_shard(unit: Unit, groups: int, index: Index) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        rows, first = [], {}
        texts, tails, counts, offsets, places, holders = [], [], [], [], [], []
        for place, kind, blob in zip(*(c.to_pylist() for c in table.columns)):
            if kind == "span":
                rows.append((place, kind, blob))
                continue
            own, tail, count, offset, times, group, *where = unpack(blob)
            numbers = []
            for text, t, n, a in zip(own, tail.tolist(), count.tolist(), offset.tolist()):
                k = first.setdefault((t, n, text), len(texts))
                if k == len(texts):
                    texts.append(text)
                    tails.append(t)
                    counts.append(n)
                    offsets.append(a)
                numbers.append(k)
            places.append((np.repeat(numbers, times), np.column_stack(where)))
            holders.append(np.repeat(group, len(where[0])))
        if not texts:
            return pa.Table.from_batches([_routed(rows)])
        piece = np.concatenate([p for p, _ in places])
        where, group = np.concatenate([w for _, w in places]), np.concatenate(holders)
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, piece, where[:, 0])
        count = np.array(counts)
        later = where[:, 0] > least[piece]
        spans = [
            np.column_stack(
                [where[later], where[later, 2] + count[piece[later]] + unit.width - 1]
            )
        ]
        found = [np.empty((0, 3), np.int64)]
        tail, offset = np.array(tails), np.array(offsets)
        for at in _by_anchor(tail, np.array([len(text) for text in texts])):
            pieces = [unit.split(texts[k]) for k in at.tolist()]
            kept = _partners(pieces, tail[at], count[at], offset[at], unit)
            if kept:
                own = at[kept]
                lowest = index([pieces[k] for k in kept], least[own], unit)
                found.append(_covered(lowest, own, least[own], count[own], unit.width))
        part = np.concatenate(found)
        part = part[np.argsort(part[:, 0], kind="stable")]
        mine = np.flatnonzero(~later)
        starts = np.searchsorted(part[:, 0], piece[mine], "left")
        times = np.searchsorted(part[:, 0], piece[mine], "right") - starts
        row = np.repeat(mine, times)
        at = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        at += np.repeat(starts, times)
        spans.append(
            np.column_stack(
                [where[row, :2], where[row, 2] + part[at, 1], where[row, 2] + part[at, 2]]
            )
        )
        holder = np.concatenate([group[later], group[row]])
        rows += _spans(holder, *np.concatenate(spans).T)
        return pa.Table.from_batches([_routed(rows)])

    return run


# --- documents --------------------------------------------------------------


def _apply(unit: Unit) -> Callable:
    kept_type = pa.string() if unit.words else pa.binary()
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("version", pa.int64()),
            ("n", pa.int64()),
            ("n_removed", pa.int64()),
            ("n_spans", pa.int64()),
            ("kept", kept_type),
        ]
    )

    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        by_doc: dict[tuple, np.ndarray] = {}
        found = [unpack(b) for b in spans.column("blob").to_pylist()]
        if found:
            doc, copy, start, end = (np.concatenate([f[k] for f in found]) for k in range(4))
            order = np.lexsort((start, copy, doc))
            same = (np.diff(doc[order]) == 0) & (np.diff(copy[order]) == 0)
            for p in np.split(order, np.flatnonzero(~same) + 1):
                by_doc[int(doc[p[0]]), int(copy[p[0]])] = merge(start[p], end[p])
        rows, copies = [], _headers(docs)
        for doc_id, version, text in _unzip(docs):
            symbols, at, kept, removed = unit.split(text), 0, [], 0
            merged = by_doc.get((doc_id, copies.get((doc_id, version))), ())
            for start, end in merged:
                kept.append(symbols[at:start])
                removed += end - start
                at = end
            kept.append(symbols[at:])
            if unit.words:
                rest = b" ".join([word for part in kept for word in part]).decode()
            else:
                rest = b"".join(kept)
            rows.append((doc_id, version, len(symbols), removed, len(merged), rest))
        columns = list(zip(*rows)) or [()] * len(schema)
        return pa.Table.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
        )

    return run


def merge(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal spans of spans sorted by start; touching ones are one."""
    out: list[tuple[int, int]] = []
    for s, e in zip(start.tolist(), end.tolist()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def places_of(slim: DataFrame, place_bytes: int) -> int:
    """How many buckets, groups of documents and shards there are: enough for ``place_bytes`` of text each.

    At least as many as shuffle partitions, so that small inputs keep all tasks busy. What one place
    sends to another is one row a chunk, so places much smaller than a chunk would send single runs.
    """
    size = slim.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(partitions(slim), -(-size // place_bytes))


def remove_repeats(
    docs: DataFrame,
    unit: Unit,
    index: Index,
    doc_id: str = "doc_id",
    text: str = "text",
    hot_chunks: int = HOT_CHUNKS,
    hot_runs: int = HOT_RUNS,
    place_bytes: int = PLACE_BYTES,
) -> DataFrame:
    """(doc_id, version, n, n_removed, n_spans, kept) of every row.

    Removed are the symbols that a window covers which also starts in a document with a smaller
    id; ``kept`` is the rest. A null text is empty. A row with a null id neither removes anything
    nor loses anything. Rows that repeat an id do not act on each other; ``version``, a hash of
    the text, tells them apart. Other columns are not read.
    """
    slim = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("version"),
        F.col(text).cast("string").alias("text"),
    )
    places = places_of(slim, place_bytes)

    def placed(df: DataFrame) -> DataFrame:
        # One task for each place where there are more than the session's shuffles would make.
        return df.repartition(places, "place") if places > partitions(df) else df

    asked = slim.where("doc_id IS NOT NULL").mapInArrow(
        _find_anchors(unit, places, places), ROUTED_DDL
    )
    answer = _answer(places, hot_chunks, hot_runs)
    # Written, so that the questions' shuffle files can go before the documents meet the answers.
    answers = durable(placed(asked).groupBy("place").applyInArrow(answer, ROUTED_DDL))
    texts = placed(zipped(slim, places))
    pieces = (
        texts.groupBy("place")
        .cogroup(placed(answers).groupBy("place"))
        .applyInArrow(_cut_pieces(unit, places, places), ROUTED_DDL)
    )
    spans = placed(pieces).groupBy("place").applyInArrow(_search_shard(unit, places, index), ROUTED_DDL)
    kept = "string" if unit.words else "binary"
    return (
        texts.groupBy("place")
        .cogroup(placed(spans.select("place", "blob")).groupBy("place"))
        .applyInArrow(
            _apply(unit),
            f"doc_id long, version long, n long, n_removed long, n_spans long, kept {kept}",
        )
    )


def digest(kept: str) -> Column:
    return F.sha2(F.col(kept).cast("binary"), 256)
