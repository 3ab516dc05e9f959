from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from runloom.llm import fm_index, repeats, suffix_array
from runloom.llm.repeats import Unit
from tests.llm.brute import without_repeats
from tests.llm.helpers import documents, text


def mixed(by_words: bool, seed: int) -> list[tuple]:
    draw = random.Random(seed)
    passages = [text(draw.randint(20, 90), 1000 + k) for k in range(6)]
    rows = []
    for k in range(60):
        parts = [text(draw.randint(0, 60), seed * 100 + k)]
        for _ in range(draw.randrange(3)):
            parts += [draw.choice(passages), text(draw.randint(0, 30), seed * 200 + k)]
        rows.append((draw.randrange(1000), " ".join(parts)))
    copy = rows[3][1]
    edited = copy.replace("w1", "W", 1)
    rows += [(5000, copy), (5001, copy), (5001, copy), (5001, copy + " more"), (4, copy), (6000, edited)]
    rows += [(7000, None), (7001, ""), (7002, " \t\n "), (None, copy), (None, None), (7003, "word")]
    rows += [(8000, "ab " * 400), (8001, "ab " * 300), (8002, "é" * 60), (8003, "x" + "é" * 60), (8004, passages[0])]
    rows += [(8005, " ".join(passages)), (8006, text(9000, 77)), (8007, " ".join(text(9000, 77).split()[4000:4100]))]
    return rows


def check(spark, rows, by_words: bool, operator, **options):
    got = operator(documents(spark, rows), **options).select("doc_id", "n", "n_removed", "n_spans", "kept")
    got = [(*r[:4], bytes(r[4]) if not by_words else r[4]) for r in got.collect()]
    want = without_repeats(rows, by_words, options.get("width", 50))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return sum(r[2] for r in want)


OPERATORS = [(True, fm_index.remove_repeated_words), (False, suffix_array.remove_repeated_bytes)]


@pytest.mark.parametrize("by_words,operator", OPERATORS)
def test_equals_brute_force(spark, by_words, operator):
    assert check(spark, mixed(by_words, 1), by_words, operator) > 1000


@pytest.mark.parametrize("by_words,operator", OPERATORS)
def test_small_chunks_and_hot_anchors(spark, by_words, operator, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 300)
    monkeypatch.setattr(repeats, "HOT_SHARE", 0.0)
    assert check(spark, mixed(by_words, 2), by_words, operator, hot_chunks=3) > 1000


@pytest.mark.parametrize("by_words,operator", OPERATORS)
def test_other_widths(spark, by_words, operator):
    check(spark, mixed(by_words, 3), by_words, operator, width=9, gram=4)


@pytest.mark.parametrize("by_words,operator", OPERATORS)
def test_no_rows_and_no_windows(spark, by_words, operator):
    check(spark, [], by_words, operator)
    check(spark, [(1, "a b"), (2, "a b"), (2, "a b"), (None, None)], by_words, operator)


def brute_least(pieces, least, width):
    known: dict = {}
    for piece, value in zip(pieces, least):
        for k in range(len(piece) - width + 1):
            window = tuple(piece[k : k + width])
            known[window] = min(value, known.get(window, value))
    return [known[tuple(p[k : k + width])] for p in pieces for k in range(len(p) - width + 1)]


def test_indexes_equal_brute_force():
    draw = random.Random(4)
    for _ in range(150):
        width, letters = draw.choice([1, 2, 3, 8, 50]), [0, 1, 65, 66][: draw.choice([1, 2, 4])]
        pieces = [bytes(draw.choices(letters, k=draw.randint(width, width + 20))) for _ in range(draw.randint(1, 12))]
        least = np.array([draw.randint(0, 8) for _ in pieces])
        want = brute_least(pieces, least.tolist(), width)
        assert suffix_array.least_documents(pieces, least, Unit(False, width, 1)).tolist() == want
        as_words = [[bytes([65 + x]) for x in p] for p in pieces]
        assert fm_index.least_documents(as_words, least, Unit(True, width, 1)).tolist() == want


@pytest.mark.parametrize("mean", [1, 64, 1 << 60])
def test_suffix_array_by_both_ways_of_inducing(mean, monkeypatch):
    monkeypatch.setattr(suffix_array, "BUCKET_MEAN", mean)
    draw = random.Random(mean)
    for _ in range(150):
        letters = draw.choice([1, 2, 3, 20, 250])
        body = [draw.randint(1, letters) for _ in range(draw.randint(0, 150))] + [0]
        got = suffix_array.suffix_array(np.array(body), letters + 1)
        assert got.tolist() == sorted(range(len(body)), key=lambda k: body[k:])


def test_wavelet_tree_counts_symbols():
    draw = np.random.default_rng(2)
    symbols = draw.integers(0, 37, 1000)
    tree = fm_index.WaveletTree(symbols, 40)
    symbol, place = draw.integers(0, 41, 300), draw.integers(0, 1001, 300)
    assert tree.rank(symbol, place).tolist() == [int((symbols[:p] == s).sum()) for s, p in zip(symbol, place)]


def test_equal_windows_have_equal_anchors():
    unit, draw = Unit(True, 12, 3), np.random.default_rng(3)
    shared = draw.integers(0, 50, 30).astype(np.uint64)
    parts = [np.concatenate([draw.integers(0, 50, n).astype(np.uint64), shared]) for n in (0, 5, 17)]
    runs = repeats.cut_runs(np.concatenate(parts), np.array(list(map(len, parts))), unit)
    anchors = [{} for _ in parts]
    for part, start, count, offset, key in zip(runs.part, runs.start, runs.count, runs.offset, runs.key):
        for k in range(count):
            window = tuple(parts[part][start + k : start + k + 12].tolist())
            anchors[part][window] = (int(key), int(offset) - k)
    common = set(anchors[0]) & set(anchors[1]) & set(anchors[2])
    assert len(common) >= 19 and all(anchors[0][w] == anchors[1][w] == anchors[2][w] for w in common)
    assert [len(a) for a in anchors] == [19, 24, 36]


def test_runs_give_every_window_its_anchor(monkeypatch):
    draw = np.random.default_rng(1)
    for _ in range(150):
        width = int(draw.integers(2, 14))
        unit = Unit(True, width, int(draw.integers(1, width + 1)))
        parts = [draw.integers(0, draw.integers(1, 40), int(n)).astype(np.uint64) for n in draw.integers(0, 60, 6)]
        monkeypatch.setattr(repeats, "STRETCH", int(draw.integers(5, 200)))
        runs = repeats._runs_of(np.array([len(p) for p in parts]), np.concatenate(parts), unit)
        got: dict = {}
        for part, start, count, offset, key in zip(*(getattr(runs, n) for n in ("part", "start", "count", "offset", "key"))) if runs else ():
            for k in range(count):
                assert got.setdefault((int(part), int(start + k)), (int(key), int(start + offset))) is not None
        want = {}
        for number, part in enumerate(parts):
            if len(part) >= width:
                hashes = repeats.gram_hashes(part, unit.gram)
                for at in range(len(part) - width + 1):
                    places = range(at, at + width - unit.gram + 1)
                    _, place = min((int(hashes[j]) >> repeats.POSITION_BITS, j) for j in places)
                    want[number, at] = (int(hashes[place]), place)
        assert got == want


@pytest.mark.parametrize("by_words,operator", OPERATORS)
def test_anchors_hot_by_their_runs(spark, by_words, operator):
    for hot_runs in (2, 5):
        assert check(spark, mixed(by_words, 5), by_words, operator, hot_runs=hot_runs) > 1000


@pytest.mark.parametrize("by_words,operator", OPERATORS)
def test_places_follow_the_bytes_of_the_input(spark, by_words, operator, monkeypatch):
    """Many small places, and anchors settled in a chunk that are hot only over all chunks."""
    rows = mixed(by_words, 6)
    slim = documents(spark, rows).select("text")
    size = sum(len((r[1] or "").encode()) for r in rows)
    least = repeats.partitions(slim)
    assert repeats.places_of(slim, 1 << 40) == least == repeats.places_of(slim.limit(0), 1)
    assert repeats.places_of(slim, size // 40) in (40, 41)
    monkeypatch.setattr(repeats, "CHUNK", 2000)
    assert check(spark, rows, by_words, operator, place_bytes=size // 40, hot_runs=4) > 1000


def test_groups_that_hold_a_hot_anchor_are_told(monkeypatch):
    """Settled in a chunk or asked about: each hit of a hot anchor meets its mark, and no others do."""
    import pyarrow as pa

    monkeypatch.setattr(repeats, "CHUNK", 700)
    unit, passage = Unit(True, 50, 8), text(60, 9)
    docs = [(k, 0, f"{text(20, 10 * k)} {passage if k % 3 else text(60, k)} {text(20, 10 * k + 1)}") for k in range(90)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*docs)], names=["doc_id", "version", "text"])

    def rows_of(found):
        return list(zip(*(c.to_pylist() for c in found.columns)))

    asked = [r for b in repeats._find_anchors(unit, 3, 5)(iter([batch])) for r in rows_of(b)]
    said = []
    for bucket in range(5):
        mine = [r for r in asked if r[0] == bucket]
        if mine:
            said += rows_of(repeats._answer(5, repeats.HOT_CHUNKS, 40)(pa.Table.from_batches([repeats._routed(mine)])))
    marks = {(g, int(m)) for g, kind, blob in said if kind == "hot" for m in repeats.unpack(blob)[0]}
    hits: dict = {}
    for group, kind, blob in said:
        if kind == "hit":
            *_, bucket, tail = repeats.unpack(blob)
            for b, t in zip(bucket.tolist(), tail.tolist()):
                hits.setdefault(b << 32 | t, []).append(group)
    hot = {key for key, groups in hits.items() if len(groups) >= 40}
    assert hot and marks == {(g, key) for key in hot for g in hits[key]}


@pytest.mark.parametrize("by_words", [True, False])
def test_a_passage_of_many_documents_does_not_fill_a_shard(by_words):
    """One chunk of input: each shard gets few symbols besides single windows."""
    import pyarrow as pa

    unit, passage = Unit(by_words, 50, 8), text(60, 9)
    docs = [(k, 0, f"{text(20, 10 * k)} {passage} {text(20, 10 * k + 1)}") for k in range(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*docs)], names=["doc_id", "version", "text"])

    def table(rows, *kinds):
        return pa.Table.from_batches([repeats._routed([r for r in rows if r[1] in kinds])])

    def rows_of(found):
        return list(zip(*(c.to_pylist() for c in found.columns)))

    asked = [r for b in repeats._find_anchors(unit, 1, 1)(iter([batch])) for r in rows_of(b)]
    said = rows_of(repeats._answer(1, repeats.HOT_CHUNKS, 1 << 12)(table(asked, "ask", "seen", "hit")))
    assert any(kind == "hot" for _, kind, _ in said)
    texts = pa.Table.from_batches(list(repeats._zip_texts(1)(iter([batch]))))
    cut = rows_of(repeats._cut_pieces(unit, 1, 1)(texts, table(said, "hit", "hot")))
    by_tail: dict = {}
    for _, kind, blob in cut:
        if kind == "piece":
            own, tails, *_ = repeats.unpack(blob)
            for tail in tails.tolist():
                by_tail[tail] = by_tail.get(tail, 0) + 1
    assert max(by_tail.values()) < 1 << 12


def in_one_place(rows: list[tuple], unit: Unit, index) -> list[tuple]:
    """The steps of ``remove_repeats`` in this process, with a single place."""
    docs = [(d, k, t) for k, (d, t) in enumerate(rows)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*docs), (pa.int64(), pa.int64(), pa.string()))],
        names=["doc_id", "version", "text"],
    )
    asked = pa.Table.from_batches(repeats._find_anchors(unit, 1, 1)(iter([batch])))
    told = repeats._answer(1, 1024, 1 << 15)(asked)
    texts = pa.Table.from_batches(repeats._zip_texts(1)(iter([batch])))
    spans = repeats._search_shard(unit, 1, index)(repeats._cut_pieces(unit, 1, 1)(texts, told))
    kept = repeats._apply(unit)(texts, spans)
    return list(zip(*(kept.column(k).to_pylist() for k in (0, 2, 3, 4, 5))))


@pytest.mark.parametrize("most", [1, 700, 1 << 20])
@pytest.mark.parametrize("by_words,index", [(True, fm_index.least_documents), (False, suffix_array.least_documents)])
def test_shards_are_indexed_in_parts(by_words, index, most, monkeypatch):
    monkeypatch.setattr(repeats, "INDEX_BYTES", most)
    parts: list[int] = []

    def counted(pieces, least, unit):
        parts.append(sum(map(len, pieces)))
        return index(pieces, least, unit)

    # Without nulls and repeated ids: those are settled before and after.
    rows = list({d: (d, t) for d, t in mixed(by_words, 6) if d is not None and t is not None}.values())
    got = in_one_place(rows, Unit(by_words, 50, 8 if by_words else 16), counted)
    assert sorted(got) == sorted(without_repeats(rows, by_words, 50))
    assert len(parts) == 1 if most == 1 << 20 else len(parts) > 5


def test_parts_hold_whole_anchors():
    draw = np.random.default_rng(8)
    for _ in range(50):
        tails = draw.integers(0, 30, int(draw.integers(1, 400)))
        size = draw.integers(1, 300_000, len(tails))
        parts = list(repeats._by_anchor(tails, size))
        assert sorted(np.concatenate(parts).tolist()) == list(range(len(tails)))
        held = [set(tails[p].tolist()) for p in parts]
        assert sum(map(len, held)) == len(set(tails.tolist()))
        most = max(size[tails == t].sum() for t in tails)
        assert max(size[p].sum() for p in parts) < repeats.INDEX_BYTES + most


def steps(rows: list[tuple], unit: Unit) -> tuple[list, list]:
    """What the buckets tell and the pieces that the documents send, with a single place."""
    docs = [(d, k, t) for k, (d, t) in enumerate(rows)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*docs)], names=["doc_id", "version", "text"])
    asked = pa.Table.from_batches(repeats._find_anchors(unit, 1, 1)(iter([batch])))
    told = repeats._answer(1, 1024, 1 << 15)(asked)
    texts = pa.Table.from_batches(repeats._zip_texts(1)(iter([batch])))
    sent = repeats._cut_pieces(unit, 1, 1)(texts, told)
    return tuple(list(zip(*(c.to_pylist() for c in t.columns))) for t in (told, sent))


@pytest.mark.parametrize("chunk", [1 << 22, 300])
@pytest.mark.parametrize("by_words", [True, False])
def test_anchors_without_a_shared_side_do_not_travel(by_words, chunk, monkeypatch):
    """Documents that have an n-gram in common, and nothing more, send no text."""
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    unit, draw = Unit(by_words, 50, 8 if by_words else 16), random.Random(7)
    rows = []
    for k in range(120):
        gram = text(8, k) if by_words else "".join(draw.choices("abcdefgh", k=16))
        for _ in range(2):
            sides = [text(60, draw.random(), 10**6) for _ in range(2)]
            rows.append((len(rows), f" {gram} ".join(sides) if by_words else gram.join(sides)))
    told, sent = steps(rows, unit)
    assert not sent and not any(kind == "hit" and len(repeats.unpack(b)[0]) for _, kind, b in told)


@pytest.mark.parametrize("by_words", [True, False])
def test_only_windows_with_a_shared_side_travel(by_words):
    """Less than a window is shared: each window that is sent has, besides its anchor, an end of a side in two documents."""
    unit, draw = Unit(by_words, 50, 8 if by_words else 16), random.Random(8)
    rows = []
    for _ in range(60):
        passage = text(49, draw.random(), 10**6)
        for _ in range(2):
            sides = [text(60, draw.random(), 10**6) for _ in range(2)]
            rows.append((len(rows), f" {passage} ".join(sides) if by_words else passage[:49].join(sides)))
    _, sent = steps(rows, unit)
    windows = 0
    for _, kind, blob in sent:
        if kind == "piece":
            texts, _, counts, offsets, *_ = repeats.unpack(blob)
            for piece, count, offset in zip(texts, counts.tolist(), offsets.tolist()):
                symbols, ends = unit.split(piece), []
                assert len(symbols) == count + unit.width - 1
                if offset >= count - 1 + unit.reach:  # every window holds the left side
                    ends.append(offset - unit.reach)
                if offset + unit.reach + unit.gram <= unit.width:
                    ends.append(offset + unit.reach)
                ends = [unit.join(symbols[e : e + unit.gram]).decode() for e in ends]
                assert len(ends) == 0 or any(sum(e in t for _, t in rows) > 1 for e in ends)
                windows += count if ends else 0
    assert windows > 100


def test_blobs_give_back_what_they_hold():
    draw = np.random.default_rng(5)
    for kind in (np.uint8, np.uint16, np.int32, np.uint32, np.int64):
        low, high = np.iinfo(kind).min, np.iinfo(kind).max
        for size in (0, 1, 2, 1000):
            values = draw.integers(low, high, size, kind, endpoint=True)
            for array in (values, np.sort(values)):
                texts = [bytes([k % 256]) * (k % 7) for k in range(size)]
                back, again = repeats.unpack(repeats.pack(array, texts))
                assert back.dtype == kind and back.tolist() == array.tolist() and again == texts
