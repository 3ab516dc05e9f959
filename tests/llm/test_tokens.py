from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from runloom.llm import packing, token_file
from runloom.llm.tokens import WordEncoder
from tests.llm.helpers import documents, rows, text, tokenizer_path

ODD = [
    "", "  \t\n", "it's we'll don'T.", "İstanbul ŒUVRE ß ẞ ﬁ", "áb é.e é.", "x<|endoftext|>y <|ENDOFTEXT|>",
    "naïve...!? (x) 12a ª º µ ŉ", "a b c \x1c d\x85e", "日本語 テスト。 한국어", "word.word, a.b.", "x" * 5000,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def as_bytes(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def test_words_encode_like_whole_texts(library):
    encoder, draw = WordEncoder(tokenizer_path()), random.Random(0)
    for value in ODD + ["".join(draw.choices("aAzZéÉßıİ .,;:!?'<>|0129ª́ñÑ\n", k=draw.randrange(25))) for _ in range(2000)]:
        assert encoder.encode(value.encode()) == as_bytes(library(value)), repr(value)


def test_a_full_cache_starts_anew(library, monkeypatch):
    from runloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_BYTES", 2000)
    encoder = WordEncoder(tokenizer_path())
    for k in range(50):
        assert encoder.encode(text(30, k).encode()) == as_bytes(library(text(30, k)))
    assert encoder.bytes < 10_000


CASES = [(k, t) for k, t in enumerate(ODD)] + [(100, None), (7, "again"), (7, "again"), (None, "no id"), (-5, text(9000, 1))]


def test_token_files(spark, library):
    df = documents(spark, CASES)
    manifest = token_file.write_token_files(df, tokenizer_path(), 2)
    got = [tuple(r) for r in token_file.read_digests(manifest).orderBy("start").collect()]
    order = sorted(CASES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for doc_id, value in order:
        ids = [*library(value), 2]
        want.append((doc_id, start, len(ids), zlib.crc32(as_bytes(ids))))
        start += len(ids)
    assert got == want
    assert token_file.read_digests(token_file.write_token_files(documents(spark, []), tokenizer_path(), 2)).count() == 0


@pytest.mark.parametrize("limits,least", [({"file_documents": 3}, 5), ({"file_bytes": 400}, 3), ({}, 1)])
def test_files_are_bounded(spark, limits, least):
    df = documents(spark, CASES)
    manifest = token_file.write_token_files(df, tokenizer_path(), 2, **limits)
    files = manifest.orderBy("shard", "number").collect()
    assert len(files) >= least and sum(f["documents"] for f in files) == len(CASES)
    assert all(f["documents"] <= limits.get("file_documents", 1 << 18) for f in files)
    assert len({f["path"] for f in files}) == len(files)
    whole = token_file.read_digests(token_file.write_token_files(df, tokenizer_path(), 2))
    assert rows(token_file.read_digests(manifest), *whole.columns) == rows(whole, *whole.columns)


def test_file_gives_single_documents_and_notices_damage(tmp_path, monkeypatch):
    import zstandard

    monkeypatch.setattr(token_file, "FRAME_IDS", 10)
    path = str(tmp_path / "ids.zst")
    writer = token_file.Writer(path)
    contents = [(5, as_bytes(range(n))) for n in (1, 10, 35, 0, 11)] + [(None, as_bytes([9]))]
    for doc_id, ids in contents:
        writer.add(doc_id, ids)
    writer.close()
    reader, opened = token_file.Reader(path), []
    monkeypatch.setattr(reader, "_at", lambda at, n, get=reader._at: opened.append(at) or get(at, n))
    assert reader.read(2) == contents[2][1] and len(opened) == 4
    assert [reader.read(k) for k in range(6)] == [ids for _, ids in contents]
    assert reader.doc_ids == [5, 5, 5, 5, 5, None] and reader.counts.tolist() == [1, 10, 35, 0, 11, 1]
    data = (tmp_path / "ids.zst").read_bytes()
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain == b"".join(ids for _, ids in contents)
    damaged = bytearray(data)
    damaged[len(data) - 9 - 12 * len(reader.table) + 8] ^= 1  # the checksum of the first frame
    (tmp_path / "bad.zst").write_bytes(damaged)
    bad = token_file.Reader(str(tmp_path / "bad.zst"))
    assert bad.read(1) == contents[1][1]
    with pytest.raises(ValueError):
        bad.read(0)


@pytest.mark.parametrize("capacity,windows", [(64, 4), (2048, 64), (1, 1)])
def test_packing_is_whole_and_full(spark, library, capacity, windows):
    cases = CASES if capacity > 1 else CASES[:3]
    if capacity == 64:
        cases = cases + [(1000 + k, text(k % 40, k)) for k in range(300)]
    df = documents(spark, cases).repartition(5)
    pieces = packing.pack_documents(df, tokenizer_path(), 1, capacity, windows).collect()
    by_doc: dict = {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], bytes(p["ids"])))
    want: dict = {}
    for doc_id, value in cases:
        ids = as_bytes([*library(value), 1])
        want.setdefault((doc_id, len(ids) // 4), []).append(ids)
    for key, wholes in want.items():
        assert sum(len(i) for _, i in by_doc[key]) == sum(map(len, wholes))
        if len(wholes) == 1:
            assert b"".join(i for _, i in sorted(by_doc[key])) == wholes[0]
    assert by_doc.keys() == want.keys()
    sizes = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == sizes.get(p["sequence_id"], 0)
        sizes[p["sequence_id"]] = p["offset"] + len(p["ids"]) // 4
    short = [n for n in sizes.values() if n != capacity]
    assert all(n < capacity and n & (n - 1) == 0 for n in short) and len(short) == len(set(short))


def test_open_windows_meet_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    df = documents(spark, [(k, text(20, k)) for k in range(60)]).repartition(7)
    pieces = packing.pack_documents(df, tokenizer_path(), 1, 128, 2)
    assert len({r[0] for r in rows(pieces, "doc_id")}) == 60


def test_best_fit_comes_first():
    packer = packing.Packer(10, 2)
    full = [w for n in (6, 8, 2, 5) for w in packer.put((n, 0, n, b"\0" * 4 * n))]
    assert [[p[0] for p in w] for w in full] == [[8, 2], ] and [u for u, _ in packer.open] == [5, 6]
    full = list(packer.put((7, 0, 7, b"\0" * 28)))
    assert [[p[0] for p in w] for w in full] == [[6, 7]]


def test_empty_table(spark):
    assert packing.pack_documents(documents(spark, []), tokenizer_path(), 1).count() == 0
