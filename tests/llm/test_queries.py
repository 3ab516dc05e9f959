"""Registered queries that SQL cannot express, against brute force over whole tables."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from runloom.llm import decontaminate, queries
from tests.check import TABLES
from tests.llm.helpers import tokenizer_path
from tests.llm.test_simhash import brute_groups, brute_print

SF = str(TABLES / "sf0.001")


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r["doc_id"], r["text"]) for r in queries.table(spark, SF, "documents").collect())


@pytest.fixture(scope="module")
def ids(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    return {d: library.encode(t or "", add_special_tokens=False).ids for d, t in docs}


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2(spark, docs):
    prints = [brute_print(t) for _, t in docs]
    groups = brute_groups(prints, 2)
    want = {(d, f"{p:016x}", docs[g][0]) for (d, _), p, g in zip(docs, prints, groups)}
    assert {tuple(r) for r in queries.op2_simhash(spark, SF).collect()} == want


def test_op3(spark, docs):
    benchmark = [tuple(r) for r in queries.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    items = decontaminate.Items.of(benchmark, 5)
    want = {(d, m[0]) for d, t in docs for m in decontaminate.matches(t, items, 0.8)}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op3_decontaminate(spark, SF).collect()}
    flat = {i: " ".join(decontaminate.WORD.findall(t.lower())) for i, t in benchmark}
    whole = {(d, i) for d, t in docs for i, x in flat.items() if x in " ".join(decontaminate.WORD.findall(t.lower()))}
    assert got == want and whole <= got and got


def test_op4(spark, ids):
    pieces: dict = {}
    lengths: dict = {}
    for r in queries.op4_packing(spark, SF).orderBy("sequence_id", "offset").collect():
        own = [*ids[r["doc_id"]], 1]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == crc(own[r["start"] : r["start"] + r["length"]])
        assert r["offset"] == lengths.get(r["sequence_id"], 0)
        lengths[r["sequence_id"]] = r["offset"] + r["length"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for doc_id, found in pieces.items():
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == len(ids[doc_id]) + 1
    assert pieces.keys() == ids.keys()
    assert all(n == 2048 or n < 2048 and n & (n - 1) == 0 for n in lengths.values())


def test_op10(spark, ids):
    start = 0
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op10_token_file(spark, SF).collect()}
    for doc_id in sorted(ids):
        own = [*ids[doc_id], 2]
        assert got.pop(doc_id) == (start, len(own), crc(own))
        start += len(own)
    assert not got
