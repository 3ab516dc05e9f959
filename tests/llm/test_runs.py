from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np

from runloom.llm import queries, runs
from tests.check import TABLES
from tests.llm.helpers import documents

SF = str(TABLES / "sf0.001")


def brute_runs(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """For every period the stretches in which words that far apart are equal."""
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            part = words[start : start + length]
            if length >= max(least, 2 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda run: (run[0], run[2]))


def brute_row(text: str | None) -> tuple:
    words = (text or "").encode().split()
    found = brute_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return len(words), found, left.decode()


def numbers(words) -> np.ndarray:
    return np.array(words, np.int64)


def test_random_words_against_brute_force():
    draw = random.Random(1)
    for _ in range(1500):
        n, kinds = draw.randrange(90), draw.choice([1, 2, 2, 3, 5, 30])
        words = [draw.randrange(kinds) for _ in range(n)]
        if n > 4 and draw.random() < 0.5:
            a, p = draw.randrange(n), draw.randrange(1, n)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        least = draw.choice([12, 12, 2, 3, 5, 7])
        assert runs.find_runs(numbers(words), least) == brute_runs(words, least), (words, least)


def test_sets_keep_order_over_many_pieces():
    draw = random.Random(2)
    given = draw.sample(range(10**6), 5000)
    positions = runs.Positions(given[0])
    for k, value in enumerate(given[1:], 1):
        before, after = positions.add(value)
        if k % 500 == 0:
            put = sorted(given[: k + 1])
            at = put.index(value)
            assert (before, after) == (put[at - 1] if at else -1, put[at + 1] if at < k else -1)
    assert list(positions) == sorted(given)


def test_long_texts_of_few_words():
    n = 100_000
    assert runs.find_runs(numbers([7] * n)) == [(0, n, 1)]
    assert runs.find_runs(numbers([1, 2, 3] * n)) == [(0, 3 * n, 3)]
    line = [1, 2, 3, 4, 5, 6, 7]
    broken = [w for k in range(5000) for w in (*line, 100 + k)]
    assert runs.find_runs(numbers(broken)) == []


def test_defined_results(spark):
    rows = [
        (1, "a b " * 8), (1, "a b " * 8), (2, None), (3, ""), (None, "x\x0b" * 12), (4, " \t\n"),
        (5, "one two three four five six seven eight nine ten eleven twelve"),
        (6, "é\x85é " * 12 + "a\xa0b end"),
    ]
    out = {
        (r["doc_id"], r["n_words"]): ([tuple(x) for x in r["runs"]], r["collapsed"])
        for r in runs.periodic_runs(documents(spark, rows)).collect()
    }
    assert out[1, 16] == ([(0, 16, 2)], "a b") and out[2, 0] == out[3, 0] == out[4, 0] == ([], "")
    assert out[None, 12] == ([(0, 12, 1)], "x") and out[5, 12] == ([], rows[6][1])
    assert out[6, 14] == ([(0, 12, 1)], "é\x85é a\xa0b end")
    assert runs.periodic_runs(documents(spark, rows)).count() == len(rows)
    assert runs.periodic_runs(documents(spark, [])).count() == 0


def made(doc_id: int, text: str | None) -> str:
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return b" ".join(words).decode()


def test_op12(spark):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").collect()}
    texts = {d: t for d, t in texts.items() if len((t or "").split()) < 1500}
    out = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    with_runs = 0
    for doc_id, text in texts.items():
        _, found, left = brute_row(made(doc_id, text))
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        four = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        digests = tuple(hashlib.sha256(t.encode()).hexdigest() for t in (lines, left))
        assert out[doc_id] == (doc_id, len(found), *four, *digests)
        with_runs += bool(found)
    assert with_runs > 5 and len(texts) > 150
