from __future__ import annotations

import random

import numpy as np
import pytest

from runloom.llm import components as comp
from runloom.llm import simhash
from tests.llm.helpers import documents, text

MASK = (1 << 64) - 1


def brute_print(value: str | None, n: int = 3) -> int:
    import re

    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (value or "").encode().lower())
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    grams = grams or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints: list[int], radius: int) -> list[int]:
    """Smallest place that each place reaches."""
    top = list(range(len(prints)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for j in range(len(prints)):
        for i in range(j):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return [find(k) for k in range(len(prints))]


def test_majority_bits_over_long_and_empty_runs():
    draw = np.random.default_rng(1)
    lengths = [0, 1, 2, 255, 256, 0, 1000, 3]
    hashes = draw.integers(0, 1 << 63, sum(lengths), np.uint64)
    got, at = simhash.majority_bits(hashes, lengths), 0
    for k, n in enumerate(lengths):
        own = [int(h) for h in hashes[at : at + n]]
        at += n
        assert int(got[k]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > n)


def test_documents_with_nulls_copies_and_long_texts(spark):
    base = text(400, 1)
    rows = [(k, text(30, k)) for k in range(20)]
    rows += [(50, base), (40, base), (41, base + " tail"), (41, base + " tail"), (60, None), (61, ""), (62, " \t\n")]
    rows += [(70, "one two"), (71, "ONE two"), (72, "Éa b c"), (73, "éa b c"), (80, text(40_000, 9)), (None, base)]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    prints = [brute_print(t) for _, t in rows]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] & MASK) for r in got) == sorted(
        (d is None, d or 0, p) for (d, _), p in zip(rows, prints)
    )
    groups = brute_groups(prints, 2)
    least = {}
    for (d, _), g in zip(rows, groups):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    want = {(d, p): least.get(g) for (d, _), p, g in zip(rows, prints, groups)}
    assert all(want[r["doc_id"], r["fp"] & MASK] == r["component_id"] for r in got)
    assert want[60, 0] == 60 and want[62, 0] == 60


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("radius,tree_size", [(2, 2048), (2, 20), (0, 2), (3, 30)])
def test_links_connect_what_brute_force_connects(spark, radius, tree_size):
    draw = random.Random(radius * 10 + tree_size)
    centres = [draw.getrandbits(64) for _ in range(6)]
    prints = {0, MASK}
    for centre in centres:
        for _ in range(40):
            value = centre
            for _ in range(draw.randrange(6)):
                value ^= 1 << draw.randrange(64)
            prints.add(value)
    prints = sorted(prints, key=simhash._signed)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    roots = {r["node"]: r["root"] for r in comp.components(simhash.links(df, radius, tree_size)).collect()}
    groups = brute_groups(prints, radius)
    for k, p in enumerate(prints):
        assert roots.get(simhash._signed(p), simhash._signed(p)) == simhash._signed(prints[groups[k]])


def test_tree_follows_only_near_edges():
    draw = random.Random(2)
    values = [draw.getrandbits(64) for _ in range(300)] + [5, 5, 4, 7]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[::7]:
        for radius in (0, 1, 2, 20, 30):
            want = [k for k, x in enumerate(values) if (x ^ v).bit_count() <= radius]
            assert sorted(tree.within(v, radius)) == want


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    roots = {r["node"]: r["root"] for r in comp.components(links).collect()}
    assert roots == {k: 0 for k in range(1, 201)} | {501: 500}
