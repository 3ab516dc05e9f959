from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from runloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, block string, score string, dim string"


def brute(data, k=5):
    out = []
    valid = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in data
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    for q, a in valid:
        if q is None or q % 50:
            continue
        scores = [(sum(x * y for x, y in zip(a, b)), c) for c, b in valid if c != q and len(a) == len(b)]
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(q, r + 1, c, s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def check(spark, data, k=5):
    df = spark.createDataFrame([(i, v, 1, "b", "s", "d") for i, v in data], SCHEMA)
    got = topk.top_k(df.repartition(3), lambda c: c % 50 == 0, k)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(data, k)


def vectors(n, dim, seed, spread=1.0):
    draw = random.Random(seed)
    return [[draw.gauss(0, spread) for _ in range(dim)] for _ in range(n)]


@pytest.mark.parametrize("dim", [1, 3, 64])
def test_equals_brute_force(spark, dim, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_NUMBERS", 40 * dim)
    monkeypatch.setattr(topk, "QUERY_NUMBERS", 2 * dim)
    check(spark, list(enumerate(vectors(260, dim, dim))))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    same = [0.5, -0.25, 0.125]
    data = [(k, same) for k in range(0, 140)] + [(7, same), (7, same), (None, same), (None, None)]
    data += [(200, None), (250, [1.0, None, 2.0]), (300, [nan, 1.0, 1.0]), (350, [inf, 0.0, 0.0]), (400, []), (401, [])]
    data += [(450, [1.0, 2.0]), (451, [3.0, -4.0]), (500, [0.0, 0.0, 0.0])]
    check(spark, data)
    check(spark, data[:3])
    check(spark, [])


def test_scores_beyond_a_long_stay_at_its_limit(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-1e30])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, lambda c: c % 50 == 0, 5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, (1 << 63) - 1), (0, 2, 2, -(1 << 63))]


def test_scores_at_the_lower_limit_are_ties(spark):
    data = [(0, [1e30]), (1, [-1e40]), (2, [-1e40]), (3, [-1e30]), (4, [-1e30]), (5, [-1e30])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, lambda c: c == 0, 2).orderBy("rank").collect()]
    assert got == [(0, 1, 1, -(1 << 63)), (0, 2, 2, -(1 << 63))]


@pytest.mark.parametrize("most", [1, 7, 1 << 18])
def test_blocks_go_on_from_the_scores_before(most):
    rows, k, width = np.floor(256 * np.array(vectors(500, 16, 9))), 5, 40
    rows[100:140] = rows[60:100]
    ids, null = np.arange(500), np.zeros(500, bool)
    known, found, given = topk.Scores(k, most), {}, [0, 0]
    for c in range(0, 500, width):
        part = slice(c, c + width)
        for block in range(0, 50, 10):
            q = slice(block, block + 10)
            for carried in (True, False):
                best = known.of(block, 10) if carried else None
                for at, place, score in topk.best_in_block(ids[q], rows[q], ids[part], null[part], rows[part], k, best):
                    given[carried] += 1
                    if carried:
                        found.setdefault(block + at, []).append((-score, c + place))
    for q in range(50):
        want = sorted((-int(rows[q] @ rows[c]), c) for c in range(500) if c != q)[:k]
        assert sorted(found[q])[:k] == want
    assert given[True] < given[False] if most == 1 << 18 else given[True] <= given[False]


def test_statistics_bound_the_distance():
    draw = np.random.default_rng(0)
    a, b = np.floor(draw.normal(0, 50, (40, 37))), np.floor(draw.normal(0, 50, (40, 37)))
    exact = ((a - b) ** 2).sum(axis=1)
    before = np.zeros(40)
    for segments in (1, 4, 16, 37):
        bound = ((topk.segment_statistics(a, segments) - topk.segment_statistics(b, segments)) ** 2).sum(axis=1)
        assert (bound <= exact + 1e-6).all()
        before = bound
    assert np.allclose(before, exact)


def test_no_vector_goes_through_the_driver(spark):
    data = [(i, v, 1, "b", "s", "d") for i, v in enumerate(vectors(120, 8, 3))]
    df = topk.top_k(spark.createDataFrame(data, SCHEMA), lambda c: c % 50 == 0)
    df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().toString()


def test_groups_of_rows_meet_groups_of_queries(spark, monkeypatch):
    sizes = {"CANDIDATE_NUMBERS": 64, "QUERY_NUMBERS": 16, "GROUP_NUMBERS": 1 << 10, "GROUP_QUERY_NUMBERS": 1 << 8}
    for name, n in sizes.items():
        monkeypatch.setattr(topk, name, n)
    grids, grid = [], topk.grid
    monkeypatch.setattr(topk, "grid", lambda *args: grids.append(grid(*args)) or grids[-1])
    same = [0.5, -0.25, 0.125, 1.0, 0.0, -2.0, 3.0, 0.25]
    data = list(enumerate(vectors(400, 8, 5)))
    data += [(k, same) for k in range(400, 700)] + [(k % 60, same) for k in range(100)] + [(None, same)] * 7
    data += list(enumerate(vectors(130, 3, 6), 1000)) + [(2000, []), (2050, []), (2051, [])]
    check(spark, data)
    assert min(grids[0]) > 2


@pytest.mark.parametrize("scale", [1e-3, 1.0, 300.0, 3e4, 1e6])
def test_scores_are_exact_at_every_scale(spark, scale):
    data = list(enumerate([[scale * x for x in v] for v in vectors(160, 8, 11)]))
    check(spark, data + [(200, [x * 3e6 / scale for x in data[7][1]])])


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_clusters_are_ruled_out_by_their_bounds(kind, monkeypatch):
    draw, exact, pair_scores = np.random.default_rng(4), [], topk._pair_scores
    monkeypatch.setattr(topk, "_pair_scores", lambda *args: exact.append(len(args[2])) or pair_scores(*args))
    rows = np.repeat(draw.normal(0, 100, (200, 16)), 4, axis=1).repeat(20, axis=0)
    rows = np.floor(rows + draw.normal(0, 3, rows.shape))
    ids, null, asked, k = np.arange(4000), np.zeros(4000, bool), np.arange(0, 4000, 400), 5
    best, found = np.full((10, k), -np.inf), {}
    q = topk.Side(rows[asked], True, kind)
    for a in range(0, 4000, 1000):
        part = slice(a, a + 1000)
        c = topk.Side(rows[part], False, kind)
        for at, place, score in zip(*topk._nearest(asked, q, ids[part], null[part], c, k, best)):
            found.setdefault(int(at), []).append((-int(score), a + int(place)))
    for at, i in enumerate(asked):
        want = sorted((-int(rows[i] @ rows[c]), c) for c in range(4000) if c != i)[:k]
        assert sorted(found[at])[:k] == want
    assert sum(exact) < 4000  # of 40,000 pairs


def test_a_group_keeps_the_best_of_many_blocks():
    def blocks(ids):
        cells = {"ids": ids.tobytes(), "nulls": bytes(len(ids)), "values": np.ones(len(ids), np.int8).tobytes()}
        return pa.table({"dim": [1], "block": [7], "n": [len(ids)]} | {name: [x] for name, x in cells.items()})

    ids, asked = np.arange(4000)[::-1].copy(), np.arange(0, 4000, 10)
    got = topk._search(5, 50, 16)(blocks(ids), blocks(asked)).to_pylist()  # ties: every block beats those before
    want = [(i, c) for i in asked.tolist() for c in [x for x in range(6) if x != i][:5]]
    assert [(r["query_id"], r["vec_id"]) for r in got] == want
    assert [r["place"] for r in got[::5]] == list(range(len(asked))) and {r["score"] for r in got} == {1}


def held(n, queries, dim=64):
    size = lambda x: Row(n=x, numbers=x * dim, size=x * (2 * dim + 9), blocks=-(-x * dim // topk.QUERY_NUMBERS))
    return size(n), size(queries)


@pytest.mark.parametrize("share", [50, 1])
@pytest.mark.parametrize("n", [0, 50, 10_000, 615_384, 15_000_000, 10**9])
@pytest.mark.parametrize("most", [1, 12, 200, 4000])
def test_groups_are_bounded_and_copies_are_few(n, share, most):
    rows, asked = held(n, n // share)
    parts, shares = topk.grid(rows, asked, 5, most)
    assert parts >= 1 and shares >= 1
    assert rows.numbers / parts <= topk.GROUP_NUMBERS and asked.numbers / shares <= topk.GROUP_QUERY_NUMBERS
    if n < 1_000_000 and share == 50:  # more rows or queries need more groups to fit
        copies = shares * rows.size + parts * (asked.size + 5 * 32 * asked.n)
        assert copies <= 1.5 * max(4 * rows.size, topk.GROUP_BYTES)
