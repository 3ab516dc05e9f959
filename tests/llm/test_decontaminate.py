from __future__ import annotations

import random

import numpy as np

from runloom.llm import decontaminate as deco
from tests.llm.helpers import documents, text, words


def brute_tiles(item, body, shortest):
    free_item, free_body, tiles = [True] * len(item), [True] * len(body), []
    while True:
        best = None
        for j in range(len(body)):
            for i in range(len(item)):
                n = 0
                while (
                    i + n < len(item) and j + n < len(body) and free_item[i + n] and free_body[j + n]
                    and item[i + n] == body[j + n]
                ):
                    n += 1
                if n >= shortest and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return tiles
        tiles.append(best)
        for k in range(best[2]):
            free_item[best[0] + k] = free_body[best[1] + k] = False


def test_tiles_equal_brute_force():
    draw = random.Random(3)
    for _ in range(400):
        letters, shortest = draw.choice([1, 2, 3, 8]), draw.choice([1, 2, 3, 5])
        item = [draw.randint(1, letters) for _ in range(draw.randint(1, 14))]
        body = [draw.randint(1, letters) for _ in range(draw.randint(0, 30))]
        got = deco.greedy_tiles(np.array(item, np.uint64), np.array(body, np.uint64), shortest)
        assert [tuple(map(int, t)) for t in got] == brute_tiles(item, body, shortest)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string, found string")


def test_contaminated_documents(spark):
    item, other = words(40, 1, 10_000), words(30, 2, 10_000)
    swapped = " ".join(item[20:] + ["between"] + item[:20])
    loud = " ".join(item).upper().replace(" ", ", ")
    rows = [
        (0, text(300, 7) + " " + " ".join(item) + " " + text(300, 8)),
        (1, swapped),
        (2, loud),
        (3, " ".join(item[:30])),
        (4, " ".join(w for k, w in enumerate(item) if k % 4)),
        (5, " ".join(item + other)),
        (6, None), (7, ""), (8, "two words"), (8, "two words"),
        (9, text(50_000, 3) + " " + " ".join(other)),
        (None, " ".join(other)),
    ]
    table = benchmark(spark, [
        (10, " ".join(item), "c", "c"), (11, " ".join(other), "c", "c"), (12, None, "c", "c"), (13, "", "c", "c"),
        (14, "Two, words!", "c", "c"), (14, "Two, words!", "c", "c"), (None, "... !", "c", "c"),
    ])
    got = deco.contaminated(documents(spark, rows), table).collect()
    pairs = sorted((r["doc_id"] is None, r["doc_id"], r["item_id"]) for r in got if r["doc_id"] is not None)
    assert [p[1:] for p in pairs] == [(0, 10), (1, 10), (2, 10), (5, 10), (5, 11)] + [(8, 14)] * 4 + [(9, 11)]
    assert [r["item_id"] for r in got if r["doc_id"] is None] == [11]
    assert {r["tiles"] for r in got if r["doc_id"] == 1} == {2}
    kept = deco.clean(documents(spark, rows), table)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6, 7]
    assert kept.columns == documents(spark, rows).columns


def test_benchmark_in_blocks_gives_the_same(spark, monkeypatch):
    rows = [(k, text(60, k, 40)) for k in range(40)]
    items = [(100 + k, " ".join(text(60, k, 40).split()[5:30]), "c", "c") for k in range(0, 40, 2)]
    docs, table = documents(spark, rows), benchmark(spark, items)
    one = sorted(map(tuple, deco.contaminated(docs, table).collect()))
    monkeypatch.setattr(deco, "BLOCK_BYTES", 500)
    assert len(list(deco.benchmark_blocks(table))) > 3
    assert sorted(map(tuple, deco.contaminated(docs, table).collect())) == one and len(one) >= 20


def test_empty_tables(spark):
    docs, none = documents(spark, [(1, "a b c d e f")]), benchmark(spark, [])
    assert deco.contaminated(docs, none).count() == 0
    assert deco.contaminated(documents(spark, []), benchmark(spark, [(1, "a b", "c", "c")])).count() == 0
    assert deco.clean(docs, none).count() == 1


def test_a_common_word_as_an_item_takes_out_only_itself(spark):
    docs = documents(spark, [(1, "Well, yes, we went home"), (2, "Yes!"), (3, "yes yes"), (4, None), (5, "no more than that")])
    benchmark = spark.createDataFrame([(7, "yes"), (8, "no more than that, ever again")], "item_id long, text string")
    found = deco.contaminated(docs, benchmark)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 7), (2, 7), (3, 7)}
    assert {r["doc_id"] for r in deco.clean(docs, benchmark).collect()} == {1, 3, 4, 5}


def brute_contaminated(body: str | None, item: str) -> bool:
    mine, other = ([w.lower() for w in deco.WORD.findall(t)] for t in (item, body or ""))
    tiles = brute_tiles(mine, other, min(5, len(mine)))
    return bool(mine) and sum(n for *_, n in tiles) >= 0.8 * len(mine)


def test_random_documents_against_tiling_by_definition(spark):
    draw = random.Random(9)
    items = [(k, text(draw.randrange(1, 24), 100 + k, 60)) for k in range(12)]
    rows = []
    for k in range(120):
        parts = words(draw.randrange(0, 12), 1000 + k, 60)
        for _ in range(draw.randrange(3)):
            item = draw.choice(items)[1].split()
            cut = draw.randrange(len(item) + 1)
            # Reordered, whole or shortened passages.
            parts += draw.choice([[*item[cut:], *item[:cut]], item, item[: 3 + cut]])
        rows.append((k, " ".join(parts) if k % 40 else None))
    found = deco.contaminated(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    want = {(d, i) for d, t in rows for i, item in items if brute_contaminated(t, item)}
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and len(want) > 20
