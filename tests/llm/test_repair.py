from __future__ import annotations

import random

from pyspark.sql import functions as F

from runloom.llm import oracle, queries, repair
from tests.check import connect, normal

ROWS = "conv_id long, turn long, role string, text string"


def every_edit(rows) -> tuple[int, str]:
    """The least (cost, audit) among all sequences of edits that cost no more than deleting all rows."""
    found, most = [], 3 * len(rows) + 2

    def go(i, state, cost, audit):
        if cost > most:
            return
        if i == len(rows) and state in "0a":
            found.append((cost, audit))
        follows = {"0": "u", "s": "u", "a": "u", "u": "a"}[state]
        go(i, follows, cost + 2, audit + "I")
        if i == len(rows):
            return
        initial, fault = rows[i]
        go(i + 1, state, cost + 3, audit + "D")
        if fault not in (repair.BLANK, repair.DUPLICATE):
            extra = fault == repair.CUT
            if initial == follows or initial == "s" and state == "0":
                go(i + 1, initial, cost + extra, audit + "K")
            go(i + 1, follows, cost + 2 + extra, audit + "R")

    go(0, "0", 0, "")
    return min(found)


def all_splits(rows) -> tuple[int, str]:
    """The whole table of spans, every cell from all of its splits."""
    if not rows:
        return repair.best(repair.EMPTY)
    cells = {(i, i + 1): repair.cell_of_row(*row) for i, row in enumerate(rows)}
    for length in range(2, len(rows) + 1):
        for i in range(len(rows) - length + 1):
            cell = cells[i, i + length] = {}
            for k in range(i + 1, i + length):
                for symbol, edits in repair.combine(cells[i, k], cells[k, i + length]).items():
                    repair.better(cell, symbol, edits)
    return repair.best(cells[0, len(rows)])


def test_halves_name_the_edits_of_all_splits_and_of_all_sequences():
    draw = random.Random(1)
    for n in [*range(6)] * 60 + [9, 14]:
        rows = [(draw.choice("suuaaa t"), draw.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        spans = repair.Spans()
        for row in rows:
            spans.add(repair.cell_of_row(*row))
        cell = repair.cell_from(repair.cell_text(spans.cell()))
        assert repair.best(cell) == all_splits(rows), rows
        if n < 6:
            assert repair.best(cell) == every_edit(rows), rows


def repaired(spark, rows, ids=()):
    df = spark.createDataFrame(rows, ROWS).withColumns({n: F.lit("x") for n in ("digest", "block", "cell", "edit", "_at")})
    more = spark.createDataFrame([(i,) for i in ids], "conv_id long").unionByName(df.select("conv_id"))
    summary, out = repair.repair(df, more)
    texts: dict = {}
    for r in out.orderBy("conv_id", "place").collect():
        texts.setdefault(r["conv_id"], []).append((r["edit"], r["role"], r["text"]))
    return {r["conv_id"]: tuple(r)[1:] for r in summary.collect()}, texts


def test_defined_results(spark):
    summary, texts = repaired(
        spark,
        [
            (1, 0, "system", "Be."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes!"),
            (2, 0, "assistant", "A."), (2, 3, "assistant", "B"), (2, 3, "assistant", "B"),
            (3, None, None, None), (3, None, "tool", "x."),
            (None, 5, "user", "Q?"), (None, 4, "user", "P.\n"),
        ],
        ids=[4, 4],
    )
    assert summary[1] == (0, 0, 0, 0, 0, 0, "KKK") and summary[4] == (0, 0, 0, 0, 0, 0, "")
    assert texts[1] == [("K", "system", "Be."), ("K", "user", "Hi."), ("K", "assistant", "Yes!")]
    # Turns 1 and 2 are missing; of the two equal rows the second has to go.
    assert summary[2] == (2, 0, 1, 1, 2, 6, "RKD")
    assert texts[2] == [("R", "user", "A."), ("K", "assistant", "B")]
    assert summary[3] == (0, 1, 0, 0, 1, 6, "DD") and 3 not in texts
    assert summary[None] == (0, 0, 0, 0, 1, 2, "KR")
    assert texts[None] == [("K", "user", "P.\n"), ("R", "assistant", "Q?")]


def test_no_rows(spark):
    assert repaired(spark, []) == ({}, {})


def test_a_conversation_over_many_blocks(spark):
    draw = random.Random(2)
    rows = [(7, k, draw.choice(["user", "assistant"]), f"{k}{draw.choice(['.', '', '!'])}") for k in range(5000)]
    summary, texts = repaired(spark, [*rows, *((c, 0, "user", "one.") for c in range(8, 40))])
    spans = repair.Spans()
    for _, _, role, text in rows:
        spans.add(repair.cell_of_row(role[0], repair.OK if text[-1] in ".!" else repair.CUT))
    cost, audit = repair.best(spans.cell())
    assert summary[7][-2:] == (cost, audit) and summary[7][0] == 0
    assert summary[7][4] == sum(a[2] == b[2] for a, b in zip(rows, rows[1:]))
    assert [role for _, role, _ in texts[7]] == ["user", "assistant"] * (len(texts[7]) // 2)
    assert summary[8] == (0, 0, 0, 0, 0, 2, "KI") and texts[8][1] == ("I", "assistant", "")


def test_op13_with_nulls_ties_and_empty_texts(spark, tmp_path):
    draw = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None]
    said = ["Yes.", "No", "Why?", "", " \t", None, "Same!", "é\x85"]
    rows = [
        (draw.choice([None, *range(40)]), draw.choice([None, *range(12)]), draw.choice(roles), draw.choice(said))
        for _ in range(900)
    ]
    # Of one turn one row, so that the order is given.
    rows = list({row[:2]: row for row in rows}.values()) + [(100, 1, "user", "alone.")]
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = connect(str(tmp_path))
    got = queries.op13_repair(spark, str(tmp_path)).toPandas()
    assert normal(got) == normal(con.sql(oracle.SQL["op13_repair"]).df())
