from __future__ import annotations

import random

from runloom.operators import chunks
from runloom.operators.numbering import BLOCK

SCHEMA = "request_id string, seq long, chunk string"


def test_running_text_skips_empty_chunks(spark):
    rows = spark.createDataFrame(
        [("r", 3, "lo"), ("r", 0, "He"), ("r", 2, ""), ("r", 1, "l"), ("s", 0, "x")], SCHEMA
    )
    found = chunks.running_text(chunks.drop_empty(rows)).orderBy("request_id", "seq").collect()
    assert [row.running for row in found] == ["He", "Hel", "Hello", "x"]
    kept = chunks.running_text(rows).where("request_id = 'r'").orderBy("seq").collect()
    assert [row.running for row in kept] == ["He", "Hel", "Hel", "Hello"]


def test_one_long_request(spark):
    rng = random.Random(3)
    pieces = [rng.choice(["", "é", "ab", "\n"]) for _ in range(2 * BLOCK + 100)]
    rows = [("long", at, piece) for at, piece in enumerate(pieces)] + [("short", 9, "x"), ("empty", 0, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    text = {row.request_id: row.response for row in chunks.response_text(df).collect()}
    assert text == {"long": "".join(pieces), "short": "x", "empty": ""}
    ends = {row.seq: row.end_at for row in chunks.chunk_offsets(df).where("request_id = 'long'").collect()}
    running = {row.seq: row.running for row in chunks.running_text(df).where("request_id = 'long'").collect()}
    for at in (0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 2 * BLOCK + 99):
        shown = "".join(pieces[: at + 1])
        assert running[at] == shown and ends[at] == len(shown)


def test_chat_pairs(spark):
    turns = spark.createDataFrame(
        [
            ("c", 0, "system", "s"),
            ("c", 1, "assistant", "too early"),
            ("c", 2, "user", "q1"),
            ("c", 3, "assistant", "a1"),
            ("c", 4, "assistant", "a1 again"),
            ("c", 5, "user", "q2"),
            ("c", 6, "user", "q3"),
            ("c", 7, "assistant", "a3"),
        ],
        "conv_id string, turn long, role string, text string",
    )
    found = [tuple(row) for row in chunks.chat_pairs(turns).orderBy("pair").collect()]
    assert found == [("c", 1, "q1", "a1 again"), ("c", 2, "q2", ""), ("c", 3, "q3", "a3")]


def test_wide_gaps_do_not_matter(spark):
    rows = [("r", at * 1_000_000_007, f"<{at}>") for at in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    blocks = chunks.chunk_blocks(chunks.in_blocks(df))
    assert blocks.count() <= 3000 // BLOCK + 9
    assert chunks.response_text(df).first().response == "".join(r[2] for r in rows)
    last = chunks.chunk_offsets(df).orderBy("seq", ascending=False).first()
    assert last.end_at == sum(len(r[2]) for r in rows)
