from __future__ import annotations

from pyspark.sql import functions as F

from runloom.llm import chat

EVENTS = "conv_id long, message long, seq long, kind string, role string, text string"


def rendered(spark, events):
    df = spark.createDataFrame(events, EVENTS).withColumn("conversation", F.lit("clash")).withColumn("log", F.lit(1))
    out = chat.read_back(chat.chat_texts(df)).collect()
    return {r["conversation"]: ([tuple(t) for t in r["turns"]], list(r["loss_texts"]), r["formatted"]) for r in out}


def test_deltas_edits_and_regenerations(spark):
    got = rendered(spark, [
        (1, 0, 0, "start", "user", "Hel"),
        (1, 0, 1, "delta", None, "lo"),
        (1, 1, 0, "start", "assistant", None),
        (1, 1, 1, "delta", None, "bad"),
        (1, 1, 2, "regenerate", None, None),
        (1, 1, 4, "delta", None, "d"),
        (1, 1, 3, "delta", None, "goo"),
        (1, 2, 0, "start", "user", "typo"),
        (1, 2, 9, "edit", None, "fixed"),
        (1, 3, 5, None, None, "loose "),
        (1, 3, 6, "delta", "assistant", "end"),
    ])
    turns, loss, formatted = got[1]
    assert turns == [("user", "Hello"), ("assistant", "good"), ("user", "fixed"), ("assistant", "loose end")]
    assert loss == ["good", "loose end"]
    assert formatted.startswith("<turn user>\nHello</turn>\n<turn assistant>\ngood</turn>\n")


def test_reset_comes_before_deltas_of_its_place_and_repeated_rows_count(spark):
    got = rendered(spark, [
        (1, 0, 3, "delta", None, "x"), (1, 0, 3, "delta", None, "x"), (1, 0, 3, "edit", "user", "e"), (1, 0, 0, "start", None, "s"),
    ])
    assert got[1][0] == [("user", "exx")]


def test_nulls_and_empty(spark):
    got = rendered(spark, [(None, None, None, None, None, None), (2, 0, 0, "start", "assistant", "")])
    assert got[None][0] == [("", "")] and got[None][1] == []
    assert got[2][0] == [("assistant", "")] and got[2][1] == []
    assert rendered(spark, []) == {}


HARD = ["\\", "</turn>", "<turn ", "</turn>\n", "\n", "<\\/turn>", "\\/", "$1", ">", "é", "𝄞", "<", "turn>", "/", " ", "a"]


def test_control_strings_come_back(spark):
    import random

    draw = random.Random(5)
    texts = ["".join(draw.choice(HARD) for _ in range(draw.randrange(12))) for _ in range(300)]
    roles = ["".join(draw.choice(["<", ">", "\\", "g", "l", "user", "\n"]) for _ in range(3)) for _ in texts]
    events = [(k // 3, k % 3, 0, "start", "assistant" if k % 2 else roles[k], t) for k, t in enumerate(texts)]
    got = rendered(spark, events)
    for conv in got:
        mine = [e for e in events if e[0] == conv]
        assert got[conv][0] == [(e[4], e[5]) for e in mine]
        assert "".join(got[conv][1]) == "".join(e[5] for e in mine if e[4] == "assistant")


def test_long_conversation(spark):
    events = [(1, k, 0, "start", "assistant" if k % 2 else "user", f"<turn {k}" * 50) for k in range(3000)]
    turns, loss, _ = rendered(spark, events)[1]
    assert [t for _, t in turns] == [e[5] for e in events] and len(loss) == 1500


def test_no_python_in_the_plan(spark):
    from tests.helpers import plan_of

    df = spark.createDataFrame([(1, 0, 0, "start", "user", "t")], EVENTS)
    plan = plan_of(chat.read_back(chat.chat_texts(df)))
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 2
