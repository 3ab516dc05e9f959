from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runloom.functions import prompts
from runloom.functions import text as txt

PIECES = st.lists(
    st.sampled_from(["@startuml", "@enduml", " ", "\n", "x", "é", "@", "```", "```json", "{}", "　"]),
    max_size=8,
).map("".join)


def apply(spark, texts, make):
    rows = spark.createDataFrame(list(enumerate(texts)), "at int, t string")
    found = {row.at: row.out for row in rows.select("at", make(F.col("t")).alias("out")).collect()}
    return [found[at] for at in range(len(texts))]


def test_whitespace_is_all_that_python_strips():
    every = {chr(code) for code in range(0x110000) if chr(code).isspace()}
    assert set(txt.WHITESPACE) == every


def test_strip(spark):
    texts = ["\x1f　 a b\x85\n", "   ", "", None, "x", "\ta\t"]
    assert apply(spark, texts, txt.strip) == ["a b", "", "", None, "x", "a"]
    assert apply(spark, texts, txt.is_blank) == [False, True, True, True, False, False]


@pytest.mark.parametrize(
    ("reply", "script"),
    [
        ("a @startuml 1 @enduml b @startuml 2 @enduml c", "@startuml 1 @enduml b @startuml 2 @enduml"),
        ("@enduml then @startuml", ""),
        ("@startuml only", ""),
        ("only @enduml", ""),
        ("", ""),
        ("```\n@startuml\né\n@enduml\n```", "@startuml\né\n@enduml"),
        ("@enduml @startuml x @enduml", "@startuml x @enduml"),
    ],
)
def test_extract_script(spark, reply, script):
    assert apply(spark, [reply], txt.extract_script) == [script]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PIECES, min_size=20, max_size=40))
def test_extract_script_equals_greedy_match(spark, texts):
    def greedy(text):
        match = re.search("(?s)@startuml.*@enduml", text)
        return match.group(0) if match else ""

    assert apply(spark, texts, txt.extract_script) == [greedy(text) for text in texts]


@pytest.mark.parametrize(
    ("reply", "body"),
    [
        ("```json\n{}\n```", "{}"),
        ("```\n{}\n```", "```\n{}"),
        ("{}\n```", "{}"),
        (" ```json\n{}```", "```json\n{}"),
        ("```json", ""),
        ("```json```", ""),
        ("```", ""),
        ("plain", "plain"),
    ],
)
def test_unfence(spark, reply, body):
    assert apply(spark, [reply], lambda c: txt.strip(txt.unfence(c))) == [body]


def test_wrap_script(spark):
    texts = ["class A", "\n  @startuml\nclass A\n@enduml"]
    assert apply(spark, texts, txt.wrap_script) == ["@startuml\nclass A\n@enduml", texts[1]]


def test_artifact_key(spark):
    titles = [(7, "Blue  Door"), (8, "a\tb"), (9, None)]
    rows = spark.createDataFrame(titles, "id long, title string")
    keys = rows.select(txt.artifact_key(F.col("id"), F.col("title")).alias("k")).collect()
    assert [row.k for row in keys] == ["7_BlueDoor", "8_a\tb", "9_"]


def test_reply_status(spark):
    texts = ["[Error] x", "Error processing p request: y", "fine", None, "an [Error] inside"]
    assert apply(spark, texts, txt.reply_status) == ["error", "error", "ok", "pending", "ok"]


def test_slot_values_are_not_expanded(spark):
    value = "{x} $1 \n\\ {script}"
    made = apply(spark, [value], lambda c: prompts.similarity(c, c, "A {script} B {text} {{C}}"))
    assert made == [f"A {value} B {value} {{C}}"]


def test_null_slot_is_empty_and_distil_is_stripped(spark):
    assert apply(spark, [None], lambda c: prompts.generate(c, "<{text}>")) == ["<>"]
    assert apply(spark, [" t "], lambda c: prompts.distil(c, "\n {text} \n")) == ["t"]
    assert apply(spark, [" t "], lambda c: prompts.distil(c, "\n <{text}> \n")) == ["< t >"]


@pytest.mark.parametrize("flow", ["orig", "dist"])
def test_regenerate_holds_all_three_slots(spark, flow):
    made = apply(
        spark, ["T"], lambda c: prompts.regenerate(flow, c, F.concat(c, F.lit("S")), F.concat(c, F.lit("A")))
    )
    assert "\nT\n" in made[0] and "\nTS\n" in made[0] and "\nTA\n" in made[0]
