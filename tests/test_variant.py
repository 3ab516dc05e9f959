from __future__ import annotations

import json

import pytest

from runloom.functions import report, variant
from pyspark.sql import functions as F

GOOD = {"similarity_score": 80, "discrepancies": ["a", "b"], "extra": {"k": [1]}, "missing_elements": None}
REPLIES = [
    json.dumps(GOOD),
    f"```json\n{json.dumps(GOOD)}\n```",
    "{}",
    json.dumps(GOOD) + " thanks",
    json.dumps(GOOD) + "{}",
    json.dumps(GOOD) + "," + json.dumps(GOOD),
    '{}],"closed":true,"more":[{}',
    '{}],"closed":true}',
    "[{}]",
    "null",
    "",
    "{'discrepancies': []}",
    '{"discrepancies":"abc"}',
    '{"discrepancies":{"a":1}}',
    '{"discrepancies":null}',
    "similarity_score: 5",
    '"text"',
    None,
]


@pytest.mark.parametrize("reply", REPLIES)
def test_accepts_what_the_struct_parse_accepts(spark, reply):
    df = spark.createDataFrame([(1, reply)], "id long, reply string")
    (row,) = report.parse_report(df, F.col("reply"), "r").select("r.ok").collect()
    (found,) = variant.with_variant(df, F.col("reply"), "v").select(F.col("v").isNotNull().alias("ok")).collect()
    assert found.ok == row.ok


def test_items_and_extra_keys(spark):
    body = {
        "discrepancies": ["x", None, 1.5, ["y", {"z": True}], ""], "missing_elements": [], "additional_elements": ["é\n"],
        "note": "n", "more": {"a": None}, "nothing": None, "similarity_score": 3,
    }
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "no JSON"), (3, None), (4, '{"only":7}')], "id long, reply string")
    parsed = variant.with_variant(df, F.col("reply"))
    assert parsed.count() == 4
    items = {tuple(r) for r in variant.report_items(parsed, "id").collect()}
    assert items == {
        (1, "discrepancies", 0, "x"), (1, "discrepancies", 1, None), (1, "discrepancies", 2, "1.5"),
        (1, "discrepancies", 3, '["y",{"z":true}]'), (1, "discrepancies", 4, ""), (1, "additional_elements", 0, "é\n"),
    }
    keys = {tuple(r) for r in variant.extra_keys(parsed, "id").collect()}
    assert keys == {(1, "note", "n"), (1, "more", '{"a":null}'), (1, "nothing", None), (4, "only", "7")}
