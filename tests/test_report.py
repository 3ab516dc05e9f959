from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runloom.functions import report as rep

SECTIONS = rep.SECTIONS


def parse(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "at int, reply string")
    found = {row.at: row.report for row in rep.parse_report(rows, F.col("reply")).collect()}
    return [found[at] for at in range(len(texts))]


ACCEPTED = [
    '```json\n{"similarity_score": 1}\n```',
    '{"similarity_score": 1}\n```',
    "{}",
    '  {"a": 1}\n',
    '{"discrepancies": null}',
    '{"extracted_description": "ends with }"}',
    '{"extracted_description": "x] , \\"closed\\":true}"}',
    '{"similarity_score": 1, "similarity_score": 2}',
]
REJECTED = [
    "```\n{}\n```",
    '"similarity_score": 75.0',
    "{} thanks",
    "{} x }",
    "{}}",
    "{},{}",
    "{},",
    "[{}]",
    "null",
    "12",
    '"text"',
    "",
    None,
    "{'similarity_score': 1}",
    '{"discrepancies": "abc"}',
    '{"extracted_description": "two\nlines"}',
    '{"a": 1',
    "[Error] no key",
]


def test_accepted_and_rejected(spark):
    assert [report.ok for report in parse(spark, ACCEPTED)] == [True] * len(ACCEPTED)
    assert [report.ok for report in parse(spark, REJECTED)] == [False] * len(REJECTED)


def test_empty_object_has_all_defaults(spark):
    (report,) = parse(spark, ["{}"])
    assert (report.ok, report.extracted_description, report.similarity_score) == (True, "", None)
    assert [report[name] for name in SECTIONS] == [[], [], []]


@pytest.mark.parametrize(
    ("score", "value"),
    [("75", 75.0), ('"75"', 75.0), ('" 75.5 "', 75.5), ("1e1", 10.0), ('"75%"', None), ('"75d"', None),
     ("null", None), ('""', None), ("true", None), ("-3", -3.0), ("140", 140.0), ("[1]", None)],
)
def test_score(spark, score, value):
    (report,) = parse(spark, [f'{{"similarity_score": {score}}}'])
    assert report.ok and report.similarity_score == value


def test_numbers_in_lists_become_text(spark):
    (report,) = parse(spark, ['{"missing_elements": [1, "a"]}'])
    assert report.missing_elements == ["1", "a"]


def test_keys_are_case_sensitive_and_unknown_keys_ignored(spark):
    (report,) = parse(spark, ['{"Discrepancies": ["x"], "SIMILARITY_SCORE": 3, "_corrupt": "y", "closed": false}'])
    assert report.ok and report.discrepancies == [] and report.similarity_score is None


def test_not_a_number(spark):
    (report,) = parse(spark, ['{"similarity_score": NaN}'])
    assert report.ok and report.similarity_score is None


def test_replies_that_open_the_envelope_are_rejected(spark):
    texts = ['{}],"x":[{}', '{}],"report":[{}', '{}],"closed":true,"x":[{}', '{}]}', "{}"]
    assert [r.ok for r in parse(spark, texts)] == [False, False, False, False, True]


def test_analysis_text(spark):
    texts = ['{"discrepancies": ["a", "b"], "additional_elements": ["x"]}']
    rows = spark.createDataFrame([(text,) for text in texts], "reply string")
    made = rep.parse_report(rows, F.col("reply")).select(rep.analysis_text(F.col("report")).alias("a"))
    assert made.first().a == "discrepancies:\na\nb\n\nmissing_elements:\n\n\nadditional_elements:\nx"


def test_split_keeps_every_row(spark):
    rows = spark.createDataFrame([(text,) for text in ACCEPTED + REJECTED], "reply string")
    accepted, rejected = rep.split_reports(rep.parse_report(rows, F.col("reply")))
    assert accepted.count() == len(ACCEPTED) and rejected.count() == len(REJECTED)


PARTS = st.lists(
    st.sampled_from(
        ["{", "}", "[", "]", ",", ":", '"a"', "1", "null", " ", "\n", '"discrepancies"', "x", "```", '"}"']
    ),
    max_size=7,
).map("".join)
REPORTS = st.fixed_dictionaries(
    {},
    optional={
        "extracted_description": st.text(max_size=8),
        "similarity_score": st.integers(0, 100),
        **{name: st.lists(st.text(max_size=5), max_size=3) for name in SECTIONS},
    },
)


def acceptable(text: str) -> bool:
    """A JSON object whose lists are lists, by the standard library."""
    try:
        value = json.loads(text)
    except ValueError:
        return False
    return isinstance(value, dict) and all(
        value.get(name) is None or isinstance(value[name], list) for name in SECTIONS
    )


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PARTS, min_size=30, max_size=60))
def test_acceptance_agrees_with_the_json_library(spark, texts):
    texts = [text for text in texts if "```" not in text]
    assert [(t, r.ok) for t, r in zip(texts, parse(spark, texts))] == [(t, acceptable(t)) for t in texts]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(REPORTS, min_size=10, max_size=20))
def test_real_reports_keep_their_fields(spark, values):
    for ascii_only in (True, False):
        texts = [json.dumps(value, ensure_ascii=ascii_only) for value in values]
        for value, report in zip(values, parse(spark, texts)):
            assert report.ok
            assert report.extracted_description == value.get("extracted_description", "")
            assert [report[name] for name in SECTIONS] == [value.get(name, []) for name in SECTIONS]
