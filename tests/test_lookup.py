"""Newest runs as of a time, and from a bucketed catalogue table."""

from __future__ import annotations

import datetime
import random
import uuid

import pytest

from runloom.operators import asof, runlog
from runloom.operators.numbering import BLOCK
from runloom.schemas import RUN_KEY
from runloom.sources import bucketed
from tests.helpers import log_frame, plan_of

ASKED = "request_id long, srs_id string, llm_provider string, llm_model string, temperature double, at timestamp"
KEYS = "srs_id string, llm_provider string, llm_model string, temperature double"


def time(seconds):
    return None if seconds is None else datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc)


def asked_frame(spark, rows):
    """Requests from (request_id, srs_id, seconds)."""
    return spark.createDataFrame([(i, s, "p", "m", 0.5, time(at)) for i, s, at in rows], ASKED)


def test_as_of_ties_nulls_and_missing_keys(spark):
    log = log_frame(
        spark,
        [
            {"id": 5, "srs_id": "a", "at": 10, "original_srs_text": "first"},
            {"id": 3, "srs_id": "a", "at": 20, "original_srs_text": "tie"},
            {"id": 4, "srs_id": "a", "at": 20, "original_srs_text": "newest"},
            {"id": 9, "srs_id": "a", "at": 15, "temperature": 0.7},
            {"id": 6, "srs_id": None, "at": 1},
        ],
    )
    asked = asked_frame(spark, [(1, "a", 9), (2, "a", 10), (3, "a", 19), (4, "a", 20), (5, "a", 99), (6, "b", 99), (7, None, 99), (8, "a", None)])
    found = {r.request_id: (r.id, r.original_srs_text) for r in asof.runs_as_of(asked, log).collect()}
    none = (None, None)
    assert found == {
        1: none, 2: (5, "first"), 3: (5, "first"), 4: (4, "newest"), 5: (4, "newest"), 6: none, 7: none, 8: none
    }
    assert asof.runs_as_of(asked.limit(0), log).count() == 0
    assert {r.id for r in asof.runs_as_of(asked, log.limit(0)).collect()} == {None}


def test_as_of_carries_runs_over_blocks_of_a_hot_key(spark):
    draw = random.Random(6)
    runs = [{"id": k, "srs_id": "hot", "at": draw.randrange(100_000)} for k in range(40)]
    runs += [{"id": 100 + k, "srs_id": f"s{k % 9}", "at": draw.randrange(100_000)} for k in range(500)]
    rows = [(k, draw.choice(["hot", "hot", "s1", "none"]), draw.randrange(100_000)) for k in range(4 * BLOCK)]
    found = {r.request_id: r.id for r in asof.newest_before(asked_frame(spark, rows), log_frame(spark, runs)).collect()}
    for k, srs_id, at in rows:
        before = [(r["at"], r["id"]) for r in runs if r["srs_id"] == srs_id and r["at"] <= at]
        assert found.pop(k) == (max(before)[1] if before else None)
    assert not found


def test_as_of_has_no_join_over_ranges(spark):
    log = log_frame(spark, [{"id": 1, "srs_id": "a", "at": 1, "original_srs_text": "t"}])
    plan = plan_of(asof.runs_as_of(asked_frame(spark, [(1, "a", 2)]), log))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.fixture
def table(spark, tmp_path):
    name = f"log_{uuid.uuid4().hex}"
    bucketed.create_log(spark, name, str(tmp_path / "log"), 4)
    yield name
    spark.sql(f"DROP TABLE {name}")


def test_bucketed_log_equals_lookup(spark, table, tmp_path):
    draw = random.Random(7)
    rows = [
        {"id": k, "srs_id": draw.choice(["hot", "hot", f"s{k % 20}", None]), "at": draw.randrange(50),
         "temperature": draw.choice([0.0, -0.0, 0.5]), "original_srs_text": f"text {k}"}
        for k in range(400)
    ]
    log = log_frame(spark, rows)
    bucketed.append_log(log.where("id < 150"), table)
    # Creating it again changes nothing.
    bucketed.create_log(spark, table, str(tmp_path / "other"), 9)
    bucketed.append_log(log.where("id >= 150"), table)
    assert spark.table(table).count() == 400
    keys = spark.createDataFrame(
        [(s, "p", "m", t) for s in ["hot", "s1", "s2", "nobody", None] for t in (0.0, 0.5, 0.9)], KEYS
    )
    got = bucketed.latest_bucketed(keys.unionByName(keys), spark.table(table))
    want = runlog.lookup_latest(keys, log).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() == 15


def test_no_row_of_the_bucketed_log_moves(spark, table):
    bucketed.append_log(log_frame(spark, [{"id": 1, "srs_id": "a", "at": 1, "original_srs_text": "t"}]), table)
    keys = spark.createDataFrame([("a", "p", "m", 0.5)], KEYS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(bucketed.latest_bucketed(keys, spark.table(table)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    exchanges = [at for at, line in enumerate(lines) if "Exchange" in line]
    # Whatever moves comes from the requested keys: below an exchange there is no scan of the log.
    for at in exchanges:
        depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
        below = []
        for line in lines[at + 1 :]:
            if len(line) - len(line.lstrip(" :+-")) <= depth:
                break
            below.append(line)
        assert not any("FileScan" in line for line in below)
    assert plan.count("FileScan parquet") == 2 and plan.count("SelectedBucketsCount: 4 out of 4") == 2
    assert exchanges and RUN_KEY
