"""Back-feed round after round."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from runloom.operators.catalog import Model
from runloom.plans import accept, backfeed, stages
from tests.helpers import log_frame

MODELS = (Model("p", "m", "api"),)
KEYS = "srs_id string, llm_provider string, llm_model string, temperature double"


def work_of(spark, rows):
    """Work rows whose scripts say how far their key has come."""
    log = log_frame(
        spark,
        [
            {"id": k, "srs_id": srs_id, "at": k, "original_srs_text": text, "distilled_srs_text": short,
             "plantuml_script_orig_srs": "@startuml 0 @enduml", "plantuml_script_dist_srs": "@startuml 0 @enduml"}
            for k, (srs_id, text, short) in enumerate(rows)
        ],
    )
    keys = spark.createDataFrame([(s, "p", "m", 0.5) for s, _, _ in rows], KEYS)
    return backfeed.work_list(keys, log, MODELS)


def counting_client(folder: str):
    """Each generation counts its script up by one; the score is the number in the script. Calls leave a file."""

    def make_client():
        import re
        import uuid

        def answer(prompt, api_id, temperature):
            number = int(re.search(r"@startuml (\d+) @enduml", prompt)[1])
            key = re.search(r"key-(\w+)", prompt)[1]
            if "similarity_score" in prompt:
                return json.dumps({"similarity_score": number})
            open(f"{folder}/{key}-{uuid.uuid4().hex}", "w").close()
            if key == "fails":
                raise ValueError("no")
            return f"@startuml {number + 1} @enduml"

        return answer

    return make_client


def test_rounds_until_accepted(spark, tmp_path):
    rows = [("one", "key-one", "key-one"), ("three", "key-three", "key-three"), ("never", "key-never", "key-never"),
            ("fails", "key-fails", "key-fails"), ("blank", "key-blank", " ")]
    work = work_of(spark, rows)
    ask = stages.ask_function(counting_client(str(tmp_path)), 2)
    score = F.col("similarity_score_orig_srs")
    wanted = F.when(F.col("srs_id") == "one", score >= 1).when(F.col("srs_id") == "three", score >= 3)
    found = {r.srs_id: r for r in accept.backfeed_until(work, ask, wanted, 4).collect()}
    assert {k: (r.rounds, r.verdict, r.run_count, r.event_type) for k, r in found.items()} == {
        "one": (1, "accepted", 2, "BACKFEED_IMPROVEMENT_1"),
        "three": (3, "accepted", 4, "BACKFEED_IMPROVEMENT_3"),
        "never": (4, "open", 5, "BACKFEED_IMPROVEMENT_4"),
        "fails": (4, "open", 1, None),
        "blank": (0, "no_text", 1, None),
    }
    assert found["three"].plantuml_script_orig_srs == "@startuml 3 @enduml"
    assert found["fails"].plantuml_script_orig_srs == "@startuml 0 @enduml" and found["fails"].state_orig == "failed_response"
    # Two generations a round, none for an accepted run or one without a text.
    calls = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert {k: calls.count(k) for k in found} == {"one": 2, "three": 6, "never": 8, "fails": 8, "blank": 0}


def test_no_work_and_no_rounds(spark, tmp_path):
    work = work_of(spark, [("one", "key-one", "key-one")])
    ask = stages.ask_function(counting_client(str(tmp_path)), 1)
    assert accept.backfeed_until(work.limit(0), ask, F.lit(True), 3).count() == 0
    (row,) = accept.backfeed_until(work, ask, F.lit(True), 0).collect()
    assert (row.rounds, row.verdict) == (0, "open") and not list(tmp_path.iterdir())


def test_a_round_reads_what_the_round_before_wrote(spark, tmp_path):
    work = work_of(spark, [("never", "key-never", "key-never")])
    ask = stages.ask_function(counting_client(str(tmp_path)), 1)
    rows = accept.backfeed_until(work, ask, F.lit(False), 3)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Join" not in plan
