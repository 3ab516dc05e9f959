from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from runloom.operators.catalog import Model, fan_out
from runloom.operators import completion
from runloom.operators.completion import complete, match_responses
from runloom.operators.runlog import latest_ids
from runloom.plans import backfeed, first_pass, single_flow, stages
from runloom.schemas import RUN_KEY
from runloom.sources import tables
from tests.check import TABLES
from tests.helpers import column, one, plan_of
from workloads import queries

MODELS = (Model("p", "m", "api"), Model("p", "fixed", "api-f", 1.0))
DOCS = "id long, srs_title string, srs_content string"
RESPONSES = "srs_id string, llm_provider string, llm_model string, temperature double, stage string, flow string, response string"
REPORT = json.dumps({"similarity_score": 80, "discrepancies": ["d"]})
GOOD = {
    ("generate", "orig"): "x @startuml A @enduml y",
    ("distil", "orig"): "short",
    ("similarity", "orig"): f"```json\n{REPORT}\n```",
    ("generate", "dist"): "@startuml B @enduml",
    ("similarity", "dist"): REPORT,
}


def run_with(spark, **changes):
    """One document, one model, the good replies with some changed or taken out."""
    replies = {f"{stage}_{flow}": text for (stage, flow), text in GOOD.items()} | changes
    rows = [("1_t", "p", "m", 0.5, *name.split("_"), text) for name, text in replies.items() if text is not None]
    docs = spark.createDataFrame([(1, "t", "text")], DOCS)
    return first_pass.first_pass_recorded(docs, spark.createDataFrame(rows, RESPONSES), MODELS[:1], 0.5)


def test_first_pass_fills_the_log_row(spark):
    row = one(stages.log_rows(run_with(spark)))
    assert (row.event_type, row.srs_id, row.temperature) == ("FIRST_PASS", "1_t", 0.5)
    assert (row.original_srs_text, row.distilled_srs_text) == ("text", "short")
    assert (row.plantuml_script_orig_srs, row.plantuml_script_dist_srs) == ("@startuml A @enduml", "@startuml B @enduml")
    assert row.similarity_score_orig_srs == row.similarity_score_dist_srs == 80.0
    assert row.similarity_descr_orig_srs.startswith("discrepancies:\nd\n\nmissing_elements:\n")
    assert row.uml_image_data_orig_srs is None


def test_several_recorded_answers(spark):
    docs = spark.createDataFrame([(1, "t", "text")], DOCS)
    rows = [("1_t", "p", "m", 0.5, *name, text) for name, text in GOOD.items()]
    again = [("1_t", "p", "m", 0.5, "distil", "orig", "older")]

    def state(rows, schema):
        responses = spark.createDataFrame(rows, schema)
        return one(first_pass.first_pass_recorded(docs, responses, MODELS[:1], 0.5))

    assert state(rows + again, RESPONSES).state_dist == "failed_response"
    assert state(rows + rows, RESPONSES).state_dist == "ok"
    timed = [(*row, "2024-02-01") for row in rows] + [(*row, "2024-01-01") for row in again]
    assert state(timed, RESPONSES + ", recorded_at string").distilled_srs_text == "short"


def test_texts_move_before_the_fan_out_only(spark):
    docs = spark.createDataFrame([(1, "t", "text")], DOCS)
    responses = spark.createDataFrame([], RESPONSES)
    results = first_pass.first_pass_recorded(docs, responses, MODELS, 0.5)
    above = plan_of(results).split("Generate explode")[0]
    assert "Exchange" not in above and "Join" not in above


def test_run_ids_tell_keys_apart(spark):
    keys = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("", "x")]
    good = run_with(spark).withColumn("state_orig", F.lit("ok")).withColumn("state_dist", F.lit("ok"))
    ids = {
        one(stages.log_rows(good.withColumns({"srs_id": F.lit(a).cast("string"), "llm_provider": F.lit(b)}))).run_id
        for a, b in keys
    }
    assert len(ids) == 4


def test_chat_continues_from_orig_to_dist(spark):
    chat = one(run_with(spark)).chat
    assert [tuple(pair) for pair in chat] == [
        ("text", "x @startuml A @enduml y"), ("short", "@startuml B @enduml"),
    ]


def test_chat_leaves_out_a_flow_without_text(spark):
    assert [pair.user for pair in one(run_with(spark, distil_orig=" ")).chat] == ["text"]
    assert [pair.user for pair in one(run_with(spark, distil_orig=None)).chat] == ["text"]


@pytest.mark.parametrize(
    ("changes", "orig", "dist"),
    [
        ({"generate_orig": "no marker"}, "no_script", "ok"),
        ({"generate_orig": None}, "pending", "ok"),
        ({"generate_orig": "[Error] key"}, "failed_response", "ok"),
        ({"similarity_orig": "[1]"}, "rejected_report", "ok"),
        ({"similarity_orig": "[Error] key"}, "failed_response", "ok"),
        ({"similarity_orig": None}, "pending", "ok"),
        ({"similarity_orig": "{}"}, "ok", "ok"),
        ({"distil_orig": None}, "ok", "pending"),
        ({"distil_orig": "Error processing p request: x"}, "ok", "failed_response"),
        ({"distil_orig": " \n"}, "ok", "blank_text"),
        ({"similarity_dist": "thanks"}, "ok", "rejected_report"),
    ],
)
def test_states_and_rejects(spark, changes, orig, dist):
    results = run_with(spark, **changes)
    row = one(results)
    assert (row.state_orig, row.state_dist) == (orig, dist)
    logged = 1 if (orig, dist) == ("ok", "ok") else 0
    assert stages.log_rows(results).count() == logged
    assert stages.rejects(results).count() == 1 - logged


def client():
    def answer(prompt, api_id, temperature):
        if "fail" in prompt:
            raise ValueError("boom")
        if "similarity_score" in prompt:
            return json.dumps({"similarity_score": temperature, "missing_elements": [api_id]})
        if "First line: @startuml" in prompt:
            return f"@startuml\n{'again' if 'Input C' in prompt else 'first'}\n@enduml"
        return "core"

    return answer


def test_first_pass_then_two_backfeeds(spark, tmp_path):
    root = str(tmp_path / "root")
    tables.ensure_tables(spark, root)
    docs = spark.createDataFrame([(1, "a b", "text"), (2, "t", "please fail"), (3, "t", " ")], DOCS)
    ask = stages.ask_function(client, calls=2)
    results = first_pass.batch(docs, ask, models=MODELS, temperature=0.5)
    assert set(column(results, "srs_id")) == {"1_ab", "2_t"}
    tables.append_runs(spark, stages.log_rows(results), root, "run_id")
    failed = stages.rejects(results).select("state_orig", "reply_generate_orig").distinct().collect()
    assert [tuple(row) for row in failed] == [("failed_response", "Error processing p request: boom")]

    keys = fan_out(docs, MODELS, 0.5).select(*[c for c in RUN_KEY if c != "temperature"], F.lit(0.5).alias("temperature"))
    for turn in (1, 2):
        work = backfeed.work_list(keys, tables.run_log(spark, root), MODELS)
        improved = backfeed.backfeed(work, ask)
        assert set(column(improved, "event_type")) == {f"BACKFEED_IMPROVEMENT_{turn}"}
        tables.append_runs(spark, stages.log_rows(improved), root, "run_id")
    log = tables.run_log(spark, root)
    assert sorted(column(log, "id")) == [1, 2, 3, 4, 5, 6]
    counts = latest_ids(log).collect()
    assert {(r.llm_model, r.temperature, r.run_count) for r in counts} == {("m", 0.5, 3), ("fixed", 1.0, 3)}
    last = log.orderBy(F.desc("id")).first()
    assert last.plantuml_script_orig_srs == "@startuml\nagain\n@enduml"
    assert (last.original_srs_text, last.distilled_srs_text) == ("text", "core")


def test_backfeed_skips_a_missing_distilled_text(spark):
    work = spark.createDataFrame(
        [("1_t", "p", "m", 0.5, 4, 9, "text", None, "s", "s", "a", "a", "api")],
        "srs_id string, llm_provider string, llm_model string, temperature double, run_count long, id long, "
        "original_srs_text string, distilled_srs_text string, plantuml_script_orig_srs string, "
        "plantuml_script_dist_srs string, similarity_descr_orig_srs string, similarity_descr_dist_srs string, "
        "api_id string",
    )
    row = one(backfeed.backfeed(work, stages.ask_function(client)))
    assert (row.event_type, row.state_orig, row.state_dist) == ("BACKFEED_IMPROVEMENT_4", "ok", "blank_text")


def test_each_prompt_is_asked_once(spark, tmp_path):
    seen = str(tmp_path)

    def counting():
        def answer(prompt, api_id, temperature):
            fd = os.open(f"{seen}/{api_id}", os.O_APPEND | os.O_CREAT | os.O_WRONLY)
            os.write(fd, b"x")
            os.close(fd)
            return client()(prompt, api_id, temperature)

        return answer

    docs = spark.createDataFrame([(1, "a", "text"), (2, "b", "text")], DOCS)
    results = first_pass.batch(docs, stages.ask_function(counting), models=MODELS)
    stages.log_rows(results).count()
    stages.rejects(results).count()
    assert {name: os.path.getsize(f"{seen}/{name}") for name in os.listdir(seen)} == {"api": 10, "api-f": 10}


def test_completion_keeps_lookup_errors(spark):
    rows = spark.createDataFrame(
        [("hi", None), ("hi", "[Error] Unknown provider: z"), (None, "[Error] x")], "q string, lookup_error string"
    ).withColumns({"llm_provider": F.lit("p"), "api_id": F.lit("a"), "temperature": F.lit(0.5)})
    found = complete(rows, {"q": F.col("q")}, lambda: lambda prompt, api, temperature: prompt.upper())
    assert column(found, "reply_q") == ["HI", "[Error] Unknown provider: z", None]


def test_match_responses(spark):
    requests = spark.createDataFrame([("a",), ("b",), ("c",)], "request_id string")
    answers = spark.createDataFrame([("a", "fine"), ("b", "[Error] x"), ("z", "other")], "request_id string, response string")
    found = {r.request_id: r.response_status for r in match_responses(requests, answers).collect()}
    assert found == {"a": "ok", "b": "error", "c": "pending"}


CALL = "llm_provider string, llm_model string, temperature double, text string, script string, response string"


def filled(row):
    return {name for name, value in row.asDict().items() if value is not None}


def test_single_flow_rows_fill_only_their_columns(spark):
    call = {"event_type", "llm_provider", "llm_model", "temperature"}
    rows = spark.createDataFrame([("p", "m", 0.5, "t", "s", "@startuml @enduml"), ("p", "m", 0.5, " ", "", "x")], CALL)
    row = one(single_flow.generate_only(rows, "dist"))
    assert row.event_type == "ALL_IN_ONE_DIST_SRS"
    assert filled(row) == call | {"distilled_srs_text", "plantuml_script_dist_srs"}
    row = one(single_flow.similarity_only(rows, "orig"))
    assert row.event_type == "CHECK_SIMILARITY_ORIG"
    assert filled(row) == call | {"original_srs_text", "plantuml_script_orig_srs", "similarity_descr_orig_srs"}
    row = single_flow.distil_only(rows).first()
    assert row.event_type == "DISTILL_SRS"
    assert filled(row) == call | {"original_srs_text", "distilled_srs_text"}
    images = rows.withColumn("image", F.lit(b"png"))
    row = one(single_flow.render_only(images, "orig"))
    assert row.event_type == "GENERATE_UML_ORIG"
    assert filled(row) == {"event_type", "plantuml_script_orig_srs", "uml_image_data_orig_srs"}


def test_recorded_answers_are_reduced_before_they_are_gathered(spark):
    from runloom.operators.completion import gather_recorded
    from runloom.operators.catalog import is_run_of

    model = MODELS[0]
    row = ("s", model.provider, model.model, 0.5, "distil", "orig")
    rows = [(*row, f"answer {k}", f"2024-01-01 00:{k:02d}:00") for k in range(50)]
    rows += [("s", "nobody", "nothing", 0.5, "distil", "orig", "x", None)]
    rows += [(*row[:3], 0.75, *row[4:], "x", None), (*row[:4], "other", "orig", "x", None), (*row, "old", None)]
    responses = spark.createDataFrame(rows, RESPONSES + ", recorded_at string")
    said = one(gather_recorded(responses, first_pass.ASKED, "srs_id", fits=is_run_of([model], 0.5)))["_said"]
    assert [r["response"] for r in said] == ["answer 49"]
    equal = spark.createDataFrame([(*row, "a"), (*row, "b")], RESPONSES)
    said = one(gather_recorded(equal, first_pass.ASKED, "srs_id"))["_said"]
    assert [r["response"] for r in said] == ["[Error] more than one recorded answer"]


def test_answers_are_not_broadcast_on_an_estimate(spark):
    """An explode makes ten rows of one and is estimated as one."""
    many = spark.range(3).select(F.explode(F.sequence(F.lit(1), F.lit(10))).alias("k"))
    responses = many.select(
        F.col("k").cast("string").alias("srs_id"), F.lit("p").alias("llm_provider"), F.lit("m").alias("llm_model"),
        F.lit(0.5).alias("temperature"), F.lit("generate").alias("stage"), F.lit("orig").alias("flow"),
        F.lit("said").alias("response"),
    )
    work = responses.select("srs_id", "llm_provider", "llm_model", "temperature").distinct()
    found = completion.attach_recorded(work, responses, backfeed.ASKED)
    assert "Broadcast" not in plan_of(found)
    assert set(column(found, "reply_generate_orig")) == {"said"} and found.count() == 10


def test_answers_move_once(spark):
    """One exchange carries answers, in the plans of a first pass and of a back-feed."""
    docs = spark.createDataFrame([(1, "t", "text")], DOCS)
    responses = spark.createDataFrame([], RESPONSES).withColumn("response", F.concat("response", F.lit("!")))
    work = spark.createDataFrame([], "srs_id string, llm_provider string, llm_model string, temperature double")
    for results in (
        first_pass.first_pass_recorded(docs, responses, MODELS, 0.5),
        completion.attach_recorded(work, responses, backfeed.ASKED),
    ):
        above = [line for line in plan_of(results).splitlines()]
        partial = [at for at, line in enumerate(above) if "partial_max" in line]
        assert len(partial) == 1
        exchanges = [at for at, line in enumerate(above) if "Exchange" in line and at < partial[0]]
        depth = lambda at: len(above[at]) - len(above[at].lstrip(" :+-*()0123456789"))
        # Of the exchanges above the answers' aggregate only the one right over it lies on its branch.
        branch, last = [], depth(partial[0])
        for at in reversed(range(partial[0])):
            if depth(at) < last:
                last = depth(at)
                branch.append(at)
        assert len([at for at in exchanges if at in branch]) == 1


@pytest.mark.parametrize("slots", [0, 64])
def test_gathering_by_place_and_in_steps_say_the_same(spark, monkeypatch, slots):
    monkeypatch.setattr(completion, "SLOTS", slots)
    docs = spark.createDataFrame([(1, "t", "text"), (2, "u", "more")], DOCS)
    rows = [
        (f"{i}_{title}", "p", model, degrees, *name, f"{text}", f"2024-01-0{day}")
        for i, title in ((1, "t"), (2, "u"))
        for model, degrees in (("m", 0.5), ("m", 0.7), ("fixed", 1.0), ("other", 0.5))
        for name, text in GOOD.items()
        for day in (1, 2)
    ]
    rows.append(("2_u", "p", "m", 0.5, "distil", "orig", "differs", "2024-01-02"))
    rows.append(("2_u", "p", "m", 0.5, "similarity", "orig", "no time", None))
    responses = spark.createDataFrame(rows, RESPONSES + ", recorded_at string")
    found = {
        (r.srs_id, r.llm_model): (r.state_orig, r.state_dist, r.temperature)
        for r in first_pass.first_pass_recorded(docs, responses, MODELS, 0.5).collect()
    }
    assert found == {
        ("1_t", "m"): ("ok", "ok", 0.5), ("1_t", "fixed"): ("ok", "ok", 1.0),
        ("2_u", "m"): ("ok", "failed_response", 0.5), ("2_u", "fixed"): ("ok", "ok", 1.0),
    }


TABLES_001 = str(TABLES / "sf0.001")


def tasks_of(df):
    return df.select(F.spark_partition_id()).distinct().count()


def test_tasks_follow_the_texts(spark, monkeypatch):
    monkeypatch.setattr(completion, "TASK_BYTES", 1000)
    rows = spark.createDataFrame([("x" * 936,), ("\u00e9" * 468,), (None,)], "text string")
    assert completion.tasks_for(rows, "text", least=1) == 3
    assert completion.tasks_for(rows, "text", least=8) == 8
    assert completion.tasks_for(rows.limit(0), "text", least=2) == 2


def test_a_map_over_documents_has_more_tasks_with_more_text(spark, monkeypatch):
    monkeypatch.setattr(completion, "TASK_BYTES", 1 << 14, raising=False)
    assert tasks_of(queries.completion_map(spark, TABLES_001)) > spark.sparkContext.defaultParallelism


def test_documents_are_spread_before_they_are_fanned_out(spark):
    docs = spark.createDataFrame([(None, "t", f"text {k}") for k in range(64)], DOCS)
    runs = fan_out(docs, MODELS, 0.5, 8)
    plan = plan_of(runs)
    assert plan.index("explode") < plan.index("Exchange") and plan.count("Exchange") == 1
    assert tasks_of(runs) > 4 and runs.count() == 64 * len(MODELS)


def test_the_texts_of_a_first_pass_are_shuffled_once(spark, monkeypatch):
    """All three rounds in one plan: nothing but the spread of the documents is an exchange."""
    monkeypatch.setattr(stages, "durable", lambda df: df)
    plan = plan_of(queries.first_pass_completed(spark, TABLES_001))
    assert plan.count("MapInArrow") == 3 and plan.count("Exchange") == 1
    assert plan.index("explode") < plan.index("Exchange")
