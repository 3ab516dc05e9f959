"""Back-feed: the newest run of a key -> new scripts -> one numbered improvement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions import prompts
from runloom.functions.text import improvement_label, is_blank
from runloom.operators.catalog import Model, effective_temperature, resolve_api
from runloom.operators.completion import attach_recorded
from runloom.operators.runlog import backfeed_work
from runloom.plans.stages import (
    TEXT_OF,
    Ask,
    ask_recorded,
    chat_of_run,
    when_ready,
    with_report,
    with_script,
)
from runloom.schemas import FLOWS

ASKED = ["generate_orig", "generate_dist", "similarity_orig", "similarity_dist"]


def work_list(keys: DataFrame, log: DataFrame, models: Sequence[Model]) -> DataFrame:
    """Requested keys, at their effective temperature, with their newest run."""
    work = backfeed_work(effective_temperature(keys, models), log)
    return resolve_api(work, models)


def backfeed(work: DataFrame, ask: Ask = ask_recorded) -> DataFrame:
    """Work rows to result rows labelled with the number of runs before them.

    Four requests per run in two rounds. Both texts are carried over unchanged.
    """
    runs = ask(
        work,
        {
            f"generate_{flow}": F.when(
                ~is_blank(F.col(TEXT_OF[flow])),
                prompts.regenerate(
                    flow,
                    F.col(TEXT_OF[flow]),
                    F.col(f"plantuml_script_{flow}_srs"),
                    F.col(f"similarity_descr_{flow}_srs"),
                ),
            )
            for flow in FLOWS
        },
    )
    for flow in FLOWS:
        runs = with_script(runs, flow)
    runs = ask(
        runs,
        {
            f"similarity_{flow}": when_ready(
                flow,
                prompts.similarity(F.col(f"plantuml_script_{flow}_srs"), F.col(TEXT_OF[flow])),
            )
            for flow in FLOWS
        },
    )
    for flow in FLOWS:
        runs = with_report(runs, flow)
    return runs.withColumns(
        {"event_type": improvement_label(F.col("run_count")), "chat": chat_of_run()}
    )


def backfeed_recorded(
    keys: DataFrame, log: DataFrame, responses: DataFrame, models: Sequence[Model]
) -> DataFrame:
    """Back-feed against a table of recorded responses."""
    return backfeed(attach_recorded(work_list(keys, log, models), responses, ASKED))
