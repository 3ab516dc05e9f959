"""First pass and batch: corpus x catalogue -> one logged run each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions import prompts
from runloom.functions.text import is_blank
from runloom.operators.catalog import DEFAULT_MODELS, Model, documents_to_run, fan_out, is_run_of, runs_of
from runloom.operators.completion import gather_recorded, read_recorded
from runloom.operators.corpus import select_for_batch
from runloom.plans.stages import (
    Ask,
    ask_recorded,
    chat_of_run,
    usable,
    when_ready,
    with_report,
    with_script,
)

ASKED = ["generate_orig", "distil_orig", "similarity_orig", "generate_dist", "similarity_dist"]


def first_pass(runs: DataFrame, ask: Ask = ask_recorded) -> DataFrame:
    """Run rows from ``fan_out`` to result rows with all log columns and flow states.

    Five requests per run in three rounds; a round only waits for what it needs.
    Every round is a narrow step: a run stays one row from fan-out to log row.
    """
    text = F.col("original_srs_text")
    runs = ask(runs, {"generate_orig": prompts.generate(text), "distil_orig": prompts.distil(text)})
    runs = with_script(runs, "orig").withColumn("distilled_srs_text", usable("reply_distil_orig"))
    short = F.col("distilled_srs_text")
    runs = ask(
        runs,
        {
            "similarity_orig": when_ready(
                "orig", prompts.similarity(F.col("plantuml_script_orig_srs"), text)
            ),
            "generate_dist": F.when(~is_blank(short), prompts.generate(short)),
        },
    )
    runs = with_script(runs, "dist")
    runs = ask(
        runs,
        {
            "similarity_dist": when_ready(
                "dist", prompts.similarity(F.col("plantuml_script_dist_srs"), short)
            )
        },
    )
    runs = with_report(with_report(runs, "orig"), "dist")
    # A missing distilled text is not blank: the request failed or is still open.
    distilled = F.col("reply_distil_orig")
    state = (
        F.when(distilled.isNull(), "pending")
        .when(short.isNull(), "failed_response")
        .otherwise(F.col("state_dist"))
    )
    return runs.withColumns(
        {"event_type": F.lit("FIRST_PASS"), "state_dist": state, "chat": chat_of_run()}
    )


def first_pass_recorded(
    corpus: DataFrame, responses: DataFrame, models: Sequence[Model], temperature: float
) -> DataFrame:
    """First pass over a corpus against a table of recorded responses.

    A document meets the answers of all its runs before it is fanned out, so its text moves
    once, however long the catalogue.
    """
    documents = documents_to_run(corpus)
    runs = [
        (m.provider, m.model, temperature if m.fixed_temperature is None else m.fixed_temperature) for m in models
    ]
    answers = gather_recorded(responses, ASKED, "srs_id", fits=is_run_of(models, temperature), runs=runs)
    said = documents.join(answers, "srs_id", "left")
    return first_pass(read_recorded(runs_of(said, models, temperature), ASKED))


def batch(
    corpus: DataFrame,
    ask: Ask,
    ids: Sequence[int] | None = None,
    models: Sequence[Model] = DEFAULT_MODELS,
    temperature: float = 0.5,
) -> DataFrame:
    """First pass over the chosen documents, or over all of them without ids."""
    return first_pass(fan_out(select_for_batch(corpus, ids), models, temperature), ask)


def batch_summary(results: DataFrame) -> DataFrame:
    """What a batch reports per run: scripts, raw similarity replies, distilled text."""
    return results.select(
        "srs_id",
        F.col("llm_provider").alias("provider"),
        F.col("llm_model").alias("model"),
        F.col("plantuml_script_orig_srs").alias("script_orig"),
        F.col("reply_similarity_orig").alias("similarity_orig"),
        F.col("distilled_srs_text").alias("distilled_text"),
        F.col("plantuml_script_dist_srs").alias("script_dist"),
        F.col("reply_similarity_dist").alias("similarity_dist"),
    )

