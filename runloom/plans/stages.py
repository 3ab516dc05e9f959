"""The stages shared by first pass and back-feed: reply -> script -> report -> state."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.report import DESCRIPTION, SCORE, analysis_text, parse_report
from runloom.functions.text import extract_script, is_blank, is_failure
from runloom.operators.completion import Complete, complete
from runloom.schemas import FLOWS, RUN_KEY, RUN_LOG
from runloom.session import durable

# Adds reply_{name} columns for the given prompts.
Ask = Callable[[DataFrame, Mapping[str, Column]], DataFrame]

TEXT_OF = {"orig": "original_srs_text", "dist": "distilled_srs_text"}


def ask_recorded(runs: DataFrame, prompts: Mapping[str, Column]) -> DataFrame:
    """The replies are columns already; the prompts are not evaluated."""
    absent = [f"reply_{name}" for name in prompts if f"reply_{name}" not in runs.columns]
    return runs.withColumns({name: F.lit(None).cast("string") for name in absent})


def ask_function(make_client: Callable[[], Complete], calls: int | None = None) -> Ask:
    """Ask the user's function; its answers are written down before anyone reads them."""

    def ask(runs: DataFrame, prompts: Mapping[str, Column]) -> DataFrame:
        return durable(complete(runs, prompts, make_client, calls))

    return ask


def usable(reply: str) -> Column:
    """The reply's text where it is an answer, else NULL."""
    return F.when(~is_failure(F.col(reply)), F.col(reply))


def with_script(runs: DataFrame, flow: str) -> DataFrame:
    """Add ``plantuml_script_{flow}_srs``; the empty text without a usable script."""
    script = F.coalesce(extract_script(usable(f"reply_generate_{flow}")), F.lit(""))
    return runs.withColumn(f"plantuml_script_{flow}_srs", script)


def ready(flow: str) -> Column:
    """Text and script are both there, so the flow can be scored."""
    text, script = F.col(TEXT_OF[flow]), F.col(f"plantuml_script_{flow}_srs")
    return F.coalesce((text != "") & (script != ""), F.lit(False))


def when_ready(flow: str, prompt: Column) -> Column:
    return F.when(ready(flow), prompt)


def with_report(runs: DataFrame, flow: str) -> DataFrame:
    """Add the flow's report columns and ``state_{flow}``, the reason why a flow failed."""
    similarity = F.col(f"reply_similarity_{flow}")
    generated = F.col(f"reply_generate_{flow}")
    report = F.col("_report")
    state = (
        F.when(is_blank(F.col(TEXT_OF[flow])), "blank_text")
        .when(generated.isNull(), "pending")
        .when(is_failure(generated), "failed_response")
        .when(F.col(f"plantuml_script_{flow}_srs") == "", "no_script")
        .when(similarity.isNull(), "pending")
        .when(is_failure(similarity), "failed_response")
        .when(~report["ok"], "rejected_report")
        .otherwise("ok")
    )
    added = {
        f"extracted_uml_descr_{flow}_srs": report[DESCRIPTION],
        f"similarity_score_{flow}_srs": report[SCORE],
        f"similarity_descr_{flow}_srs": analysis_text(report),
        f"state_{flow}": state,
    }
    parsed = parse_report(runs, usable(f"reply_similarity_{flow}"), "_report")
    return parsed.select(
        *[name for name in runs.columns if name not in added],
        *[column.alias(name) for name, column in added.items()],
    )


def chat_of_run() -> Column:
    """The run's chat: a (user, assistant) pair per flow with a text, orig before dist."""
    pairs = F.array(
        *[
            F.struct(
                F.col(TEXT_OF[flow]).alias("user"),
                F.coalesce(F.col(f"reply_generate_{flow}"), F.lit("")).alias("assistant"),
            )
            for flow in FLOWS
        ]
    )
    return F.filter(pairs, lambda pair: ~is_blank(pair["user"]))


def with_images(runs: DataFrame) -> DataFrame:
    """Rendered images are input; a run without them is logged with NULL."""
    absent = [f"uml_image_data_{flow}_srs" for flow in FLOWS]
    return runs.withColumns(
        {name: F.lit(None).cast("binary") for name in absent if name not in runs.columns}
    )


def done() -> Column:
    return (F.col("state_orig") == "ok") & (F.col("state_dist") == "ok")


def log_rows(results: DataFrame) -> DataFrame:
    """The rows to append, with a ``run_id`` to order them by: both flows came through.

    The id is a digest of the run key in which NULL parts and separators inside parts count.
    """
    names = [field.name for field in RUN_LOG if field.name not in ("id", "created_at")]
    parts = [
        F.coalesce(F.concat(F.length(part), F.lit(":"), part), F.lit("-"))
        for part in (F.col(name).cast("string") for name in RUN_KEY)
    ]
    run_id = F.sha2(F.concat(*parts), 256)
    return with_images(results).where(done()).select(run_id.alias("run_id"), *names)


def rejects(results: DataFrame) -> DataFrame:
    """The other runs with the state of both flows and the raw replies."""
    return results.where(~done())
