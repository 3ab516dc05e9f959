"""One stage of one flow, each logged under its own event type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.text import extract_script, is_blank
from runloom.plans.stages import TEXT_OF
from runloom.schemas import RUN_LOG

# Event types per stage and flow.
EVENT_TYPES = {
    ("distil", "orig"): "DISTILL_SRS",
    ("render", "orig"): "GENERATE_UML_ORIG",
    ("render", "dist"): "GENERATE_UML_DIST",
    ("similarity", "orig"): "CHECK_SIMILARITY_ORIG",
    ("similarity", "dist"): "CHECK_SIMILARITY_DIST",
    ("generate", "orig"): "ALL_IN_ONE_ORIG_SRS",
    ("generate", "dist"): "ALL_IN_ONE_DIST_SRS",
}

_CALL = ["llm_provider", "llm_model", "temperature"]


def event_type(stage: Column, flow: Column) -> Column:
    """The event type of a (stage, flow) pair; NULL for any other pair."""
    tag = F.lit(None).cast("string")
    for (stage_name, flow_name), event in reversed(EVENT_TYPES.items()):
        tag = F.when((stage == stage_name) & (flow == flow_name), event).otherwise(tag)
    return tag


def _as_log_rows(df: DataFrame, stage: str, flow: str, filled: dict[str, Column]) -> DataFrame:
    """Log rows with exactly the given columns filled and all others NULL."""
    return df.select(
        *[
            (
                F.lit(EVENT_TYPES[stage, flow])
                if field.name == "event_type"
                else filled.get(field.name, F.lit(None).cast(field.dataType))
            ).alias(field.name)
            for field in RUN_LOG
            if field.name not in ("id", "created_at")
        ]
    )


def _call() -> dict[str, Column]:
    return {name: F.col(name) for name in _CALL}


def generate_only(df: DataFrame, flow: str) -> DataFrame:
    """(call, text, response) -> script rows; blank texts are skipped."""
    text = TEXT_OF[flow]
    script = extract_script(F.col("response"))
    return _as_log_rows(
        df.where(~is_blank(F.col("text"))),
        "generate",
        flow,
        {**_call(), text: F.col("text"), f"plantuml_script_{flow}_srs": script},
    )


def distil_only(df: DataFrame) -> DataFrame:
    """(call, text, response) -> distilled-text rows."""
    filled = {"original_srs_text": F.col("text"), "distilled_srs_text": F.col("response")}
    return _as_log_rows(df, "distil", "orig", {**_call(), **filled})


def scoring_ready() -> Column:
    """Text and script are both present."""
    return F.coalesce((F.col("text") != "") & (F.col("script") != ""), F.lit(False))


def similarity_only(df: DataFrame, flow: str) -> DataFrame:
    """(call, text, script, response) -> rows with the raw similarity reply."""
    return _as_log_rows(
        df.where(scoring_ready()),
        "similarity",
        flow,
        {
            **_call(),
            TEXT_OF[flow]: F.col("text"),
            f"plantuml_script_{flow}_srs": F.col("script"),
            f"similarity_descr_{flow}_srs": F.col("response"),
        },
    )


def render_only(df: DataFrame, flow: str) -> DataFrame:
    """(script, image) -> rows with a rendered diagram; blank scripts are skipped."""
    return _as_log_rows(
        df.where(~is_blank(F.col("script"))),
        "render",
        flow,
        {
            f"plantuml_script_{flow}_srs": F.col("script"),
            f"uml_image_data_{flow}_srs": F.col("image"),
        },
    )
