"""Column layouts of the stored tables. Always explicit, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Table and column names of the stored corpus and run log.
CORPUS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("srs_origin", T.StringType()),
        T.StructField("srs_title", T.StringType()),
        T.StructField("srs_content", T.StringType()),
    ]
)

RUN_LOG = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("llm_provider", T.StringType()),
        T.StructField("llm_model", T.StringType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("srs_id", T.StringType()),
        T.StructField("original_srs_text", T.StringType()),
        T.StructField("distilled_srs_text", T.StringType()),
        T.StructField("similarity_score_orig_srs", T.DoubleType()),
        T.StructField("uml_image_data_orig_srs", T.BinaryType()),
        T.StructField("plantuml_script_orig_srs", T.StringType()),
        T.StructField("extracted_uml_descr_orig_srs", T.StringType()),
        T.StructField("similarity_descr_orig_srs", T.StringType()),
        T.StructField("similarity_score_dist_srs", T.DoubleType()),
        T.StructField("uml_image_data_dist_srs", T.BinaryType()),
        T.StructField("plantuml_script_dist_srs", T.StringType()),
        T.StructField("extracted_uml_descr_dist_srs", T.StringType()),
        T.StructField("similarity_descr_dist_srs", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

CORPUS_KEY = ["srs_origin", "srs_title", "srs_content"]
RUN_KEY = ["srs_id", "llm_provider", "llm_model", "temperature"]
FLOWS = ["orig", "dist"]


def _among(*kinds: str) -> list[str]:
    """The log's columns whose names contain one of ``kinds``, in the log's order."""
    return [name for name in RUN_LOG.names if any(kind in name for kind in kinds)]


# What a back-feed reads from the latest run of a key: texts, scripts and findings.
BACKFEED_PAYLOAD = _among("srs_text", "plantuml_script", "similarity_descr")

# What the side-by-side view shows of a run: scores, images and findings.
COMPARED = _among("similarity_score", "uml_image", "similarity_descr")
