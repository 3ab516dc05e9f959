"""The log's lookups and text steps as functions of SQL, over the views of ``tables.create_views``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from runloom.functions.text import SCRIPT_END, SCRIPT_START
from runloom.schemas import BACKFEED_PAYLOAD, RUN_KEY, RUN_LOG

KEY = ", ".join(RUN_KEY)
KEY_PARAMETERS = "srs string, provider string, model string, degrees double"
OF_KEY = "srs_id = srs and llm_provider = provider and llm_model = model and temperature = degrees"


def create_functions(
    spark: SparkSession, log: str = "usage_logs", payload: Sequence[str] = tuple(BACKFEED_PAYLOAD)
) -> None:
    """Temporary functions over the view ``log``; they become part of the plan of whoever calls them.

    ``runs_of(srs, provider, model, degrees)``: id, time and payload of all runs of a key.
    ``latest_run_of(...)``: the newest of them, the larger id among equally new ones; no row without one.
    A rank within the key, so that it can be asked for one key, whose filter goes below the rank, and
    as ``LATERAL`` for a table of keys, where ranks are limited before anything moves.
    ``extract_script(reply)``: from the first start marker to the last end marker, or the empty text.
    ``improvement_label(earlier_runs)``: the event type of a back-feed run.
    """
    names = ["id", "created_at", *payload]
    columns = ", ".join(f"{name} {RUN_LOG[name].dataType.simpleString()}" for name in names)
    listed = ", ".join(names)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION runs_of({KEY_PARAMETERS}) RETURNS TABLE ({columns})
        RETURN SELECT {listed} FROM {log} WHERE {OF_KEY}"""
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION latest_run_of({KEY_PARAMETERS}) RETURNS TABLE ({columns})
        RETURN SELECT {listed} FROM (
            SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY created_at DESC, id DESC) AS newest FROM {log})
        WHERE newest = 1 AND {OF_KEY}"""
    )
    stop = f"length(reply) - length(substring_index(reply, '{SCRIPT_END}', -1))"
    start = f"locate('{SCRIPT_START}', reply)"
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION extract_script(reply string) RETURNS string
        RETURN CASE WHEN contains(reply, '{SCRIPT_END}') AND {start} > 0 AND {stop} > {start}
            THEN substr(reply, {start}, {stop} - {start} + 1) ELSE '' END"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION improvement_label(earlier_runs bigint) RETURNS string
        RETURN concat('BACKFEED_IMPROVEMENT_', cast(earlier_runs as string))"""
    )
