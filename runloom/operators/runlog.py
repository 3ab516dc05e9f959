"""Run-log operators: latest run, iterations, facets, comparison, reshaping.

The log is wide and its text and image columns are large. What only groups or counts
works on key, time and id alone. Where payload is wanted, runs are ranked by key and the
rank is limited before the exchange, so that at most one run per key and map task moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions.text import improvement_label
from runloom.operators.numbering import positions
from runloom.schemas import BACKFEED_PAYLOAD, COMPARED, FLOWS, RUN_KEY, RUN_LOG

_MICROS = "decimal(19,0)"


def has_key() -> Column:
    """True when no part of the run key is NULL; a NULL part matches nothing."""
    return (
        F.col("srs_id").isNotNull()
        & F.col("llm_provider").isNotNull()
        & F.col("llm_model").isNotNull()
        & F.col("temperature").isNotNull()
    )


def recency() -> Column:
    """created_at and id as one ordered number, the id breaking ties.

    A struct would order the same way but its aggregation buffer is not fixed-size,
    which turns the hash aggregate into a sort of the whole log.
    """
    micros = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(2**62)))
    scale = F.lit("10000000000000000000").cast("decimal(20,0)")
    return micros.cast(_MICROS) * scale + F.col("id").cast(_MICROS)


def rows_of_key(
    log: DataFrame, srs_id: str, provider: str, model: str, temperature: float
) -> DataFrame:
    """All runs of one key."""
    return log.where(
        (F.col("srs_id") == srs_id)
        & (F.col("llm_provider") == provider)
        & (F.col("llm_model") == model)
        & (F.col("temperature") == float(temperature))
    )


def latest_of_key(
    log: DataFrame, srs_id: str, provider: str, model: str, temperature: float
) -> DataFrame:
    """The newest run of one key, at most one row."""
    rows = rows_of_key(log, srs_id, provider, model, temperature)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def latest_ids(log: DataFrame) -> DataFrame:
    """(run key, run_count, id): how many runs each key has and which is the newest."""
    return (
        log.where(has_key())
        .groupBy(*RUN_KEY)
        .agg(F.count("*").alias("run_count"), F.max_by("id", recency()).alias("id"))
    )


def newest_payload(
    log: DataFrame, payload: Sequence[str], key: Sequence[str] = tuple(RUN_KEY)
) -> DataFrame:
    """(id, payload) of the newest run of every key; the others' payload stays where it is."""
    newest = Window.partitionBy(*key).orderBy(F.desc("created_at"), F.desc("id"))
    names = dict.fromkeys([*key, "id", "created_at", *payload])
    return (
        log.where(has_key())
        .select(*names)
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") == 1)
        .select("id", *payload)
    )


def latest_runs(log: DataFrame, payload: Sequence[str] = tuple(BACKFEED_PAYLOAD)) -> DataFrame:
    """The newest run of every key with its payload columns and the key's number of runs."""
    return latest_ids(log).join(newest_payload(log, payload), "id")


def latest_runs_by_rank(
    log: DataFrame, payload: Sequence[str] = tuple(BACKFEED_PAYLOAD)
) -> DataFrame:
    """The same rows by ranking; the rank limit keeps one row per key and map task."""
    newest = Window.partitionBy(*RUN_KEY).orderBy(F.desc("created_at"), F.desc("id"))
    return (
        log.where(has_key())
        .select("id", *RUN_KEY, "created_at", *payload)
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def _requested(keys: DataFrame, log: DataFrame) -> DataFrame:
    """(run key, run_count, id) of every distinct requested key; id is NULL without a run.

    Requests and runs are stacked and grouped once instead of being joined: one
    exchange, combined map-side, so neither side may have a hot key that hurts.
    """
    wanted = keys.select(
        *RUN_KEY,
        F.lit(True).alias("_wanted"),
        F.lit(None).cast("long").alias("id"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )
    runs = log.where(has_key()).select(
        *RUN_KEY, F.lit(None).cast("boolean").alias("_wanted"), "id", "created_at"
    )
    return (
        wanted.unionByName(runs)
        .groupBy(*RUN_KEY)
        .agg(
            F.max("_wanted").alias("_wanted"),
            F.count("id").alias("run_count"),
            F.max_by("id", recency()).alias("id"),
        )
        .where(F.col("_wanted"))
        .drop("_wanted")
    )


def lookup_latest(
    keys: DataFrame, log: DataFrame, payload: Sequence[str] = tuple(BACKFEED_PAYLOAD)
) -> DataFrame:
    """Every distinct requested key with its newest run; NULLs and 0 without one.

    Keys without a run take a branch of their own, or they would all travel to the
    payload join under the same NULL id.
    """
    latest = _requested(keys, log)
    found = latest.where(F.col("id").isNotNull()).join(newest_payload(log, payload), "id")
    missing = latest.where(F.col("id").isNull())
    return found.unionByName(missing, allowMissingColumns=True)


def backfeed_work(
    keys: DataFrame, log: DataFrame, payload: Sequence[str] = tuple(BACKFEED_PAYLOAD)
) -> DataFrame:
    """Requested keys that have a newest run with an original text."""
    texts = newest_payload(log, payload).where(F.col("original_srs_text").isNotNull())
    return _requested(keys, log).join(texts, "id")


def iteration_labels(log: DataFrame) -> DataFrame:
    """(run key, id, earlier_runs, label) for every run with a key."""
    numbered = positions(log.where(has_key()), "id", ["created_at"], RUN_KEY)
    return numbered.select(
        *RUN_KEY,
        "id",
        F.col("position").alias("earlier_runs"),
        F.when(F.col("position") == 0, "FIRST_PASS")
        .otherwise(improvement_label(F.col("position")))
        .alias("label"),
    )


def distinct_ids(log: DataFrame) -> DataFrame:
    """Distinct ``srs_id`` values, NULL kept as one and first."""
    return log.select("srs_id").distinct().orderBy(F.asc_nulls_first("srs_id"))


def facets(log: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(srs_id, facet, value, number): the distinct values per id, NULL included.

    Long form throughout: a set of values is never folded into one cell. ``number``
    carries the temperature so that it sorts as one.
    """
    rows = log.where(F.col("srs_id").isNotNull())
    if ids is not None:
        rows = rows.join(ids, "srs_id", "left_semi")
    no_number = "cast(null as double)"
    return rows.selectExpr(
        "srs_id",
        f"stack(4, 'llm_provider', llm_provider, {no_number}, 'llm_model', llm_model, {no_number}, "
        "'temperature', cast(temperature as string), temperature, "
        f"'event_type', event_type, {no_number}) as (facet, value, number)",
    ).distinct()


def facets_in_order(found: DataFrame) -> DataFrame:
    return found.orderBy(
        "srs_id", "facet", F.asc_nulls_first("number"), F.asc_nulls_first("value")
    )


def side_by_side(
    log: DataFrame,
    left_event: str,
    right_event: str,
    payload: Sequence[str] = tuple(COMPARED),
    how: str = "inner",
) -> DataFrame:
    """Per run key the newest run of two event types, columns suffixed _left and _right.

    One aggregate picks both ids; each event type's newest payload is ranked by itself, with
    the event filter pushed into its scan. ``how`` is ``inner`` or ``full``.
    """

    def newest(event: str, name: str) -> Column:
        return F.max_by("id", F.when(F.col("event_type") == event, recency())).alias(name)

    picked = (
        log.where(has_key() & F.col("event_type").isin(left_event, right_event))
        .groupBy(*RUN_KEY)
        .agg(newest(left_event, "id_left"), newest(right_event, "id_right"))
    )

    def side(event: str, suffix: str) -> DataFrame:
        return newest_payload(log.where(F.col("event_type") == event), payload).select(
            F.col("id").alias(f"id_{suffix}"),
            *[F.col(name).alias(f"{name}_{suffix}") for name in payload],
        )

    left, right = side(left_event, "left"), side(right_event, "right")
    if how == "inner":
        both = picked.where(F.col("id_left").isNotNull() & F.col("id_right").isNotNull())
        return both.join(left, "id_left").join(right, "id_right")
    # Keys with one side only would meet under a NULL id, so each side is fetched alone.
    found_left = picked.select(*RUN_KEY, "id_left").join(left, "id_left")
    found_right = picked.select(*RUN_KEY, "id_right").join(right, "id_right")
    return found_left.join(found_right, RUN_KEY, how)


def image_lookup(log: DataFrame, ids: DataFrame, flow: str = "orig") -> DataFrame:
    """(id, status, n_bytes, image) for every distinct requested id.

    The images meet the ids in an inner join first, where a small id table can be
    broadcast; an outer join alone would always move every image of the log.
    """
    asked = ids.select("id").distinct()
    image = F.col(f"uml_image_data_{flow}_srs").alias("image")
    found = log.select("id", F.lit(True).alias("_found"), image).join(asked, "id")
    return asked.join(found, "id", "left").select(
        "id",
        F.when(F.col("_found").isNull(), "not_found")
        .when(F.col("image").isNull(), "null_image")
        .otherwise("ok")
        .alias("status"),
        F.octet_length("image").cast("long").alias("n_bytes"),
        "image",
    )


# What each column of a flow is called once the flow is a row of its own.
_SHORT = {
    "srs_text": "text",
    "plantuml_script": "script",
    "similarity_score": "score",
    "extracted_uml_descr": "description",
    "similarity_descr": "analysis",
    "uml_image_data": "image",
}
FLOW_FIELDS = list(_SHORT.values())


def _flow_columns(flow: str) -> list[str]:
    """The log's columns of one flow, in the order of ``FLOW_FIELDS``."""
    prefix = {"orig": "original", "dist": "distilled"}[flow]
    names = {
        name.removeprefix(f"{prefix}_").removesuffix(f"_{flow}_srs"): name
        for name in RUN_LOG.names
        if name.startswith(f"{prefix}_") or name.endswith(f"_{flow}_srs")
    }
    return [names[long] for long in _SHORT]


def to_flows(log: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Wide to long: two rows per run, one per flow."""
    cells = ", ".join(f"'{flow}', " + ", ".join(_flow_columns(flow)) for flow in FLOWS)
    names = ", ".join(["flow", *FLOW_FIELDS])
    return log.selectExpr(*keep, f"stack({len(FLOWS)}, {cells}) as ({names})")


def from_flows(flows: DataFrame, row_id: str = "id") -> DataFrame:
    """Long to wide: one row per run with both flows' columns."""
    wide = (
        flows.groupBy(row_id)
        .pivot("flow", FLOWS)
        .agg(*[F.first(name, ignorenulls=True).alias(name) for name in FLOW_FIELDS])
    )
    renamed = [
        F.col(f"{flow}_{field}").alias(name)
        for flow in FLOWS
        for field, name in zip(FLOW_FIELDS, _flow_columns(flow))
    ]
    return wide.select(row_id, *renamed)


def accept_split(runs: DataFrame, accepted: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, to back-feed) by the user's condition; NULL goes to back-feed."""
    verdict = F.coalesce(accepted, F.lit(False))
    return runs.where(verdict), runs.where(~verdict)
