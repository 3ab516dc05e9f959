"""The newest run of a key as of a time: as-of lookup without a join over ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.operators.numbering import BLOCK_BITS, placed
from runloom.operators.runlog import has_key
from runloom.schemas import BACKFEED_PAYLOAD, RUN_KEY


def newest_before(requests: DataFrame, log: DataFrame, request_id: str = "request_id") -> DataFrame:
    """(request_id, id): for each request the newest run of its key that is not later; NULL without one.

    ``requests`` has a unique ``request_id``, the run key and ``at``. Runs at the very time of the
    request count, of equally old ones the one with the largest id. Requests with a NULL in key or
    time, and keys without a run, give NULL; runs without a time match nothing.

    Requests and runs are stacked and put in order of key and time, only these columns. In that order a
    request's run is the last one before it. Rows are cut into blocks of neighbours: the last run is
    carried on within blocks, and between blocks as one number each, so a hot key is spread.
    """
    runs = log.where(has_key() & F.col("created_at").isNotNull()).select(
        *RUN_KEY, F.col("created_at").cast("timestamp").alias("_time"), F.lit(None).cast("long").alias("_ask"), "id"
    )
    asked = requests.select(
        *RUN_KEY, F.col("at").cast("timestamp").alias("_time"), F.col(request_id).alias("_ask"),
        F.lit(None).cast("long").alias("id"),
    )
    answerable = has_key() & F.col("_time").isNotNull()
    # Runs come before requests of the same time, runs with smaller ids first.
    rows = runs.unionByName(asked.where(answerable)).withColumn("_kind", F.col("_ask").isNotNull().cast("int"))
    rows = placed(rows, [*RUN_KEY, "_time", "_kind", "id"])
    rows = rows.withColumn("_block", F.shiftright("_at", BLOCK_BITS))
    inside = Window.partitionBy(*RUN_KEY, "_block").orderBy("_at")
    earlier = Window.partitionBy(*RUN_KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per key and block, NULL for a block without a run, which carries on what it was given.
    blocks = rows.groupBy(*RUN_KEY, "_block").agg(
        F.max_by("id", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_last")
    )
    carried = blocks.select(
        *RUN_KEY, "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_before")
    )
    seen = rows.withColumn("_own", F.last("id", ignorenulls=True).over(inside)).where(F.col("_kind") == 1)
    found = seen.join(carried, [*RUN_KEY, "_block"]).select(
        F.col("_ask").alias(request_id), F.coalesce("_own", "_before").alias("id")
    )
    without = asked.where(~F.coalesce(answerable, F.lit(False))).select(F.col("_ask").alias(request_id), "id")
    return found.unionByName(without)


def runs_as_of(
    requests: DataFrame,
    log: DataFrame,
    payload: Sequence[str] = tuple(BACKFEED_PAYLOAD),
    request_id: str = "request_id",
) -> DataFrame:
    """Requests with the id and payload of the newest run of their key as of their time ``at``.

    Request columns whose names the payload has are the payload's. The payload of the runs that were
    found moves once, by id; requests without a run do not travel to that join.
    """
    kept = [name for name in requests.columns if name not in (*payload, "id")]
    asked = requests.select(*kept).join(newest_before(requests, log, request_id), request_id)
    found = asked.where(F.col("id").isNotNull()).join(log.select("id", *payload), "id")
    missing = asked.where(F.col("id").isNull())
    return found.unionByName(missing, allowMissingColumns=True)
