"""A run log by name: a catalogue table, bucketed by run key, so that its keys meet without moving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runloom.operators.runlog import has_key, recency
from runloom.schemas import BACKFEED_PAYLOAD, RUN_KEY, RUN_LOG


def key_digest() -> Column:
    """The run key as one text, NULL where a part is NULL.

    A digest, because a floating-point part is normalised for every join, which hides the buckets;
    lengths keep the parts apart.
    """
    parts = [F.col("srs_id"), F.col("llm_provider"), F.col("llm_model"), (F.col("temperature") + F.lit(0.0)).cast("string")]
    told = F.concat(*[F.concat(F.length(part), F.lit(":"), part) for part in parts])
    return F.sha2(told, 256)


def create_log(spark: SparkSession, table: str, folder: str, buckets: int) -> None:
    """Create the table where it is absent: the log's columns and ``run_key``, clustered and sorted by it.

    ``buckets`` is the number of tasks that later read the log, so it follows the size that the log is
    expected to reach, not the size it has. The files lie in ``folder``; dropping the table keeps them.
    """
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in RUN_LOG)
    spark.sql(
        f"""CREATE TABLE IF NOT EXISTS {table} ({columns}, run_key string) USING parquet
        CLUSTERED BY (run_key) SORTED BY (run_key, created_at, id) INTO {int(buckets)} BUCKETS
        LOCATION '{folder}'"""
    )


def append_log(rows: DataFrame, table: str) -> None:
    """Append run rows in the log's columns, ids and times included.

    Rows are gathered by key first, so that an append adds few files to each bucket; a key that holds
    a large part of the rows is divided among several tasks and files.
    """
    keyed = rows.select(*[F.col(field.name).cast(field.dataType) for field in RUN_LOG], key_digest().alias("run_key"))
    keyed.hint("rebalance", "run_key").write.insertInto(table)


def latest_bucketed(
    keys: DataFrame, log: DataFrame, payload: Sequence[str] = tuple(BACKFEED_PAYLOAD)
) -> DataFrame:
    """Every distinct requested key with its newest run, as ``lookup_latest``, from a bucketed log.

    Counts, ranks and payload are found bucket by bucket: no row of the log moves, only the keys do. A
    bucket is read by one task as a sorted stream; for a log in which one key holds most rows,
    ``lookup_latest`` reduces that key in many tasks before it moves.
    """
    runs = log.where(F.col("run_key").isNotNull())
    counts = runs.groupBy("run_key").agg(F.count("*").alias("run_count"), F.max_by("id", recency()).alias("id"))
    newest = Window.partitionBy("run_key").orderBy(F.desc("created_at"), F.desc("id"))
    best = (
        runs.select("run_key", "id", "created_at", *payload)
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") == 1)
        .select("run_key", *payload)
    )
    # What has a NULL in its key has no run, and would gather under one NULL digest.
    wanted = keys.select(*RUN_KEY).distinct()
    asked = wanted.where(has_key()).withColumn("run_key", key_digest())
    found = asked.join(counts.join(best, "run_key"), "run_key", "left").drop("run_key")
    missing = wanted.where(~has_key())
    return found.unionByName(missing, allowMissingColumns=True).fillna(0, ["run_count"])
