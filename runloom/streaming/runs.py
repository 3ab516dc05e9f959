"""Run-log stream -> current run count and newest run per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from runloom.operators.runlog import latest_ids
from runloom.schemas import RUN_KEY, RUN_LOG
from runloom.streaming.sinks import newest_version, start

CURRENT = StructType(
    [
        *[RUN_LOG[name] for name in RUN_KEY],
        StructField("run_count", LongType()),
        StructField("id", LongType()),
    ]
)


def follow(
    log: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep count and newest run of every key of the log stream in ``folder``.

    State per key is two numbers and the batch operator is used as it is.
    """
    return start(latest_ids(log), "update", folder, checkpoint, trigger)


def read_current(spark: SparkSession, folder: str, base: str | None = None) -> DataFrame:
    """(run key, run_count, id) as far as the stream has come."""
    return newest_version(spark, folder, CURRENT, RUN_KEY, base)


def current(spark: SparkSession, log: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Use up the log stream and return (run key, run_count, id)."""
    follow(log, folder, checkpoint).awaitTermination()
    return read_current(spark, folder)
