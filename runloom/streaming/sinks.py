"""Exactly-once folders for micro-batches: one sub-folder per batch, replaced on replay."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


def write_batch(rows: DataFrame, batch_id: int, folder: str) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


# Use up what is there, then stop. Others: {"processingTime": "1 minute"}, {"once": True}.
USE_UP = {"availableNow": True}


def start(
    changes: DataFrame, mode: str, folder: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write each micro-batch's rows to ``folder``; the caller owns the running query."""
    return (
        changes.writeStream.outputMode(mode)
        .foreachBatch(lambda rows, batch_id: write_batch(rows, batch_id, folder))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or USE_UP))
        .start()
    )


def _versioned(schema: StructType, name: str) -> StructType:
    return StructType([*schema.fields, StructField(name, LongType())])


def _versions(
    spark: SparkSession, folder: str, schema: StructType, base: str | None
) -> DataFrame:
    """All versions since the newest compacted state in ``base``, that state included."""
    rows = spark.read.schema(_versioned(schema, "batch")).parquet(folder)
    if base is None:
        return rows
    states = spark.read.schema(_versioned(schema, "upto")).parquet(base)
    upto = states.agg(F.max("upto")).first()[0]
    if upto is None:
        return rows
    # Both are folder names: the filters choose folders, not rows.
    kept = states.where(F.col("upto") == upto).withColumnRenamed("upto", "batch")
    return rows.where(F.col("batch") > upto).unionByName(kept)


def newest_version(
    spark: SparkSession, folder: str, schema: StructType, key: list[str], base: str | None = None
) -> DataFrame:
    """Per key the row of the last batch that changed it."""
    rows = _versions(spark, folder, schema, base)
    last = rows.groupBy(*key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*key, "batch"]).drop("batch")


def compact(
    spark: SparkSession, folder: str, schema: StructType, key: list[str], base: str
) -> int | None:
    """Write the newest versions of all finished batches to ``base`` and return the last of them.

    Readers that are given ``base`` then skip those batches, whose folders may be deleted. The
    last batch may still be in the making and is left out. None if there is nothing to do.
    """
    if not _exists(spark, base):
        spark.createDataFrame([], schema).write.parquet(f"{base}/upto=-1")
    rows = _versions(spark, folder, schema, base)
    upto = rows.agg(F.max("batch")).first()[0]
    if upto is None or upto < 1:
        return None
    rows = rows.where(F.col("batch") < upto)
    last = rows.groupBy(*key).agg(F.max("batch").alias("batch"))
    newest = rows.join(last, [*key, "batch"]).drop("batch")
    newest.write.mode("overwrite").parquet(f"{base}/upto={upto - 1}")
    return upto - 1


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("upto long").parquet(path)
        return True
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
