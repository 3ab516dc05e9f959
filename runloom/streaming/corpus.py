"""Corpus stream -> insert-if-absent into a growing table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from runloom.operators.corpus import fresh_ids, row_key, stored_digests
from runloom.streaming.sinks import USE_UP, write_batch


def unseen(entries: DataFrame, row_id: str, salts: int = 256) -> DataFrame:
    """The stream without copies of what it has brought before.

    Digests are kept as state, so a micro-batch costs what it brings and not what is
    stored. Streaming de-duplication has no map-side step; a first pass on digest and
    salt spreads a large group of copies over ``salts`` tasks and lets at most that
    many of them on to the second. Rows with NULL in a key part never equal another
    row and pass by.
    """
    keyed = entries.withColumns(
        {"row_key": row_key(), "_salt": F.pmod(F.xxhash64(row_id), F.lit(salts))}
    )
    first = (
        keyed.where(F.col("row_key").isNotNull())
        .dropDuplicates(["row_key", "_salt"])
        .dropDuplicates(["row_key"])
    )
    return first.unionByName(keyed.where(F.col("row_key").isNull())).drop("row_key", "_salt")


def unseen_within(entries: DataFrame, row_id: str, event_time: str, delay: str) -> DataFrame:
    """The stream without copies that come within ``delay`` of each other in event time.

    Digests older than the watermark are forgotten, so the state is bounded by what arrives
    within the delay; a copy that comes later is new again. Rows with NULL in a key part pass by.
    """
    keyed = entries.withColumn("row_key", row_key()).withWatermark(event_time, delay)
    # A row without a digest counts by its own id, under a prefix that no digest has.
    own = F.concat(F.lit("-"), F.col(row_id).cast("string"))
    marked = keyed.withColumn("row_key", F.coalesce("row_key", own))
    return marked.dropDuplicatesWithinWatermark(["row_key"]).drop("row_key")


def insert_stream(
    entries: DataFrame,
    row_id: str,
    folder: str,
    checkpoint: str,
    existing: DataFrame | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append unseen (origin, title, content) rows of the stream to ``folder``.

    ``existing`` are rows stored elsewhere that count as seen. Each batch is compared
    with them and with the digests of the earlier batches only, so a replay after a
    failure writes the same rows to the same sub-folder. It reads all stored digests;
    a stream that runs for long is better served by ``unseen``.
    """

    def insert(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        stored = session.createDataFrame([], "row_key string")
        if existing is not None:
            stored = stored.union(stored_digests(existing))
        if batch_id > 0:
            earlier = session.read.schema("row_key string, batch long").parquet(folder)
            seen = F.col("row_key").isNotNull() & (F.col("batch") < batch_id)
            stored = stored.union(earlier.where(seen).select("row_key"))
        new = rows.withColumn("row_key", row_key())
        fresh = new.join(fresh_ids(new, stored, row_id), row_id, "left_semi")
        write_batch(fresh, batch_id, folder)

    return (
        entries.writeStream.foreachBatch(insert)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or USE_UP))
        .start()
    )


def inserted(spark: SparkSession, entries_schema: StructType, folder: str) -> DataFrame:
    """The table the stream has written so far."""
    rows = spark.read.schema(entries_schema).parquet(folder)
    return rows.select(*entries_schema.names)
