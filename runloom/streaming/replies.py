"""Chunk stream -> response per request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from runloom.operators.chunks import join_blocks
from runloom.operators.numbering import block_of
from runloom.streaming.sinks import newest_version, start


def block_states(chunks: DataFrame) -> DataFrame:
    """Streaming aggregate: the text so far of every block of every request.

    State is kept per block, so no state row grows with the length of a reply.
    """
    chunk = F.coalesce("chunk", F.lit("")).alias("chunk")
    pieces = F.sort_array(F.collect_list(F.struct("seq", chunk)))
    return chunks.groupBy("request_id", block_of("seq").alias("block")).agg(
        F.array_join(F.transform(pieces, lambda piece: piece["chunk"]), "").alias("block_text")
    )


def follow(
    chunks: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep the text so far of every block of the chunk stream in ``folder``."""
    return start(block_states(chunks), "update", folder, checkpoint, trigger)


def read_replies(
    spark: SparkSession, folder: str, states: StructType, base: str | None = None
) -> DataFrame:
    """(request_id, response) as far as the stream has come; ``states`` is what it writes."""
    return join_blocks(newest_version(spark, folder, states, ["request_id", "block"], base))


def assemble(spark: SparkSession, chunks: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Use up the chunk stream and return (request_id, response)."""
    follow(chunks, folder, checkpoint).awaitTermination()
    return read_replies(spark, folder, block_states(chunks).schema)
