"""Reply chunks and chat turns: (request, seq) rows to texts and pairs.

``seq`` counts up within its request and is unique there, with gaps of any width. Rows are
placed by request and ``seq`` and handled in blocks of neighbours, so the rows of one long
request are spread over many tasks; what is finally put together is one text per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.operators.numbering import BLOCK_BITS, placed, running_sum


def drop_empty(chunks: DataFrame) -> DataFrame:
    """Leave out chunks without text, as one of the providers does."""
    return chunks.where(F.col("chunk") != "")


def in_blocks(chunks: DataFrame) -> DataFrame:
    """(request_id, seq, chunk, block): blocks of neighbours, rising along each request."""
    rows = placed(chunks.select("request_id", "seq", "chunk"), ["request_id", "seq"])
    return rows.withColumn("block", F.shiftright("_at", BLOCK_BITS)).drop("_at")


def chunk_blocks(rows: DataFrame) -> DataFrame:
    """(request_id, block, block_text) from rows in blocks: each block's chunks in order."""
    return rows.groupBy("request_id", "block").agg(
        F.expr("coalesce(listagg(chunk, '') within group (order by seq), '')").alias("block_text")
    )


def join_blocks(blocks: DataFrame) -> DataFrame:
    """(request_id, response): the blocks of a request in order."""
    return blocks.groupBy("request_id").agg(
        F.expr("listagg(block_text, '') within group (order by block)").alias("response")
    )


def response_text(chunks: DataFrame) -> DataFrame:
    """All chunks of each request as one text."""
    return join_blocks(chunk_blocks(in_blocks(chunks)))


def running_text(chunks: DataFrame) -> DataFrame:
    """(request_id, seq, running): chunk i shows chunks 1..i.

    For requests that somebody looks at: the result grows with the square of a reply's
    length, and the text before a block is put together once per block. ``chunk_offsets``
    holds the same information in linear space, for any number of requests.
    """
    chunks = in_blocks(chunks)
    earlier = (
        Window.partitionBy("request_id")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    heads = chunk_blocks(chunks).select(
        "request_id",
        "block",
        "block_text",
        F.array_join(F.collect_list("block_text").over(earlier), "").alias("head"),
    )
    inside = (
        Window.partitionBy("request_id", "block")
        .orderBy("seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    reach = F.sum(F.coalesce(F.length("chunk"), F.lit(0))).over(inside)
    rows = chunks.select(
        "request_id", "seq", "block", F.length("chunk").alias("_n"), "chunk"
    ).select("request_id", "seq", "block", reach.cast("int").alias("_reach"))
    return rows.join(heads, ["request_id", "block"]).select(
        "request_id",
        "seq",
        F.concat("head", F.left("block_text", F.col("_reach"))).alias("running"),
    )


def chunk_offsets(chunks: DataFrame) -> DataFrame:
    """(request_id, seq, end_at): where each chunk ends in the whole response."""
    sized = chunks.select("request_id", "seq", F.length("chunk").alias("_n"))
    counted = running_sum(
        sized, "request_id", "seq", F.coalesce("_n", F.lit(0)).cast("long"), "end_at"
    )
    return counted.select("request_id", "seq", "end_at")


def chat_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, pair, user, assistant) from (conv_id, turn, role, text) rows.

    A user turn opens a pair with an empty answer, an assistant turn replaces the
    answer of the open pair. Turns before the first user turn belong to no pair.
    """
    is_user = F.when(F.col("role") == "user", 1).otherwise(0).cast("long")
    numbered = running_sum(turns.select("conv_id", "turn", "role"), "conv_id", "turn", is_user, "pair")
    # Pairs are made of turn numbers; then each text moves once, to the place it has in its pair.
    pairs = numbered.where(F.col("pair") > 0).groupBy("conv_id", "pair").agg(
        F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("_user"),
        F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("_assistant"),
    )

    def texts(role: str) -> DataFrame:
        said = turns.where(F.col("role") == role)
        return said.select("conv_id", F.col("turn").alias(f"_{role}"), F.col("text").alias(role))

    asked = pairs.join(texts("user"), ["conv_id", "_user"])
    unanswered = asked.where(F.col("_assistant").isNull()).withColumn("assistant", F.lit(""))
    answered = asked.where(F.col("_assistant").isNotNull()).join(
        texts("assistant"), ["conv_id", "_assistant"]
    )
    both = answered.select("conv_id", "pair", "user", "assistant").unionByName(
        unanswered.select("conv_id", "pair", "user", "assistant")
    )
    return both.withColumn("assistant", F.coalesce("assistant", F.lit("")))
