"""Request stream and reply stream -> requests with their reply, or as pending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions.text import reply_status


def match_streams(
    requests: DataFrame, replies: DataFrame, within: str, lateness: str, watermarks: bool = True
) -> DataFrame:
    """Every request of a stream once: with its reply, or as pending once none can come any more.

    ``requests`` has (request_id, asked_at, ...), ``replies`` (request_id, response, replied_at). A
    reply counts from the moment of its request up to ``within`` after it. Rows may come in any order
    as long as none is more than ``lateness`` behind the newest of its stream; later ones are dropped.
    Both sides are kept for ``within`` and ``lateness`` only, so the state is bounded by what comes
    in that time. A request without a reply is given out when the watermark of the reply stream has passed
    its time; on both streams time goes on with every row that has an id, whether or not it matches. One
    without an id is pending.

    ``request_id`` is unique on both sides; a request with two replies would come twice. The same
    function matches tables (``watermarks=False``), whose pending requests all come out.
    """
    answers = replies.select(F.col("request_id").alias("_request"), "response", "replied_at")
    if watermarks:
        requests = requests.withWatermark("asked_at", lateness)
        answers = answers.withWatermark("replied_at", lateness)
    in_time = (F.col("replied_at") >= F.col("asked_at")) & (
        F.col("replied_at") <= F.col("asked_at") + F.expr(f"interval {within}")
    )
    matched = requests.join(answers, (F.col("request_id") == F.col("_request")) & in_time, "left")
    return matched.select(
        *requests.columns, "response", "replied_at", reply_status(F.col("response")).alias("response_status")
    )
