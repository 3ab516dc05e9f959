"""Conversations folded from event logs and rendered for training, in DataFrame functions only.

An event log has a row per event: conversation, message (its place in the conversation),
``seq`` (the event's place in the message), ``kind``, role and text.

* ``start`` opens a message with a role and a first text,
* ``delta`` appends its text,
* ``edit`` puts its text in place of all before,
* ``regenerate`` throws away what was generated; its own text, if any, is the new beginning.

Template: every message is ``<turn ROLE>``, a line break, the text, ``</turn>``, a line break.
Inside texts a backslash is doubled, and ``</turn>`` and ``<turn `` get one after their ``<``;
inside roles ``>`` and ``<`` are written ``\\g`` and ``\\l``. So no text can open or close a
turn, and dropping the backslashes gives every text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn ", "</turn>"
KINDS = ("start", "edit", "regenerate", "delta")
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    closed = F.replace(doubled, F.lit(CLOSE), F.lit("<\\/turn>"))
    return F.replace(closed, F.lit(OPEN), F.lit("<\\turn "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    doubled = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit(">"), F.lit("\\g")), F.lit("<"), F.lit("\\l"))


def unescape_role(role: Column) -> Column:
    # Between doubled backslashes, a backslash can only begin one of the two marks.
    def plain(part: Column) -> Column:
        return F.replace(F.replace(part, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))

    return F.array_join(F.transform(F.split(role, r"\\\\"), plain), "\\")


def fold_events(
    events: DataFrame,
    conversation: str = "conv_id",
    message: str = "message",
    seq: str = "seq",
    kind: str = "kind",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conversation, message, role, text): the final text of every message.

    Events of one message and ``seq`` count in the order start, edit, regenerate, delta, then by
    text. The role is that of the last event that has one. A null or unknown kind is a delta, a
    null text is empty, a null role without another one is empty; null conversations, messages
    and places are values like others and come first. What is gathered for a message is its own
    events, whose texts are one cell in the end anyway. Other columns are not read.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind)), F.lit(4))
    one = F.struct(
        F.col(seq).alias("seq"),
        F.when(rank == 0, 4).otherwise(rank).alias("rank"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.col(role).alias("role"),
    )
    # Wide texts are gathered once and not compared unless all before them is equal.
    logs = events.groupBy(
        F.col(conversation).alias("conversation"), F.col(message).alias("message")
    ).agg(F.sort_array(F.collect_list(one)).alias("log"))
    anew = F.array_max(F.transform("log", lambda e, k: F.when(e["rank"] < 4, k).otherwise(0)))
    roles = F.filter(F.col("log")["role"], lambda r: r.isNotNull())
    return logs.select(
        "conversation",
        "message",
        F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"),
        F.array_join(F.slice(F.col("log")["text"], anew + 1, F.size("log")), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conversation, formatted, loss_mask): every conversation as one training text.

    ``messages`` is what ``fold_events`` returns. ``loss_mask`` has an entry for each turn, in
    order: ``chars``, the code points of the turn in ``formatted``, and ``start`` and
    ``length`` of its part under the loss, counted from the turn's first code point; the length
    is 0 but for turns of the assistant. A conversation is one cell, the largest
    that Spark holds bounds it.
    """
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(">\n"))
    turns = messages.select("conversation", "message", "role", head.alias("head"),
                            escape(F.col("text")).alias("body"))
    whole = F.concat("head", "body", F.lit(CLOSE + "\n"))
    mask = F.struct(
        F.length(whole).alias("chars"),
        F.length("head").alias("start"),
        F.when(F.col("role") == LOSS_ROLE, F.length("body")).otherwise(0).alias("length"),
    )
    gathered = turns.groupBy("conversation").agg(
        F.sort_array(
            F.collect_list(F.struct("message", whole.alias("turn"), mask.alias("mask")))
        ).alias("turns")
    )
    return gathered.select(
        "conversation",
        F.array_join(F.col("turns")["turn"], "").alias("formatted"),
        F.col("turns")["mask"].alias("loss_mask"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Adds ``turns``, the roles and texts read from ``formatted``, and ``loss_texts``, those under the mask."""
    pieces = F.split(F.col("formatted"), "</turn>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, ">", 1)
        return F.struct(
            unescape_role(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(piece, F.length(head) + 3)).alias("text"),
        )

    def under_loss(pair: Column) -> Column:
        span = pair["mask"]
        return unescape(F.substr(pair["piece"], span["start"] + 1, span["length"]))

    pairs = F.arrays_zip(pieces.alias("piece"), F.col("loss_mask").alias("mask"))
    in_loss = F.filter(pairs, lambda p: p["mask"]["length"] > 0)
    return rendered.select(
        "conversation",
        "formatted",
        F.transform(pieces, turn).alias("turns"),
        F.transform(in_loss, under_loss).alias("loss_texts"),
    )


def chat_texts(events: DataFrame, **names: str) -> DataFrame:
    """Fold an event log and render it: see ``fold_events`` and ``render``."""
    return render(fold_events(events, **names))
