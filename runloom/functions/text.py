"""Text functions, all Column -> Column and all linear in the text length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as whitespace when a text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Markers in model replies.
SCRIPT_START = "@startuml"
SCRIPT_END = "@enduml"
JSON_FENCE = "```json"
FENCE = "```"
FAILURE_MARKS = ("[Error]", "Error processing ")


def strip(text: Column) -> Column:
    """Remove whitespace of any kind on both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def strip_left(text: Column) -> Column:
    """Remove whitespace of any kind at the start; stops at the first other character."""
    return F.ltrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for NULL, empty and whitespace-only text."""
    return F.coalesce(strip_left(text) == "", F.lit(True))


def artifact_key(doc_id: Column, title: Column) -> Column:
    """``{id}_{title}`` with plain blanks taken out of the title.

    A missing title counts as empty: the key stays unique per document.
    """
    bare = F.replace(F.coalesce(title, F.lit("")), F.lit(" "), F.lit(""))
    return F.concat(doc_id.cast("string"), F.lit("_"), bare)


def unfence(text: Column) -> Column:
    """Drop a leading ```` ```json ```` and a trailing fence, each followed by a strip.

    A bare opening fence stays: the text is then no JSON and is rejected later.
    """
    opened = F.when(
        F.startswith(text, F.lit(JSON_FENCE)), strip(F.substr(text, F.lit(len(JSON_FENCE) + 1)))
    ).otherwise(text)
    return F.when(
        F.endswith(opened, F.lit(FENCE)),
        strip(F.left(opened, F.length(opened) - F.lit(len(FENCE)))),
    ).otherwise(opened)


def extract_script(reply: Column) -> Column:
    """From the first start marker to the last end marker, or the empty text.

    Position arithmetic instead of a regular expression: a greedy pattern rescans
    the rest of the text for every start marker when no end marker follows.
    """
    start = F.locate(SCRIPT_START, reply)
    after_end = F.substring_index(reply, SCRIPT_END, -1)
    stop = F.length(reply) - F.length(after_end)
    found = F.contains(reply, F.lit(SCRIPT_END)) & (start > 0) & (stop > start)
    return F.when(found, F.substr(reply, start, stop - start + F.lit(1))).otherwise("")


def wrap_script(script: Column) -> Column:
    """Add the marker lines unless the stripped script already starts with one."""
    return F.when(F.startswith(strip_left(script), F.lit(SCRIPT_START)), script).otherwise(
        F.concat(F.lit(SCRIPT_START + "\n"), script, F.lit("\n" + SCRIPT_END))
    )


def improvement_label(earlier_runs: Column) -> Column:
    """Event type of a back-feed run that has ``earlier_runs`` runs before it."""
    return F.concat(F.lit("BACKFEED_IMPROVEMENT_"), earlier_runs.cast("string"))


def is_failure(reply: Column) -> Column:
    """True when the reply is an error message rather than an answer."""
    first, second = FAILURE_MARKS
    return F.startswith(reply, F.lit(first)) | F.startswith(reply, F.lit(second))


def reply_status(reply: Column) -> Column:
    """``pending`` without a reply, ``error`` for an error message, else ``ok``."""
    return F.when(reply.isNull(), "pending").when(is_failure(reply), "error").otherwise("ok")
