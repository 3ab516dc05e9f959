"""Similarity reports as VARIANT: one parse keeps every key, and each list item becomes a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.report import DESCRIPTION, SCORE, SECTIONS
from runloom.functions.text import unfence

KEYS = (DESCRIPTION, SCORE, *SECTIONS)


def _kind(value: Column) -> Column:
    """OBJECT<...>, ARRAY<...>, VOID, STRING, ...; NULL for a key that is not there."""
    return F.schema_of_variant(value)


def _part(report: Column, name: str) -> Column:
    return F.try_variant_get(report, f"$.{name}", "variant")


def with_variant(df: DataFrame, reply: Column, out: str = "report") -> DataFrame:
    """Add the variant ``out`` of an accepted report, NULL of any other reply.

    Accepted is what ``parse_report`` accepts: after the fence is removed one JSON object and nothing
    else, whose three lists are lists, null or absent; an object that has a key twice is not. The
    reply is read inside an envelope, so that words or values after it break it, and behind a one-row
    generator, so that it is read once.
    """
    body = F.concat(F.lit('{"report":['), unfence(reply), F.lit('],"closed":true}'))
    whole = F.col("_whole")
    report = F.try_variant_get(whole, "$.report[0]", "variant")
    alone = F.try_variant_get(whole, "$.report[1]", "variant").isNull()
    closed = F.coalesce(F.try_variant_get(whole, "$.closed", "boolean"), F.lit(False))
    # A reply that closes the envelope itself adds keys to it, or ends before its last one.
    outer = F.size(F.map_keys(F.try_variant_get(whole, "$", "map<string,variant>"))) == 2
    ok = alone & closed & outer & F.startswith(_kind(report), F.lit("OBJECT"))
    for name in SECTIONS:
        kind = F.coalesce(_kind(_part(report, name)), F.lit("VOID"))
        ok = ok & (F.startswith(kind, F.lit("ARRAY")) | (kind == "VOID"))
    read = df.select("*", F.explode(F.array(F.try_parse_json(body))).alias("_whole"))
    return read.select(*df.columns, F.when(F.coalesce(ok, F.lit(False)), report).alias(out))


def item_text(value: Column) -> Column:
    """A text as it is, anything else as JSON; NULL for null."""
    return F.when(F.is_variant_null(value), None).otherwise(
        F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))
    )


def report_items(df: DataFrame, row_id: str, report: str = "report") -> DataFrame:
    """(row_id, section, position, item): every item of the three lists is a row, from 0.

    The lists are exploded where the rows are, as a lateral table function: nothing moves.
    """
    lists = F.array(*[F.struct(F.lit(name).alias("section"), _part(F.col(report), name).alias("items")) for name in SECTIONS])
    sections = df.where(F.col(report).isNotNull()).select(row_id, F.inline(lists))
    spark = df.sparkSession
    items = spark.tvf.variant_explode(F.col("items").outer())
    return sections.lateralJoin(items).select(
        row_id, "section", F.col("pos").cast("long").alias("position"), item_text(F.col("value")).alias("item")
    )


def extra_keys(df: DataFrame, row_id: str, report: str = "report") -> DataFrame:
    """(row_id, key, value): the keys of a report that its five fields do not cover, values as text."""
    reports = df.where(F.col(report).isNotNull()).select(row_id, F.col(report).alias("_report"))
    spark = df.sparkSession
    found = reports.lateralJoin(spark.tvf.variant_explode(F.col("_report").outer()))
    return found.where(~F.col("key").isin(*KEYS)).select(row_id, "key", item_text(F.col("value")).alias("value"))
