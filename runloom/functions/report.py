"""Similarity reports: parse once into a struct, then read fields with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.text import strip, unfence

# Keys of a similarity report, and the order of its three lists.
DESCRIPTION = "extracted_description"
SCORE = "similarity_score"
SECTIONS = ("discrepancies", "missing_elements", "additional_elements")

# The score is read as text: a quoted number is a number too.
_REPORT = (
    f"struct<{DESCRIPTION}: string, {SCORE}: string, "
    + ", ".join(f"{name}: array<string>" for name in SECTIONS)
    + ">"
)
_ENVELOPE = f"struct<report: array<{_REPORT}>, closed: boolean, _corrupt: string>"
_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt",
    "allowSingleQuotes": "false",
}
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_report(df: DataFrame, reply: Column, out: str = "report") -> DataFrame:
    """Add struct ``out``: ``ok`` plus the five fields of the report in ``reply``, with defaults.

    The JSON reader ignores words after a complete value. The reply is therefore
    read inside an envelope whose own last key must still be reached: trailing
    words break the envelope, a second value makes its list longer than one, and a reply that
    closes the envelope's list adds a key to it.

    The parse stands behind a one-row generator. As a plain column it would be copied
    into every filter on the report that the optimizer moves down, once per use.
    """
    body = F.concat(F.lit('{"report":['), unfence(reply), F.lit('],"closed":true}'))
    raw = F.col("_raw")
    fields = F.get(raw["report"], F.lit(0))
    ok = (
        raw.isNotNull()
        & raw["_corrupt"].isNull()
        & F.coalesce(raw["closed"], F.lit(False))
        & (F.size(raw["report"]) == 1)
        & F.coalesce(F.col("_keys") == F.array(F.lit("report"), F.lit("closed")), F.lit(False))
        & fields.isNotNull()
    )
    number = strip(fields[SCORE])
    parsed = F.struct(
        F.coalesce(ok, F.lit(False)).alias("ok"),
        F.coalesce(fields[DESCRIPTION], F.lit("")).alias(DESCRIPTION),
        F.when(number.rlike(_NUMBER), number.try_cast("double")).alias(SCORE),
        *[
            F.coalesce(fields[name], F.array().cast("array<string>")).alias(name)
            for name in SECTIONS
        ],
    )
    outer = F.from_json(body, "map<string, string>", {"allowSingleQuotes": "false"})
    read = F.struct(
        F.from_json(body, _ENVELOPE, _OPTIONS).alias("_raw"), F.map_keys(outer).alias("_keys")
    )
    return df.select("*", F.inline(F.array(read))).select(*df.columns, parsed.alias(out))


def section_text(report: Column, name: str) -> Column:
    """The items of one list, one per line; the empty text without items."""
    return F.array_join(report[name], "\n")


def analysis_text(report: Column) -> Column:
    """The three lists as titled sections separated by a blank line."""
    pieces = []
    for at, name in enumerate(SECTIONS):
        lead = "\n\n" if at else ""
        pieces += [F.lit(f"{lead}{name}:\n"), section_text(report, name)]
    return F.concat(*pieces)


def split_reports(df: DataFrame, report: str = "report") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); together they are the input."""
    return df.where(F.col(report)["ok"]), df.where(~F.col(report)["ok"])
