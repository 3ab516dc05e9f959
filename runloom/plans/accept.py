"""Back-feed round after round until a run is accepted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.text import is_blank
from runloom.plans.backfeed import backfeed
from runloom.plans.stages import TEXT_OF, Ask, done
from runloom.schemas import FLOWS, RUN_KEY
from runloom.session import durable

# What a round hands on to the next one: the newest run's script and findings of each flow.
CARRIED = [f"{name}_{flow}_srs" for flow in FLOWS for name in ("plantuml_script", "similarity_descr")]
SCORES = [f"similarity_score_{flow}_srs" for flow in FLOWS]
STATES = [f"state_{flow}" for flow in FLOWS]


def backfeed_until(work: DataFrame, ask: Ask, accepted: Column, limit: int) -> DataFrame:
    """(run key, rounds, verdict, run_count, event_type, scripts, findings, scores, states) of every work row.

    ``work`` comes from ``backfeed.work_list``. A round asks once for each run that is still open; a run
    that comes through becomes its key's newest and is what the next round improves, a failed one leaves
    the newest as it was. ``accepted`` is a condition on the columns of a run that came through; NULL is
    not accepted. ``verdict`` is ``accepted``, ``open`` after ``limit`` rounds, or ``no_text`` for a run
    that lacks one of its texts, which no round could change: it is not asked at all.

    ``rounds`` says how often a key was asked, ``event_type`` is the label of its newest improvement (NULL
    without one). Every round is written down before it is read, so accepted runs are not asked again,
    a lost executor repeats a part of one round only, and no plan is longer than a round.
    """
    names = [*RUN_KEY, "run_count", "event_type", *CARRIED, *SCORES, *STATES]
    hopeless = is_blank(F.col(TEXT_OF["orig"])) | is_blank(F.col(TEXT_OF["dist"]))
    hopeless = F.coalesce(hopeless, F.lit(True))
    base = work.withColumns(
        {"event_type": F.lit(None).cast("string")}
        | {name: F.lit(None).cast("double") for name in SCORES}
        | {name: F.lit(None).cast("string") for name in STATES}
    )
    base = durable(base.withColumn("_hopeless", hopeless))

    def verdicts(rows: DataFrame, rounds: int, verdict: str) -> DataFrame:
        return rows.select(*names, F.lit(rounds).alias("rounds"), F.lit(verdict).alias("verdict"))

    ended = [verdicts(base.where(F.col("_hopeless")), 0, "no_text")]
    still = base.where(~F.col("_hopeless")).drop("_hopeless")
    for number in range(1, limit + 1):
        ended_round, still = one_round(still, ask, accepted)
        ended.append(verdicts(ended_round, number, "accepted"))
        if still.isEmpty():
            break
    ended.append(verdicts(still, limit, "open"))
    return reduce(DataFrame.unionByName, ended)


def one_round(still: DataFrame, ask: Ask, accepted: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, still open) after asking once more for every open run."""
    before = {name: F.col(name) for name in ["event_type", *CARRIED, *SCORES]}
    results = backfeed(still.withColumns({f"_before_{name}": value for name, value in before.items()}), ask)
    through = done()
    # The number of runs before this one names it; it counts from now on if it came through.
    newest = {
        name: F.when(through, F.col(name)).otherwise(F.col(f"_before_{name}")) for name in before
    }
    counted = {"run_count": F.col("run_count") + through.cast("long")}
    asked = results.withColumns({"_accepted": through & F.coalesce(accepted, F.lit(False))})
    written = durable(asked.withColumns(newest | counted).select(*still.columns, "_accepted"))
    return written.where(F.col("_accepted")), written.where(~F.col("_accepted")).drop("_accepted")
