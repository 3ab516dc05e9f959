"""Log retrieval: ids, facets of the chosen ones, runs and two event types of a chosen key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators.runlog import (
    distinct_ids,
    facets,
    facets_in_order,
    rows_of_key,
    side_by_side,
)

# srs_id, provider, model, temperature
Key = tuple[str, str, str, float]


def retrieve(
    log: DataFrame,
    left_event: str,
    right_event: str,
    ids: Sequence[str] | DataFrame | None = None,
    key: Key | None = None,
    how: str = "inner",
) -> dict[str, DataFrame]:
    """The views a user walks through, each lazy.

    ``ids``: every artifact in the log. ``facets``: the values on offer for the chosen ids, a
    list or a DataFrame with ``srs_id``; for all without a choice. ``rows`` and ``compared``: the
    runs of the chosen key, and its newest runs of two event types beside each other; of
    all keys without a choice. A choice reaches the scan as a filter.
    """
    chosen = log if key is None else rows_of_key(log, *key)
    if ids is None or isinstance(ids, DataFrame):
        offered = facets(log, ids)
    else:
        offered = facets(log.where(F.col("srs_id").isin(sorted(set(ids)))))
    return {
        "ids": distinct_ids(log),
        "facets": facets_in_order(offered),
        "rows": chosen,
        "compared": side_by_side(chosen, left_event, right_event, how=how),
    }
