"""The grouping queries on tables where one key, title or conversation holds a third of all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.check import TABLES, compare, connect

SOURCE = str(TABLES / "sf0.001")

GROUPING = [
    "corpus_from_entries",
    "insert_if_absent",
    "insert_skipped",
    "import_corpus",
    "run_log_append",
    "latest_run",
    "latest_run_by_rank",
    "run_counts",
    "iteration_label",
    "facets",
    "facets_of_ids",
    "side_by_side",
    "side_by_side_full",
    "accept_split",
    "image_lookup",
    "response_text",
    "chunk_running",
    "chunk_offsets",
    "chat_history",
    "match_responses",
    "first_pass_states",
    "backfeed_results",
    "stream_latest",
    "stream_responses",
    "stream_insert",
    "stream_unseen",
    "latest_run_bucketed",
    "latest_run_as_of",
    "stream_running",
    "stream_matched",
    "completion_once",
]


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """A third of the events under one user, of the documents one text, of the turns one talk.

    Every table is a folder of several files, and many runs share their time.
    """
    folder = str(tmp_path_factory.mktemp("skewed"))

    def table(name):
        return spark.read.parquet(f"{SOURCE}/{name}.parquet")

    def write(name, df):
        df.repartition(4).write.parquet(f"{folder}/{name}.parquet")

    hot = F.col("event_id") % 3 == 0
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    events = table("events").withColumns(
        {
            "user_id": F.when(hot, F.lit(7)).otherwise(F.col("user_id")),
            "ts": F.when(F.col("event_id") % 2 == 0, day).otherwise(F.col("ts")),
        }
    )
    write("events", events)

    documents = table("documents")
    copied = documents.where("doc_id = 1").first()
    hot = F.col("doc_id") % 3 == 0
    write(
        "documents",
        documents.withColumns(
            {
                name: F.when(hot, F.lit(copied[name])).otherwise(F.col(name))
                for name in ("text", "lang", "source", "n_chars")
            }
        ),
    )

    hot = F.col("conv_id") % 3 == 0
    turn = F.when(hot, F.col("conv_id") * 700 + F.col("turn")).otherwise(F.col("turn"))
    conv = F.when(hot, F.lit(0)).otherwise(F.col("conv_id"))
    write("conversations", table("conversations").withColumns({"turn": turn, "conv_id": conv}))

    for name in ("labels", "customer", "supplier"):
        write(name, table(name))
    return folder


@pytest.mark.parametrize("name", GROUPING)
def test_query_equals_sql_on_skewed_tables(spark, skewed, name):
    assert compare(spark, connect(skewed), name, skewed) == ""
