from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import runlog
from runloom.schemas import RUN_KEY
from runloom.sources import tables
from tests.helpers import column, log_frame, one, plan_of

KEY_SCHEMA = "srs_id string, llm_provider string, llm_model string, temperature double"


def keys(spark, *rows):
    return spark.createDataFrame(list(rows), KEY_SCHEMA)


def test_latest_run_ties_nulls_and_missing_keys(spark):
    log = log_frame(
        spark,
        [
            {"id": 1, "srs_id": "a", "at": 10, "original_srs_text": "old"},
            {"id": 2, "srs_id": "a", "at": 20, "original_srs_text": "tie"},
            {"id": 3, "srs_id": "a", "at": 20, "original_srs_text": "newest"},
            {"id": 4, "srs_id": "a", "at": 99, "temperature": 0.7},
            {"id": 5, "srs_id": None, "at": 99},
        ],
    )
    asked = keys(spark, ("a", "p", "m", 0.5), ("a", "p", "m", 0.5), ("b", "p", "m", 0.5), (None, "p", "m", 0.5))
    found = {row.srs_id: row for row in runlog.lookup_latest(asked, log).collect()}
    assert len(found) == 3
    assert (found["a"].id, found["a"].run_count, found["a"].original_srs_text) == (3, 3, "newest")
    for missing in ("b", None):
        assert (found[missing].id, found[missing].run_count, found[missing].original_srs_text) == (None, 0, None)
    assert sorted(column(runlog.latest_runs(log), "id")) == [3, 4]
    assert sorted(column(runlog.latest_runs_by_rank(log), "id")) == [3, 4]
    assert one(runlog.latest_of_key(log, "a", "p", "m", 0.5)).id == 3
    assert runlog.rows_of_key(log, "a", "p", "m", 0.5).count() == 3


def test_backfeed_work_needs_an_original_text(spark):
    log = log_frame(
        spark,
        [
            {"id": 1, "srs_id": "a", "at": 1, "original_srs_text": "x"},
            {"id": 2, "srs_id": "b", "at": 1, "original_srs_text": "x"},
            {"id": 3, "srs_id": "b", "at": 2},
        ],
    )
    asked = keys(spark, ("a", "p", "m", 0.5), ("b", "p", "m", 0.5), ("c", "p", "m", 0.5))
    assert column(runlog.backfeed_work(asked, log), "srs_id") == ["a"]


def test_iteration_labels(spark):
    log = log_frame(
        spark,
        [{"id": at, "srs_id": "a", "at": 5} for at in (1, 2, 3)]
        + [{"id": 4, "srs_id": "b", "at": 1}, {"id": 5, "srs_id": None, "at": 1}],
    )
    labels = {row.id: row.label for row in runlog.iteration_labels(log).collect()}
    assert labels == {
        1: "FIRST_PASS", 2: "BACKFEED_IMPROVEMENT_1", 3: "BACKFEED_IMPROVEMENT_2", 4: "FIRST_PASS",
    }


def test_distinct_ids_keep_one_null_first(spark):
    log = log_frame(spark, [{"id": at, "srs_id": s} for at, s in enumerate(["b", None, "a", None, "b"])])
    assert column(runlog.distinct_ids(log), "srs_id") == [None, "a", "b"]


def test_facets_keep_null_and_sort_numbers(spark):
    log = log_frame(
        spark,
        [
            {"id": 1, "srs_id": "a", "temperature": 10.0, "llm_provider": None},
            {"id": 2, "srs_id": "a", "temperature": 9.0},
            {"id": 3, "srs_id": "a", "temperature": 9.0},
            {"id": 4, "srs_id": None, "temperature": 1.0},
        ],
    )
    found = runlog.facets_in_order(runlog.facets(log)).collect()
    assert [r.value for r in found if r.facet == "llm_provider"] == [None, "p"]
    assert [r.value for r in found if r.facet == "temperature"] == ["9.0", "10.0"]
    assert {r.srs_id for r in found} == {"a"}


def test_side_by_side(spark):
    log = log_frame(
        spark,
        [
            {"id": 1, "srs_id": "a", "event_type": "L", "at": 1, "similarity_score_orig_srs": 1.0},
            {"id": 2, "srs_id": "a", "event_type": "L", "at": 2, "similarity_score_orig_srs": 2.0},
            {"id": 3, "srs_id": "a", "event_type": "R", "at": 1, "similarity_score_orig_srs": 3.0},
            {"id": 4, "srs_id": "b", "event_type": "R", "at": 1, "similarity_score_orig_srs": 4.0},
        ],
    )
    score = "similarity_score_orig_srs"
    row = one(runlog.side_by_side(log, "L", "R", [score]))
    assert (row[f"{score}_left"], row[f"{score}_right"], row.srs_id) == (2.0, 3.0, "a")
    full = runlog.side_by_side(log, "L", "R", [score], "full").orderBy("srs_id").collect()
    assert [(r.srs_id, r.id_left, r.id_right) for r in full] == [("a", 2, 3), ("b", None, 4)]


def test_image_lookup(spark):
    log = log_frame(spark, [{"id": 1, "uml_image_data_orig_srs": b"abc"}, {"id": 2}])
    asked = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id long")
    found = {r.id: (r.status, r.n_bytes, r.image) for r in runlog.image_lookup(log, asked).collect()}
    assert found == {1: ("ok", 3, b"abc"), 2: ("null_image", None, None), 3: ("not_found", None, None)}
    assert one(runlog.image_lookup(log, asked.limit(1), "dist")).status == "null_image"


def test_wide_long_wide_is_the_same(spark):
    log = log_frame(
        spark,
        [
            {"id": 1, "original_srs_text": "o", "similarity_score_dist_srs": 2.0, "uml_image_data_dist_srs": b"x"},
            {"id": 2},
        ],
    )
    wide = runlog.from_flows(runlog.to_flows(log))
    assert wide.exceptAll(log.select(*wide.columns)).count() == 0 and wide.count() == 2


def test_accept_split_sends_null_to_backfeed(spark):
    runs = spark.createDataFrame([(1, 80.0), (2, 10.0), (3, None)], "id long, score double")
    done, again = runlog.accept_split(runs, F.col("score") > 50)
    assert column(done, "id") == [1] and sorted(column(again, "id")) == [2, 3]


def test_append_numbers_and_defaults(spark, tmp_path):
    root = str(tmp_path / "log")
    tables.ensure_tables(spark, root)
    tables.ensure_tables(spark, root)
    assert tables.run_log(spark, root).count() == 0
    rows = spark.createDataFrame([("r2", "B"), ("r1", "A")], "run string, event_type string")
    tables.append_runs(spark, rows, root, "run")
    tables.append_runs(spark, rows.limit(1), root, "run")
    found = tables.run_log(spark, root).orderBy("id").collect()
    assert [(r.id, r.event_type) for r in found] == [(1, "A"), (2, "B"), (3, "B")]
    assert all(r.created_at is not None and r.created_at.microsecond == 0 for r in found)
    assert all(r.srs_id is None and r.temperature is None for r in found)


def test_hot_key_in_log_and_requests(spark):
    log = spark.range(40000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("srs_id"),
        F.lit("p").alias("llm_provider"),
        F.lit("m").alias("llm_model"),
        F.lit(0.5).alias("temperature"),
        F.timestamp_seconds(F.lit(9)).alias("created_at"),
        F.col("id").cast("string").alias("original_srs_text"),
    )
    asked = log.select(*RUN_KEY)
    found = runlog.lookup_latest(asked, log, ["original_srs_text"])
    hot = one(found.where("srs_id = 'hot'"))
    assert (hot.run_count, hot.id, hot.original_srs_text) == (13334, 39999, "39999")
    assert found.count() == 501


def test_plain_sql_over_the_stored_tables(spark, tmp_path):
    root = str(tmp_path / "root")
    tables.ensure_tables(spark, root)
    rows = log_frame(spark, [{"id": at, "srs_id": f"s{at % 2}", "at": at} for at in range(5)])
    tables.append_runs(spark, rows.withColumnRenamed("id", "event"), root, "event")
    tables.create_views(spark, root)
    assert column(spark.sql("SELECT DISTINCT srs_id FROM usage_logs ORDER BY srs_id"), "srs_id") == ["s0", "s1"]
    newest = spark.sql(
        "SELECT id FROM usage_logs WHERE srs_id = :srs_id AND temperature = :temperature "
        "ORDER BY created_at DESC LIMIT 1",
        {"srs_id": "s0", "temperature": 0.5},
    )
    assert one(newest).id == 5
    assert spark.sql("SELECT id, srs_title FROM srs_data").count() == 0


def test_append_keeps_every_row_once(spark, tmp_path):
    root = str(tmp_path / "log")
    rows = spark.createDataFrame(
        [("x", "A"), (None, "B"), ("y", "C"), ("y", "D"), (None, "E")], "run string, event_type string"
    )
    tables.append_runs(spark, rows, root, "run")
    found = tables.run_log(spark, root).orderBy("id").collect()
    assert [r.id for r in found] == [1, 2, 3, 4, 5]
    assert {r.event_type for r in found[:2]} == {"B", "E"} and found[2].event_type == "A"
    assert {r.event_type for r in found[3:]} == {"C", "D"}


def test_losers_keep_their_payload(spark):
    """Ranked before the exchange: a fat payload moves for one run per key and task only."""
    log = log_frame(spark, [{"id": at, "srs_id": "a", "at": at, "original_srs_text": "x"} for at in range(9)])
    for df in (runlog.latest_runs(log), runlog.side_by_side(log, "L", "R"), runlog.backfeed_work(log, log)):
        lines = plan_of(df).splitlines()
        fat = [k for k, line in enumerate(lines) if "Exchange" in line and "original_srs_text" in line]
        assert any("WindowGroupLimit" in line and "Partial" in line for line in lines) and not fat
