from __future__ import annotations

from pyspark.sql import functions as F

from runloom.functions import text
from runloom.operators import runlog
from runloom.sources import functions, tables
from tests.helpers import log_frame, one, plan_of

REPLIES = ["a @startuml b @enduml c", "@enduml x @startuml", "@startuml", "", None, "@startuml 1 @enduml @startuml 2 @enduml."]


def test_text_functions_equal_their_columns(spark):
    functions_over(spark, [])
    df = spark.createDataFrame([(k, r) for k, r in enumerate(REPLIES)], "id long, reply string")
    df.createOrReplaceTempView("given_replies")
    by_sql = spark.sql("SELECT id, extract_script(reply) AS s, improvement_label(id) AS l FROM given_replies")
    by_column = df.select("id", text.extract_script(F.col("reply")).alias("s"), text.improvement_label(F.col("id")).alias("l"))
    assert sorted(by_sql.collect()) == sorted(by_column.collect())


def functions_over(spark, rows):
    log = log_frame(spark, rows)
    log.createOrReplaceTempView("usage_logs")
    functions.create_functions(spark)
    return log


def test_lookups(spark):
    log = functions_over(
        spark,
        [
            {"id": 1, "srs_id": "a", "at": 10, "original_srs_text": "old"},
            {"id": 2, "srs_id": "a", "at": 20, "original_srs_text": "tie"},
            {"id": 3, "srs_id": "a", "at": 20, "original_srs_text": "newest"},
            {"id": 4, "srs_id": "a", "at": 99, "temperature": 0.7},
            {"id": 5, "srs_id": None, "at": 99},
        ],
    )
    found = spark.sql("SELECT * FROM latest_run_of('a', 'p', 'm', 0.5D)")
    assert (one(found).id, one(found).original_srs_text) == (3, "newest")
    assert sorted(r.id for r in spark.sql("SELECT id FROM runs_of('a', 'p', 'm', 0.5D)").collect()) == [1, 2, 3]
    assert spark.sql("SELECT * FROM latest_run_of(NULL, 'p', 'm', 0.5D)").count() == 0
    # The function is a part of the plan, the key's filter goes below the rank.
    assert "Join" not in plan_of(found) and plan_of(found).rindex("Filter") > plan_of(found).rindex("WindowGroupLimit")
    want = runlog.latest_of_key(log, "a", "p", "m", 0.5).select(*found.columns)
    assert found.collect() == want.collect()
    asked = spark.createDataFrame([("a", 0.5), ("a", 0.7), ("b", 0.5), ("a", 0.5)], "srs string, degrees double")
    asked.createOrReplaceTempView("asked_keys")
    every = spark.sql("SELECT srs, degrees, id FROM asked_keys, LATERAL latest_run_of(srs, 'p', 'm', degrees)")
    assert sorted(map(tuple, every.collect())) == [("a", 0.5, 3), ("a", 0.5, 3), ("a", 0.7, 4)]
    assert plan_of(every).count("WindowGroupLimit") >= 2


def test_functions_over_stored_tables(spark, tmp_path):
    root = str(tmp_path / "tables")
    tables.append_runs(spark, log_frame(spark, [{"id": 7, "srs_id": "a", "at": 1}]).withColumnRenamed("id", "n"), root, "n")
    tables.create_views(spark, root)
    functions.create_functions(spark)
    assert one(spark.sql("SELECT id FROM latest_run_of('a', 'p', 'm', 0.5D)")).id == 1
