from __future__ import annotations

import random

from pyspark.sql import functions as F

from runloom.operators import chunks as batch_chunks
from runloom.operators import runlog
from runloom.operators.corpus import insert_if_absent
from runloom.operators.numbering import BLOCK
from runloom.schemas import RUN_LOG
from runloom.streaming import corpus as corpus_stream
from runloom.streaming import replies, runs, sinks
from tests.helpers import log_frame


def files_of(df, folder, n):
    """``df`` as ``n`` files, read back as a stream of one file per micro-batch."""
    df.repartition(n).write.parquet(folder)
    spark = df.sparkSession
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def same(left, right):
    right = right.select(*left.columns)
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_reply_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [("long", at, rng.choice(["a", "", "é\n"])) for at in range(BLOCK + 50)]
    rows += [(f"r{at % 7}", at, f"<{at}>") for at in range(100)]
    df = spark.createDataFrame(rows, "request_id string, seq long, chunk string")
    stream = files_of(df, str(tmp_path / "in"), 4)
    found = replies.assemble(spark, stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert same(found, batch_chunks.response_text(df))


def test_run_stream_equals_batch(spark, tmp_path):
    rows = [{"id": at, "srs_id": f"s{at % 5}" if at % 11 else None, "at": at % 13} for at in range(200)]
    log = log_frame(spark, rows)
    stream = files_of(log, str(tmp_path / "in"), 4)
    found = runs.current(spark, stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert same(found, runlog.latest_ids(log))
    assert stream.schema == RUN_LOG


def test_run_stream_goes_on_after_a_restart(spark, tmp_path):
    folder, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    first = log_frame(spark, [{"id": 1, "srs_id": "a", "at": 1}, {"id": 2, "srs_id": "b", "at": 1}])
    second = log_frame(spark, [{"id": 3, "srs_id": "a", "at": 2}])
    for part in (first, second):
        part.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(RUN_LOG).parquet(folder)
        found = runs.current(spark, stream, out, state)
    assert {(r.srs_id, r.run_count, r.id) for r in found.collect()} == {("a", 2, 3), ("b", 1, 2)}


def test_corpus_stream_inserts_each_triple_once(spark, tmp_path):
    docs = spark.range(300).select(
        "id",
        F.lit("o").alias("srs_origin"),
        F.when(F.col("id") % 10 != 0, F.lit("t")).alias("srs_title"),
        (F.col("id") % 4).cast("string").alias("srs_content"),
    )
    stream = files_of(docs, str(tmp_path / "in"), 5)
    folder = str(tmp_path / "out")
    corpus_stream.insert_stream(stream, "id", folder, str(tmp_path / "state")).awaitTermination()
    found = corpus_stream.inserted(spark, docs.schema, folder)
    assert found.where("srs_title is null").count() == 30
    assert found.where("srs_title is not null").count() == 4
    in_batch = insert_if_absent(docs, docs.limit(0), "id")
    assert same(found.drop("id"), in_batch.drop("id"))


def test_corpus_stream_knows_existing_rows(spark, tmp_path):
    schema = "id long, srs_origin string, srs_title string, srs_content string"
    docs = spark.createDataFrame([(1, "o", "t", "x"), (2, "o", "t", "y"), (3, "o", "t", "y")], schema)
    stream, folder = files_of(docs, str(tmp_path / "in"), 3), str(tmp_path / "out")
    stored = spark.createDataFrame([(9, "o", "t", "x")], schema)
    corpus_stream.insert_stream(stream, "id", folder, str(tmp_path / "state"), stored).awaitTermination()
    found = corpus_stream.inserted(spark, docs.schema, folder).collect()
    assert [row.srs_content for row in found] == ["y"]


def test_unseen_keeps_digests_across_batches(spark, tmp_path):
    docs = spark.range(300).select(
        "id",
        F.lit("o").alias("srs_origin"),
        F.when(F.col("id") % 10 != 0, F.lit("t")).alias("srs_title"),
        (F.col("id") % 4).cast("string").alias("srs_content"),
    )
    stream = files_of(docs, str(tmp_path / "in"), 5)
    folder = str(tmp_path / "out")
    rows = corpus_stream.unseen(stream, "id")
    sinks.start(rows, "append", folder, str(tmp_path / "state")).awaitTermination()
    found = corpus_stream.inserted(spark, docs.schema, folder)
    assert same(found.drop("id"), insert_if_absent(docs, docs.limit(0), "id").drop("id"))


def test_replayed_batch_replaces_itself(spark, tmp_path):
    folder = str(tmp_path / "out")
    schema = "id long, srs_origin string, srs_title string, srs_content string"
    rows = spark.createDataFrame([(1, None, "t", "x")], schema)
    for _ in range(2):
        sinks.write_batch(rows, 0, folder)
    assert corpus_stream.inserted(spark, rows.schema, folder).count() == 1


def test_a_stream_that_runs_on_is_read_and_compacted(spark, tmp_path):
    folder, out, state, base = (str(tmp_path / name) for name in ("in", "out", "state", "base"))
    log_frame(spark, [{"id": 0, "srs_id": "a", "at": 0}]).write.parquet(folder)
    stream = spark.readStream.schema(RUN_LOG).option("maxFilesPerTrigger", 1).parquet(folder)
    running = runs.follow(stream, out, state, {"processingTime": "100 milliseconds"})
    try:
        for at in range(1, 7):
            log_frame(spark, [{"id": at, "srs_id": "ab"[at % 2], "at": at}]).coalesce(1).write.mode("append").parquet(folder)
            running.processAllAvailable()
            if at == 4:
                done = sinks.compact(spark, out, runs.CURRENT, runs.RUN_KEY, base)
        assert running.isActive and done >= 2
    finally:
        running.stop()
    want = {("a", 4, 6), ("b", 3, 5)}
    for found in (runs.read_current(spark, out), runs.read_current(spark, out, base)):
        assert {(r.srs_id, r.run_count, r.id) for r in found.collect()} == want
    later = sinks.compact(spark, out, runs.CURRENT, runs.RUN_KEY, base)
    assert later > done
    assert {(r.srs_id, r.run_count, r.id) for r in runs.read_current(spark, out, base).collect()} == want


def test_copies_within_the_delay_are_dropped(spark, tmp_path):
    schema = "id long, srs_origin string, srs_title string, srs_content string"
    rows = [(k, "o", "t" if k % 5 else None, str(k % 3)) for k in range(20)]
    docs = spark.createDataFrame(rows, schema).withColumn(
        "at", F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000)
    )
    stream = files_of(docs, str(tmp_path / "in"), 3)
    out = str(tmp_path / "out")
    kept = corpus_stream.unseen_within(stream, "id", "at", "1 hour")
    sinks.start(kept, "append", out, str(tmp_path / "state")).awaitTermination()
    found = corpus_stream.inserted(spark, docs.schema, out).collect()
    assert sum(r.srs_title is None for r in found) == 4
    assert sorted(r.srs_content for r in found if r.srs_title) == ["0", "1", "2"]
