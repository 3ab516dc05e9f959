from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators.corpus import insert_if_absent
from runloom.streaming import corpus as corpus_stream
from runloom.streaming import index
from tests.test_streaming import files_of, same


def digests(spark, numbers):
    return spark.createDataFrame([(k,) for k in numbers], "n long").select(F.sha2(F.col("n").cast("string"), 256).alias("row_key"))


def test_only_partitions_that_may_matter_are_read(spark, tmp_path):
    known = index.DigestIndex(spark, str(tmp_path / "index"))
    known.add(digests(spark, range(2000)), 0)
    known.add(digests(spark, range(2000, 2500)), 1)
    every = {r.row_key[:2] for r in digests(spark, range(2500)).collect()}
    assert len(every) == 256
    # Unknown digests: nearly no partition is read, and none wrongly left out.
    unknown = known.hit_prefixes(digests(spark, range(10**6, 10**6 + 300)), 2)
    assert len(unknown) < 10
    asked = digests(spark, [5, 2400, 10**6])
    wanted = {r.row_key[:2] for r in digests(spark, [5, 2400]).collect()}
    hits = set(known.hit_prefixes(asked, 2))
    assert wanted <= hits and len(hits) <= 3
    found = known.candidates(asked, 2)
    files = found.select(F.input_file_name().alias("path")).distinct().collect()
    prefixes = {r.path.split("prefix=")[1][:2] for r in files}
    assert prefixes == hits and found.join(asked, "row_key", "left_semi").count() == 2
    # A replay of batch 1 sees what was there before it.
    assert known.candidates(digests(spark, [2400]), 1).join(digests(spark, [2400]), "row_key").count() == 0


def test_false_positives_are_looked_up_exactly(spark, tmp_path, monkeypatch):
    """Far too few bits for the digests: the filter says yes to nearly everything."""
    monkeypatch.setattr(index, "BITS", 64)
    known = index.DigestIndex(spark, str(tmp_path / "index"), digits=1, buckets=1)
    known.add(digests(spark, range(3000)), 0)
    new = digests(spark, range(2990, 3010))
    assert known.hit_prefixes(new, 1) == known.hit_prefixes(digests(spark, range(2990, 3010)), 1)
    assert set(known.hit_prefixes(digests(spark, range(3000, 3010)), 1)) == {r.row_key[0] for r in digests(spark, range(3000, 3010)).collect()}
    assert new.join(known.candidates(new, 1), "row_key", "left_anti").count() == 10


def test_indexed_stream_inserts_each_triple_once(spark, tmp_path):
    docs = spark.range(300).select(
        "id",
        F.concat(F.lit("o"), F.col("id") % 3).alias("srs_origin"),
        F.when(F.col("id") % 10 > 0, F.concat(F.lit("t"), F.col("id") % 7)).alias("srs_title"),
        F.when(F.col("id") % 50 > 0, F.concat(F.lit("c"), F.col("id") % 5)).alias("srs_content"),
    )
    there = docs.where("id < 20")
    stream = files_of(docs.coalesce(1), str(tmp_path / "in"), 3)
    out, state, folder = (str(tmp_path / name) for name in ("out", "state", "index"))
    for _ in range(2):
        index.insert_indexed(stream, "id", out, folder, state, there).awaitTermination()
    found = corpus_stream.inserted(spark, docs.schema, out).drop("id")
    assert same(found, insert_if_absent(docs, there, "id").drop("id"))
