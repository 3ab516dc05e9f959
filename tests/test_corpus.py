from __future__ import annotations

import json

import pytest

from pyspark.sql import functions as F

from runloom.operators import corpus
from runloom.sources import tables
from tests.helpers import column

TRIPLE = "id long, srs_origin string, srs_title string, srs_content string"


def triples(spark, rows):
    return spark.createDataFrame(rows, TRIPLE)


def test_ids_repeat_and_miss(spark):
    docs = triples(spark, [(1, "o", "a", "x"), (2, "o", "b", "y")])
    assert column(corpus.by_ids(docs, [2, 2, 999]), "id") == [2]
    assert corpus.by_ids(docs, []).count() == 0
    assert corpus.select_for_batch(docs, []).count() == 2
    assert corpus.select_for_batch(docs).columns == ["id", "srs_title", "srs_content"]
    many = spark.createDataFrame([(2,), (2,), (999,)], "id long")
    assert column(corpus.by_ids(docs, many), "id") == [2]
    for length in (1, 1000, 1001, 5000):
        assert column(corpus.by_ids(docs, list(range(2, 2 + length)) * 2), "id") == [2]
        for odd in (2.5, "2", None, True):
            with pytest.raises(TypeError):
                corpus.by_ids(docs, [odd] * length)


def test_last_entry_wins_and_keeps_the_first_place(spark):
    entries = spark.createDataFrame(
        [("a", 1, "old", "o1"), ("b", 2, "only", "o2"), ("a", 3, "new", "o3"), ("A", 4, "case", "o4"), (None, 5, "no title", "o5")],
        "title string, pos long, content string, origin string",
    )
    found = sorted(tuple(row) for row in corpus.from_entries(entries).collect())
    assert found == [
        (1, "o3", "a", "new"),
        (2, "o2", "b", "only"),
        (4, "o4", "A", "case"),
        (5, "o5", None, "no title"),
    ]


def test_entries_of_maps(spark):
    maps = spark.createDataFrame(
        [(1, {"a": ("x", "o"), "b": ("y", "o")}), (2, {"a": ("z", "p")})],
        "pos long, entries map<string, struct<content: string, origin: string>>",
    )
    found = corpus.from_entries(corpus.entries_of(maps))
    assert {(row.srs_title, row.srs_content) for row in found.collect()} == {("a", "z"), ("b", "y")}


def test_insert_if_absent(spark):
    stored = triples(spark, [(1, "o", "t", "x"), (2, "o", None, "n")])
    new = triples(
        spark,
        [
            (10, "o", "t", "x"),  # present
            (11, "o", "t", "y"),  # new
            (12, "o", "t", "y"),  # copy within the batch
            (13, "o", None, "n"),  # NULL never equals
            (14, "o", None, "n"),
            (15, "o", "T", "x"),  # case differs
            (16, "ot", "", "x"),  # parts must not run together
            (17, "o", "t", ""),
        ],
    )
    assert sorted(column(corpus.insert_if_absent(new, stored, "id"), "id")) == [11, 13, 14, 15, 16, 17]


def test_a_huge_group_of_copies_goes_in_once(spark):
    copies = spark.range(30000).select(
        "id",
        F.lit("o").alias("srs_origin"),
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("t").alias("srs_title"),
        F.lit("x").alias("srs_content"),
    )
    fresh = corpus.insert_if_absent(copies, copies.limit(0), "id")
    assert fresh.count() == 10001


def test_import_is_idempotent(spark, tmp_path):
    root, source = str(tmp_path / "root"), tmp_path / "entries.json"
    lines = [
        {"title": "b", "pos": 1, "content": "x", "origin": "o"},
        {"title": "a", "pos": 2, "content": "old", "origin": "o"},
        {"title": "a", "pos": 3, "content": "new", "origin": "o"},
    ]
    source.write_text("\n".join(json.dumps(line) for line in lines))
    for _ in range(2):
        tables.import_corpus(spark, tables.read_entries(spark, str(source)), root)
    stored = [tuple(row) for row in tables.corpus(spark, root).orderBy("id").collect()]
    assert stored == [(1, "o", "b", "x"), (2, "o", "a", "new")]


def test_import_into_a_corpus_without_digests(spark, tmp_path):
    root = str(tmp_path / "root")
    triples(spark, [(5, "o", "a", "x"), (6, "o", None, "n")]).write.parquet(tables.corpus_path(root))
    schema = "title string, pos long, content string, origin string"
    entries = spark.createDataFrame([("a", 1, "x", "o"), ("b", 2, "y", "o")], schema)
    for _ in range(2):
        tables.import_corpus(spark, entries, root)
    found = [(row.id, row.srs_title) for row in tables.corpus(spark, root).orderBy("id").collect()]
    assert found == [(5, "a"), (6, None), (7, "b")]


def test_import_goes_on_after_the_last_id(spark, tmp_path):
    root = str(tmp_path / "root")
    schema = "title string, pos long, content string, origin string"
    for pos, title in enumerate(["one", "two", "three"]):
        entries = spark.createDataFrame([(title, pos, "x", "o")], schema)
        tables.import_corpus(spark, entries, root)
    assert sorted(column(tables.corpus(spark, root), "id")) == [1, 2, 3]


ENTRIES = "title string, pos long, content string, origin string"


def test_positions_that_repeat_or_are_missing(spark, tmp_path):
    root = str(tmp_path / "root")
    first = [("A", 0, "a", "o"), ("B", 0, "b", "o"), ("C", None, "c", "o"), ("C", None, "d", "o"), (None, None, "n", "o")]
    tables.import_corpus(spark, spark.createDataFrame(first, ENTRIES), root)
    again = [("A", 0, "a", "o"), ("D", 0, "d", "o"), ("A", 0, "a", "o")]
    tables.import_corpus(spark, spark.createDataFrame(again, ENTRIES), root)
    found = [tuple(r) for r in tables.corpus(spark, root).orderBy("id").collect()]
    assert found == [
        (1, "o", None, "n"), (2, "o", "C", "d"), (3, "o", "A", "a"), (4, "o", "B", "b"), (5, "o", "D", "d"),
    ]


def test_missing_tables_read_as_empty(spark, tmp_path):
    assert tables.corpus(spark, str(tmp_path / "none")).count() == 0
    assert tables.run_log(spark, str(tmp_path / "none")).count() == 0
