"""Stages against brute force, and the registered queries of the subpackage against SQL."""

from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline as line
from runloom.llm import decontaminate, langid, queries
from tests.check import TABLES, compare, connect
from tests.llm.brute import without_repeats
from tests.llm.helpers import documents, rows, tokenizer_path, words
from tests.llm.test_langid import SOUNDS, speech
from tests.llm.test_simhash import brute_groups, brute_print


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    item = " ".join(words(30, 5, 10_000))
    passage = speech("bb", 77, 70)
    copied = speech("aa", 500, 120)
    data = [(k * 3 + i, speech(lang, k, 60), lang) for k in range(15) for i, lang in enumerate(SOUNDS)]
    data += [(100, copied, "aa"), (101, copied, "aa"), (102, copied, None), (102, copied, None)]
    data += [(110, speech("bb", 90) + " " + passage, "bb"), (111, speech("bb", 91) + " " + passage, "bb"), (112, passage, "bb")]
    data += [(120, speech("cc", 92) + " " + item, "cc"), (121, item, "cc")]
    data += [(130, None, "aa"), (131, "", "aa"), (132, "1234 5678", "aa"), (None, speech("aa", 93), "aa"), (133, speech("aa", 94, 9000), "aa")]
    documents(spark, data).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def kept_rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, columns = kept_rows(docs), docs.columns
    stages = dict(line.STAGES)
    assert list(stages) == ["language", "near_duplicates", "repeated_passages", "benchmark_passages", "sequences"]

    after = stages["language"](spark, docs, folder)
    model = langid.learn(docs.where(~langid.held_out(docs["doc_id"])))
    judge = langid._predict(model)
    import pyarrow as pa

    rejected = next(judge(iter([pa.array([t for _, t in before])]))).field("rejected").to_pylist()
    want = [row for row, r in zip(before, rejected) if not r]
    assert after.columns == columns and kept_rows(after) == want
    assert {d for d, _ in before} - {d for d, _ in want} <= {130, 131, 132, 120, 121}

    docs, before = after, want
    after = stages["near_duplicates"](spark, docs, folder)
    groups = brute_groups([brute_print(t) for _, t in before], 2)
    want = []
    for group in sorted(set(groups)):
        members = [r for r, g in zip(before, groups) if g == group]
        with_id = [r for r in members if r[0] is not None]
        want.append(min(with_id) if with_id else members[0])
    assert after.columns == columns and kept_rows(after) == sorted(want, key=repr)

    docs, before = after, kept_rows(after)
    after = stages["repeated_passages"](spark, docs, folder)
    want = []
    for (doc_id, own), (_, n, gone, _, left) in zip(before, without_repeats(before, True)):
        if not gone or gone < n:
            want.append((doc_id, left if gone else own))
    assert len(want) < len(before) and after.columns == columns and kept_rows(after) == sorted(want, key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())

    docs, before = after, kept_rows(after)
    after = stages["benchmark_passages"](spark, docs, folder)
    items = decontaminate.Items.of([(r[0], r[1]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()], 5)
    want = [(d, t) for d, t in before if not decontaminate.matches(t, items, 0.8)]
    assert after.columns == columns and kept_rows(after) == want

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    pieces = stages["sequences"](spark, after, folder).collect()
    got: dict = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        got[p["doc_id"]] = got.get(p["doc_id"], b"") + bytes(p["ids"])
    assert got == {
        d: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for d, t in want
    }


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in line.STAGES:
        docs = stage(spark, docs, folder)
    columns = ["doc_id", "doc_tokens"]
    want = set(rows(docs, *columns))
    assert want and want == set(rows(line.run(spark, folder), *columns))


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in line.STAGES:
        assert stage(spark, docs, folder).count() == 0


@pytest.fixture(scope="module")
def con():
    return connect(str(TABLES / "sf0.001"))


@pytest.mark.parametrize("name", ["op1_chat", "op7_top_k", "op8_repeated_words", "op9_repeated_bytes"])
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, str(TABLES / "sf0.001")) == ""


def test_queries_are_registered():
    names = set(queries.registered())
    assert names <= set(contract.queries()) and "pipeline" in names
    assert {n.split("_")[0] for n in names if n != "pipeline"} == {f"op{k}" for k in range(1, 14)}
