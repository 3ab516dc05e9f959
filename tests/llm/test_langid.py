from __future__ import annotations

import random

from pyspark.sql import functions as F

from runloom.llm import langid, queries
from tests.check import TABLES
from tests.llm.helpers import documents, rows

SOUNDS = {"aa": "ka lo mi ra tu ".split(), "bb": "sch pf ung lich ein".split(), "cc": "éa oux ien tré çon".split()}


def speech(lang: str, seed: int, n: int = 40) -> str:
    draw = random.Random(f"{lang}{seed}")
    return " ".join("".join(draw.choices(SOUNDS[lang], k=draw.randint(1, 3))) for _ in range(n))


def sample(n: int = 20):
    return [(k * 3 + i, speech(lang, k), lang) for k in range(n) for i, lang in enumerate(SOUNDS)]


def test_languages_and_rejections(spark):
    model = langid.learn(documents(spark, sample()), per_language=15)
    asked = [(1000 + i, speech(lang, 99), lang) for i, lang in enumerate(SOUNDS)]
    odd = [(2000, None), (2001, ""), (2002, "12 345 ² ½ !? _"), (2003, "漢字 漢字"), (2004, speech("aa", 7, 60_000)),
           (2004, speech("aa", 7, 60_000)), (None, speech("bb", 1))]
    df = documents(spark, asked + odd)
    found = {}
    for r in df.select("doc_id", langid.identify(model, F.col("text")).alias("f")).collect():
        found.setdefault(r[0], []).append(tuple(r["f"]))
    for i, lang in enumerate(SOUNDS):
        ((got, score, rejected),) = found[1000 + i]
        assert got == lang and 0 < score <= 1 and not rejected
    for k in (2000, 2001, 2002):
        assert found[k] == [("und", 0.0, True)]
    ((got, score, rejected),) = found[2003]
    assert got in SOUNDS and rejected
    assert [f[0] for f in found[2004]] == ["aa", "aa"] and found[None][0][0] == "bb"


def test_sample_is_bounded_and_needs_labels(spark):
    many = sample(30) + [(None, "x", "dd"), (9000, None, "ee"), (9001, "text", None), (9002, "y" * 30_000, "ff")]
    known = langid.learn(documents(spark, many), per_language=5, longest=20_000)
    assert known.languages == ["aa", "bb", "cc"]
    nothing = langid.learn(documents(spark, []))
    df = documents(spark, [(1, "a word")])
    assert df.select(langid.identify(nothing, F.col("text"))["lang"]).first()[0] == "und"


def test_held_out_rows(spark):
    import zlib

    df = spark.createDataFrame([(k,) for k in [*range(100), -7, None]], "doc_id long")
    got = dict(rows(df.select("doc_id", langid.held_out(F.col("doc_id")).alias("h")), "doc_id", "h"))
    assert got.pop(None) is True
    assert all(h == (zlib.crc32(str(k).encode()) % 5 == 0) for k, h in got.items())


def test_held_out_accuracy(spark):
    sf = str(TABLES / "sf0.01")
    found = queries.op5_language(spark, sf).where("held_out")
    docs = queries.table(spark, sf, "documents").select("doc_id", "lang")
    joined = found.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.max("rejected"))
    accuracy, rejected = joined.first()
    assert accuracy >= 0.97 and not rejected
