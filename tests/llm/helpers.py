from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that the operators use inside.
CLASHING = (
    "key version place kind blob found kept left n fp root mask component_id task open start group"
    " id rank size members least"
).split()
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows: list[tuple], clashing: bool = True) -> DataFrame:
    """Documents from (doc_id, text[, lang]); with columns whose names the operators use."""
    full = [
        (r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows
    ]
    df = spark.createDataFrame(full, DOCUMENTS)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING)) if clashing else df


def words(n: int, seed: int, vocabulary: int = 500) -> list[str]:
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def text(n: int, seed: int, vocabulary: int = 500) -> str:
    return " ".join(words(n, seed, vocabulary))


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
