"""From raw documents to packed training sequences, in five stages.

Each stage takes and returns the columns of ``documents``, whatever they are beside ``doc_id``
and ``text``; the last returns pieces of sequences. Stages are written as Parquet to the shared
folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import decontaminate, fm_index, langid, packing, simhash
from runloom.session import new_folder

END_ID = 1
SEQUENCE_IDS = 2048
NO_ID = -(1 << 63)


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``docs`` does not use."""
    taken = {name.lower() for name in docs.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def _keyed(docs: DataFrame, key: str, version: str) -> DataFrame:
    """``docs`` with columns that tell documents apart, also those without an id."""
    return docs.withColumns(
        {key: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), version: F.xxhash64("text")}
    )


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no text, no letter, or unlike all languages."""
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    (found,) = _free_names(docs, "found")
    marked = docs.withColumn(found, langid.identify(model, F.col("text"))["rejected"])
    return marked.where(~F.col(found)).drop(found)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that with the smallest id, and one row of it."""
    key, version = _free_names(docs, "key", "version")
    groups = simhash.near_duplicates(docs, words=3, radius=2)
    chosen = (
        groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root", F.coalesce("doc_id", F.lit(NO_ID)).alias(key))
        .agg(F.min("version").alias(version))
        .select(key, version)
    )
    kept = _keyed(docs, key, version).join(chosen, [key, version], "left_semi")
    return kept.dropDuplicates([key, version]).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words that an earlier document has; drops documents without a rest.

    Untouched texts stay as they are; of the others the remaining words stay, joined by a space.
    """
    key, version, kept, left = _free_names(docs, "key", "version", "kept", "left")
    cut = (
        fm_index.remove_repeated_words(docs, 50)
        .where("n_removed > 0")
        .select(
            F.coalesce("doc_id", F.lit(NO_ID)).alias(key),
            F.col("version").alias(version),
            F.col("kept").alias(kept),
            (F.col("n") - F.col("n_removed")).alias(left),
        )
        .dropDuplicates([key, version])
    )
    joined = _keyed(docs, key, version).join(cut, [key, version], "left")
    joined = joined.where(F.col(left).isNull() | (F.col(left) > 0))
    changed = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        length = F.length(kept).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.coalesce(length, F.col("n_chars"))
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents: a row per piece, with its ids."""
    pieces = packing.pack_documents(docs, tokenizer(), END_ID, SEQUENCE_IDS)
    return pieces.select(
        "doc_id",
        "start",
        F.expr("octet_length(ids) div 4").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "ids",
    )


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("sequences", sequences),
]
# Models, tokenizers and hashes take part: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
