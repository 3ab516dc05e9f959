"""The registered queries of this subpackage: one per operator, and the pipeline."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import corpus_pipeline
from runloom.llm import (
    chat,
    common,
    credentials,
    decontaminate,
    fm_index,
    html_text,
    langid,
    packing,
    repair,
    repeats,
    runs,
    simhash,
    suffix_array,
    token_file,
    topk,
)

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(build: Query) -> Query:
    _REGISTRY[build.__name__] = build
    return build


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


CONTROL_TEXT = "\\### Assistant: </turn> ok"


@query
def op1_chat(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    # Every row is a message of its own, also where turns repeat.
    place = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    events = rows.unionByName(added).select(
        "conv_id",
        F.row_number().over(place).alias("message"),
        F.lit(0).alias("seq"),
        F.lit("start").alias("kind"),
        "role",
        "text",
    )
    back = chat.read_back(chat.chat_texts(events))
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.array_join("loss_texts", "")
    return back.select(
        F.col("conversation").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(spoken, ""), 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op2_simhash(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"), words=3, radius=2)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


@query
def op3_decontaminate(spark, sf):
    return decontaminate.contaminated(
        table(spark, sf, "documents"), table(spark, sf, "benchmark")
    )


@query
def op4_packing(spark, sf):
    pieces = packing.pack_documents(table(spark, sf, "documents"), word_bpe(), 1, 2048)
    return pieces.select(
        "doc_id",
        "start",
        F.expr("octet_length(ids) div 4").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query
def op5_language(spark, sf):
    docs = table(spark, sf, "documents")
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        langid.held_out(F.col("doc_id")).alias("held_out"),
        langid.identify(model, F.col("text")).alias("found"),
    )
    return found.select(
        "doc_id",
        "held_out",
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.col("found.rejected").alias("rejected"),
    )


@query
def op6_main_text(spark, sf):
    found = html_text.main_text(table(spark, sf, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op7_top_k(spark, sf):
    return topk.top_k(table(spark, sf, "embeddings"), lambda vec_id: vec_id % 50 == 0, 5)


@query
def op8_repeated_words(spark, sf):
    found = fm_index.remove_repeated_words(table(spark, sf, "documents"), 50)
    return found.select(
        "doc_id", F.col("n").alias("n_words"), "n_removed", repeats.digest("kept").alias("kept_sha256")
    )


@query
def op9_repeated_bytes(spark, sf):
    found = suffix_array.remove_repeated_bytes(table(spark, sf, "documents"), 50)
    return found.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        "n_removed",
        "n_spans",
        repeats.digest("kept").alias("kept_sha256"),
    )


@query
def op10_token_file(spark, sf):
    manifest = token_file.write_token_files(table(spark, sf, "documents"), word_bpe(), 2)
    return token_file.read_digests(manifest)


@query
def op11_secrets(spark, sf):
    return credentials.digest_columns(credentials.scan(table(spark, sf, "documents")))


def made_periodic(texts: pd.Series, digests: pd.Series) -> pd.Series:
    """Words of the texts that are given, repeated with a period from some word on."""

    def made(text: str | None, h: int) -> str | None:
        words = (text or "").encode().split()
        if not words:
            return text
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n)).decode()

    return pd.Series([made(text, h) for text, h in zip(texts, digests)], dtype="object")


@query
def op12_periodic_runs(spark, sf):
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf, "documents").select("doc_id", "text", F.coalesce(h, F.lit(1)).alias("h"))
    chosen = F.col("h") % 10 == 0
    periodic = F.pandas_udf(made_periodic, "string")(F.when(chosen, F.col("text")), F.col("h"))
    found = runs.periodic_runs(docs.select("doc_id", F.when(chosen, periodic).otherwise(F.col("text")).alias("text")))
    # Greatest length, then smallest start, then smallest period.
    ranked = F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))
    top = F.array_max(ranked)
    length, start, period = top["length"], -top["col2"], -top["col3"]
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults by a checksum of conversation and turn; nulls become one space."""

    def told(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", told("conv_id"), told("turn")).cast("binary")) % 20
    text = (
        F.when(F.col("damage") == 1, "")
        .when(F.col("damage") == 2, F.translate(told("text"), ".!?", ""))
        .otherwise(told("text"))
    )
    copies = F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        rows.select("conv_id", "turn", "role", "text", kind.alias("damage"))
        .where(F.col("damage") != 0)
        .select(
            "conv_id",
            "turn",
            F.when(F.col("damage") == 4, "user").otherwise(told("role")).alias("role"),
            text.alias("text"),
            F.explode(copies).alias("copy"),
        )
        .drop("copy")
    )


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256): of each conversation's ``role:text`` lines, read as they stand, in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        out = common.Rows(schema)
        for conv_id, lines in groupby(rows, lambda row: row[0]):
            total, between = hashlib.sha256(), b""
            for _, role, text in lines:
                total.update(between + f"{role}:{text}".encode())
                between = b"\n"
            yield from out.add((conv_id, total.hexdigest()))
        yield from out.flush()

    return repaired.select("conv_id", "role", "text").mapInArrow(digest, "conv_id bigint, sha256 string")


@query
def op13_repair(spark, sf):
    rows = table(spark, sf, "conversations")
    summary, repaired = repair.repair(damaged(rows), rows)
    digests = conversation_digests(repaired).withColumnRenamed("conv_id", "_conv")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return summary.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        *summary.columns, F.coalesce("sha256", empty).alias("repaired_sha256")
    )


@query
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)
