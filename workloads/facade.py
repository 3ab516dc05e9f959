"""The stored tables' shapes, derived from the given parquet tables by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.operators.catalog import Model, effective_temperature, with_models
from runloom.operators.corpus import select_for_batch
from runloom.functions.text import artifact_key

MODELS = (
    Model("pA", "m0", "api-m0"),
    Model("pA", "m1", "api-m1"),
    Model("pA", "m2", "api-m2", 1.0),
    Model("pB", "m3", "api-m3"),
    Model("pB", "m4", "api-m4"),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("srs_origin"),
        F.concat("lang", F.lit(" doc "), "doc_id").alias("srs_title"),
        F.col("text").alias("srs_content"),
    )


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Titles clash: one per source and language."""
    return documents(spark, sf).select(
        F.concat("source", F.lit("/"), "lang").alias("title"),
        F.col("doc_id").alias("pos"),
        F.col("text").alias("content"),
        F.col("source").alias("origin"),
    )


def triples(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose (origin, title, content) has real copies, some titles NULL."""
    return documents(spark, sf).select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("srs_origin"),
        F.when(F.col("n_chars") >= 200, F.col("lang")).alias("srs_title"),
        F.col("text").alias("srs_content"),
    )


def labelled_triples(spark: SparkSession, sf: str) -> DataFrame:
    """What is stored already: the documents that carry a label."""
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return triples(spark, sf).join(labelled, "id", "left_semi")


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").selectExpr(
        "event_id as id",
        "event_type",
        "if(event_id % 5 < 3, 'pA', 'pB') as llm_provider",
        "concat('m', event_id % 5) as llm_model",
        "(event_id % 2) * 0.5D as temperature",
        "if(value < 1, null, cast(user_id as string)) as srs_id",
        "if(value < 2, null, concat('requirements of ', user_id, ': ', props)) as original_srs_text",
        "case event_type when 'error' then null when 'view' then ' ' else props end "
        "as distilled_srs_text",
        "value as similarity_score_orig_srs",
        "if(event_type = 'error', null, cast(props as binary)) as uml_image_data_orig_srs",
        "concat('@startuml\\nclass U', user_id, '\\n@enduml') as plantuml_script_orig_srs",
        "concat('system ', user_id) as extracted_uml_descr_orig_srs",
        "concat('found ', event_type) as similarity_descr_orig_srs",
        "value * 0.5D as similarity_score_dist_srs",
        "cast(event_type as binary) as uml_image_data_dist_srs",
        "concat('@startuml\\nclass D', user_id, '\\n@enduml') as plantuml_script_dist_srs",
        "concat('core ', user_id) as extracted_uml_descr_dist_srs",
        "props as similarity_descr_dist_srs",
        "ts as created_at",
    )
    return effective_temperature(log, MODELS)


def requested_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer number as an artifact, for every model, at temperature 0.5."""
    ids = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("srs_id"))
    return with_models(ids, MODELS).select(
        "srs_id", "llm_provider", "llm_model", F.lit(0.5).alias("temperature")
    )


def json_report() -> Column:
    return F.expr(
        """concat('{"extracted_description":"In ', lang, ' from ', source,
                  '","similarity_score":', n_chars % 101,
                  ',"discrepancies":["- ', lang, '","- ', source,
                  '"],"missing_elements":[],"additional_elements":["', n_chars, ' characters"]}')"""
    )


def similarity_reply(shape: Column) -> Column:
    """Ten ways in which a model answers; five of them are accepted."""
    report = json_report()
    n, lang, source = F.col("n_chars"), F.col("lang"), F.col("source")
    return (
        F.when(shape == 0, F.concat(F.lit("```json\n"), report, F.lit("\n```")))
        .when(shape == 1, report)
        .when(shape == 2, F.concat(F.lit("```\n"), report, F.lit("\n```")))
        .when(shape == 3, F.concat(report, F.lit(" Hope this helps.")))
        .when(shape == 4, F.lit("{}"))
        .when(shape == 5, F.concat(F.lit("[Error] no key for "), source))
        .when(shape == 6, F.concat(F.lit('{"similarity_score":"'), n, F.lit('"}')))
        .when(shape == 7, F.concat(F.lit('{"discrepancies":"'), lang, F.lit('"}')))
        .when(
            shape == 8,
            F.concat(
                F.lit('{"discrepancies":null,"missing_elements":["'), source, F.lit('"]}\n```')
            ),
        )
        .otherwise(F.concat(F.lit("["), report, F.lit("]")))
    )


def script_reply(shape: Column) -> Column:
    """Five marker layouts around the whole text."""
    text = F.col("text")
    return (
        F.when(shape == 0, F.concat(F.lit("Here:\n@startuml\n"), text, F.lit("\n@enduml\nbye")))
        .when(
            shape == 1,
            F.concat(
                F.lit("@startuml\nA\n@enduml\nthen\n@startuml\n"), text, F.lit("\n@enduml")
            ),
        )
        .when(shape == 2, F.concat(F.lit("@enduml "), text, F.lit(" @startuml")))
        .when(shape == 3, F.concat(F.lit("\n  @startuml\n"), text))
        .otherwise(text)
    )


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text, reply, script_reply) per document."""
    return documents(spark, sf).select(
        F.col("doc_id").alias("id"),
        "text",
        similarity_reply(F.col("doc_id") % 10).alias("reply"),
        script_reply(F.col("doc_id") % 5).alias("script_reply"),
    )


def recorded_responses(spark: SparkSession, sf: str) -> DataFrame:
    """(run key, stage, flow, response) for the five requests of each document and model.

    Failures of every kind occur: error texts, blank and missing answers, replies
    without a script, reports that are no JSON.
    """
    runs = with_models(documents(spark, sf), MODELS).select(
        artifact_key(
            F.col("doc_id"), F.concat("lang", F.lit(" doc "), "doc_id")
        ).alias("srs_id"),
        "llm_provider",
        "llm_model",
        F.coalesce("fixed_temperature", F.lit(0.5)).alias("temperature"),
        "doc_id",
        "text",
        "lang",
        "source",
        "n_chars",
        F.substr("llm_model", F.lit(2)).cast("long").alias("m"),
    )
    shape = F.col("doc_id") + F.col("m")
    texts = runs.withColumns(
        {
            "similar_orig": similarity_reply(shape % 10),
            "similar_dist": similarity_reply((shape + 4) % 10),
        }
    ).selectExpr(
        "srs_id",
        "llm_provider",
        "llm_model",
        "temperature",
        """stack(5,
            'generate', 'orig', if(doc_id % 17 = m, 'no diagram',
                concat('ok @startuml\\nclass C', doc_id, '\\n@enduml ', llm_model)),
            'distil', 'orig', case when doc_id % 19 = m then '[Error] busy'
                when doc_id % 23 = m then ' \\n' else concat('short: ', text) end,
            'similarity', 'orig', similar_orig,
            'generate', 'dist', concat('@startuml\\nclass S', doc_id, '\\n@enduml'),
            'similarity', 'dist', if(doc_id % 29 = m, null, similar_dist)
        ) as (stage, flow, response)""",
    )
    return texts.where(F.col("response").isNotNull())


def backfeed_responses(spark: SparkSession, sf: str) -> DataFrame:
    """(run key, stage, flow, response) for one more round of every requested key."""
    keys = effective_temperature(requested_keys(spark, sf), MODELS)
    return keys.selectExpr(
        "srs_id",
        "llm_provider",
        "llm_model",
        "temperature",
        """stack(4,
            'generate', 'orig', concat('@startuml\\nclass N', srs_id, '\\n@enduml'),
            'generate', 'dist', concat('@startuml\\nclass P', srs_id, '\\n@enduml'),
            'similarity', 'orig', concat('{"similarity_score":', srs_id, '}'),
            'similarity', 'dist', if(llm_model = 'm4', 'no JSON',
                concat('```json {"discrepancies":["', srs_id, '"]}```'))
        ) as (stage, flow, response)""",
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.col("text").alias("chunk")
    )


def image_log(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as images; toxic ones were never rendered."""
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    return (
        documents(spark, sf)
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"),
            F.when(F.coalesce("toxic", F.lit(0)) == 0, F.col("text").cast("binary")).alias(
                "uml_image_data_orig_srs"
            ),
        )
    )


def batch_documents(spark: SparkSession, sf: str) -> DataFrame:
    return select_for_batch(corpus(spark, sf))
