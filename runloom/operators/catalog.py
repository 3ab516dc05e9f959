"""The model catalogue and everything that is looked up in it."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions.text import artifact_key, is_blank


class Model(NamedTuple):
    provider: str
    model: str
    api_id: str
    fixed_temperature: float | None = None


# The supported providers, display names, API names and the one
# model that only accepts its own temperature.
DEFAULT_MODELS = (
    Model("OpenAI", "GPT 4o mini", "gpt-4o-mini"),
    Model("OpenAI", "GPT 4o", "gpt-4o"),
    Model("OpenAI", "o1 mini", "o1-mini", 1.0),
    Model("Anthropic", "Claude 3.5 Haiku", "claude-3-5-haiku-latest"),
    Model("Anthropic", "Claude 3.5 Sonnet", "claude-3-5-sonnet-latest"),
)


def catalog(spark: SparkSession, models: Sequence[Model] = DEFAULT_MODELS) -> DataFrame:
    """(pos, provider, model, api_id, fixed_temperature), ordered by ``pos``.

    Built from Arrow so that Catalyst sees a local relation with its true size and
    decides about a broadcast from that.
    """
    table = pa.table(
        {
            "pos": pa.array(range(len(models)), pa.int64()),
            "provider": pa.array([m.provider for m in models], pa.string()),
            "model": pa.array([m.model for m in models], pa.string()),
            "api_id": pa.array([m.api_id for m in models], pa.string()),
            "fixed_temperature": pa.array([m.fixed_temperature for m in models], pa.float64()),
        }
    )
    return spark.createDataFrame(table)


def models_for(models: DataFrame, provider: str) -> DataFrame:
    """Models of one provider in catalogue order; none for an unknown provider."""
    return models.where(F.col("provider") == provider).orderBy("pos")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _entry(model: Model) -> str:
    fixed = model.fixed_temperature
    return (
        f"named_struct('llm_provider', {_quoted(model.provider)}, 'llm_model', {_quoted(model.model)},"
        f" 'api_id', {_quoted(model.api_id)},"
        f" 'fixed_temperature', cast({'null' if fixed is None else repr(float(fixed))} as double))"
    )


_ENTRY = "struct<llm_provider: string, llm_model: string, api_id: string, fixed_temperature: double>"


def _literals(models: Sequence[Model]) -> str:
    """The catalogue as one typed literal array of the plan, also when it is empty."""
    return f"cast(array({', '.join(map(_entry, models))}) as array<{_ENTRY}>)"


def with_models(df: DataFrame, models: Sequence[Model]) -> DataFrame:
    """Every row of ``df`` once per model; no rows for an empty catalogue.

    The catalogue is a literal array that is exploded where the rows are: neither a join nor
    an exchange.
    """
    entries = F.explode(F.expr(_literals(models))).alias("_model")
    return df.select("*", entries).select(*df.columns, "_model.*")


def _looked_up(models: Sequence[Model]) -> Column:
    """The catalogue entry of the row's provider and model, the first of equal ones, else NULL."""
    return F.expr(
        f"get(filter({_literals(models)}, m -> m.llm_provider = llm_provider"
        " and m.llm_model = llm_model), 0)"
    )


def is_run_of(models: Sequence[Model], temperature: float) -> Column:
    """Whether a row's provider, model and temperature are those of a run that ``runs_of`` makes."""
    return F.expr(
        f"exists({_literals(models)}, m -> m.llm_provider = llm_provider and m.llm_model = llm_model"
        f" and coalesce(m.fixed_temperature, cast({float(temperature)!r} as double)) = temperature)"
    )


def documents_to_run(corpus: DataFrame) -> DataFrame:
    """(srs_id, original_srs_text) of the documents that are not blank."""
    return corpus.where(~is_blank(F.col("srs_content"))).select(
        artifact_key(F.col("id"), F.col("srs_title")).alias("srs_id"),
        F.col("srs_content").alias("original_srs_text"),
    )


def runs_of(documents: DataFrame, models: Sequence[Model], temperature: float) -> DataFrame:
    """One run per document and model, keyed for the run log; other columns stay.

    A model with a fixed temperature overrides the requested one before anything
    is looked up or logged.
    """
    others = [name for name in documents.columns if name != "srs_id"]
    return with_models(documents, models).select(
        "srs_id",
        "llm_provider",
        "llm_model",
        F.coalesce("fixed_temperature", F.lit(float(temperature))).alias("temperature"),
        "api_id",
        *others,
    )


def fan_out(
    corpus: DataFrame, models: Sequence[Model], temperature: float, tasks: int | None = None
) -> DataFrame:
    """One run per document and model. Blank documents give no run.

    ``tasks`` spreads the documents over that many tasks first: a text moves once however long the
    catalogue, and its runs stay next to each other, where they compress to one.
    """
    documents = documents_to_run(corpus)
    if tasks is not None:
        # By the text too, or all documents without an id would gather.
        documents = documents.repartition(tasks, "srs_id", F.xxhash64("original_srs_text"))
    return runs_of(documents, models, temperature)


def effective_temperature(df: DataFrame, models: Sequence[Model]) -> DataFrame:
    """Replace ``temperature`` where the row's model has a fixed one."""
    fixed = _looked_up([m for m in models if m.fixed_temperature is not None])["fixed_temperature"]
    replaced = F.coalesce(fixed, "temperature").alias("temperature")
    return df.select(*[replaced if name == "temperature" else name for name in df.columns])


def resolve_api(df: DataFrame, models: Sequence[Model]) -> DataFrame:
    """Add ``api_id``, ``lookup_status`` and ``lookup_error`` for provider and model."""
    known = F.coalesce(
        F.col("llm_provider").isin(sorted({m.provider for m in models})), F.lit(False)
    )
    provider = F.coalesce("llm_provider", F.lit("None"))
    model = F.coalesce("llm_model", F.lit("None"))
    found = df.withColumn("api_id", _looked_up(models)["api_id"])
    return found.select(
        *df.columns,
        "api_id",
        F.when(~known, "unknown_provider")
        .when(F.col("api_id").isNull(), "unknown_model")
        .otherwise("ok")
        .alias("lookup_status"),
        F.when(~known, F.concat(F.lit("[Error] Unknown provider: "), provider))
        .when(
            F.col("api_id").isNull(),
            F.concat(F.lit("Error processing "), provider, F.lit(" request: '"), model, F.lit("'")),
        )
        .alias("lookup_error"),
    )
