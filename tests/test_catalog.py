from __future__ import annotations

import pytest

from runloom.operators import catalog
from runloom.operators.catalog import DEFAULT_MODELS, Model
from tests.helpers import column, plan_of

DOCS = "id long, srs_title string, srs_content string"


def test_models_in_catalogue_order(spark):
    models = catalog.catalog(spark)
    assert models.count() == 5
    assert column(catalog.models_for(models, "OpenAI"), "model") == ["GPT 4o mini", "GPT 4o", "o1 mini"]
    assert catalog.models_for(models, "nobody").count() == 0


def test_fan_out_overrides_and_skips_blank(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "t", " \n"), (3, "t", None)], DOCS)
    runs = catalog.fan_out(docs, DEFAULT_MODELS, 0.2).collect()
    assert {(r.srs_id, r.llm_model, r.temperature) for r in runs} == {
        ("1_ab", m.model, m.fixed_temperature or 0.2) for m in DEFAULT_MODELS
    }


@pytest.mark.parametrize("length", [0, 1, 1000, 1001, 5000])
def test_catalogues_of_any_length(spark, length):
    models = [Model("p", f"m'{at}\\", f"api{at}") for at in range(length)]
    docs = spark.createDataFrame([(1, "t", "x"), (2, "t", "y")], DOCS)
    runs = catalog.fan_out(docs, models, 0.5)
    assert runs.count() == runs.select("srs_id", "llm_model").distinct().count() == 2 * length
    asked = spark.createDataFrame([("p", "m'0\\", 0.5), ("p", "x", 0.5)], "llm_provider string, llm_model string, temperature double")
    apis = sorted(column(catalog.resolve_api(asked, models), "api_id"), key=str)
    assert apis == ([None, "api0"] if length else [None, None])
    assert column(catalog.effective_temperature(asked, models), "temperature") == [0.5, 0.5]


def test_lookups_need_no_exchange(spark):
    asked = spark.createDataFrame([("OpenAI", "o1 mini", 0.5)], "llm_provider string, llm_model string, temperature double")
    plan = plan_of(catalog.resolve_api(catalog.effective_temperature(asked, DEFAULT_MODELS), DEFAULT_MODELS))
    assert "Exchange" not in plan and "Join" not in plan
    assert column(catalog.effective_temperature(asked, DEFAULT_MODELS), "temperature") == [1.0]


def test_lookup_states(spark):
    asked = spark.createDataFrame(
        [("OpenAI", "GPT 4o"), ("OpenAI", "GPT 9"), ("Nobody", "GPT 4o"), (None, "x")],
        "llm_provider string, llm_model string",
    )
    found = {(r.llm_provider, r.llm_model): r for r in catalog.resolve_api(asked, DEFAULT_MODELS).collect()}
    assert found["OpenAI", "GPT 4o"].api_id == "gpt-4o"
    assert found["OpenAI", "GPT 4o"].lookup_error is None
    assert found["OpenAI", "GPT 9"].lookup_error == "Error processing OpenAI request: 'GPT 9'"
    assert found["Nobody", "GPT 4o"].lookup_error == "[Error] Unknown provider: Nobody"
    assert found[None, "x"].lookup_status == "unknown_provider"
