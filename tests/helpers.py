from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runloom.schemas import RUN_LOG


def one(df: DataFrame):
    (row,) = df.collect()
    return row


def column(df: DataFrame, name: str) -> list:
    return [row[name] for row in df.collect()]


def log_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A run log from sparse rows; ``created_at`` is given in seconds."""
    import datetime

    names = RUN_LOG.names

    def value(row: dict, name: str):
        if name == "created_at":
            return datetime.datetime.fromtimestamp(row.get("at", 0), datetime.timezone.utc)
        return row.get(name)

    full = [{"llm_provider": "p", "llm_model": "m", "temperature": 0.5, **row} for row in rows]
    return spark.createDataFrame([tuple(value(r, n) for n in names) for r in full], RUN_LOG)


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
