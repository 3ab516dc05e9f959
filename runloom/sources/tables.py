"""Stored tables: parquet folders below one root, read with explicit schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.operators.corpus import fresh_ids, from_entries, row_key, stored_digests
from runloom.operators.numbering import numbered
from runloom.schemas import CORPUS, RUN_LOG
from runloom.session import durable

# The stored corpus carries its digests, so an import never re-reads old texts.
STORED_CORPUS = T.StructType([*CORPUS.fields, T.StructField("row_key", T.StringType())])

# One corpus entry per line of a JSON file.
ENTRIES = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("origin", T.StringType()),
    ]
)


def corpus_path(root: str) -> str:
    return f"{root}/srs_data"


def run_log_path(root: str) -> str:
    return f"{root}/usage_logs"


def ensure_tables(spark: SparkSession, root: str) -> None:
    """Create both tables where they are absent; existing ones stay as they are."""
    for path, schema in ((corpus_path(root), STORED_CORPUS), (run_log_path(root), RUN_LOG)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table; one that nobody has created yet reads as empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """(id, srs_origin, srs_title, srs_content)."""
    return stored(spark, corpus_path(root), STORED_CORPUS).select(*CORPUS.names)


def run_log(spark: SparkSession, root: str) -> DataFrame:
    return stored(spark, run_log_path(root), RUN_LOG)


def create_views(spark: SparkSession, root: str) -> None:
    """Temporary views ``srs_data`` and ``usage_logs`` for plain SQL."""
    corpus(spark, root).createOrReplaceTempView("srs_data")
    run_log(spark, root).createOrReplaceTempView("usage_logs")


def conform_runs(rows: DataFrame, row_id: str) -> DataFrame:
    """Run rows in the log's columns and types, absent ones NULL, ``row_id`` kept."""

    def column(field: T.StructField) -> Column:
        if field.name == "created_at" and field.name not in rows.columns:
            return F.date_trunc("second", F.current_timestamp())
        if field.name not in rows.columns:
            return F.lit(None).cast(field.dataType)
        return F.col(field.name).cast(field.dataType)

    names = [field for field in RUN_LOG if field.name != "id"]
    return rows.select(
        F.col(row_id).alias("_row"), *[column(field).alias(field.name) for field in names]
    )


def last_id(table: DataFrame) -> int:
    """The largest id, 0 for an empty table: one number comes to the driver."""
    return table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def append_runs(spark: SparkSession, rows: DataFrame, root: str, row_id: str) -> None:
    """Append run rows in ``row_id`` order; id is the next integer, created_at is now unless given.

    Every row is appended once: ``row_id`` only orders, and may be NULL or repeat. One writer at
    a time, as with any append to a plain parquet table.
    """
    last = last_id(run_log(spark, root))
    placed = numbered(conform_runs(rows, row_id), ["_row"], last)
    placed.select(*RUN_LOG.names).write.mode("append").parquet(run_log_path(root))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Corpus entries (title, pos, content, origin) from JSON lines."""
    return spark.read.schema(ENTRIES).json(path)


def import_corpus(spark: SparkSession, entries: DataFrame, root: str) -> None:
    """Append the entries whose (origin, title, content) is not stored yet."""
    ensure_tables(spark, root)
    present = stored(spark, corpus_path(root), STORED_CORPUS)
    new = from_entries(entries).withColumns(
        {"row_key": row_key(), "_own": F.monotonically_increasing_id()}
    )
    staged = durable(new)
    known = staged.select("_own", "row_key")
    losers = known.join(fresh_ids(known, stored_digests(present), "_own"), "_own", "left_anti")
    # A title stands in one row, so titles settle the order of equal positions.
    fresh = staged.join(losers, "_own", "left_anti").drop("_own")
    placed = numbered(fresh, ["pos", "srs_title"], last_id(present))
    placed.select(*STORED_CORPUS.names).write.mode("append").parquet(corpus_path(root))
