"""Session settings and the two places where work is made durable."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "runloom", **conf: str) -> SparkSession:
    """A session with the settings this package is tuned for; ``conf`` wins."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local folder would be lost together with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return context.getCheckpointDir().rstrip("/")


_MADE: list[str] = []


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    folder = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    _MADE.append(folder)
    return folder


def drop_folders(spark: SparkSession) -> int:
    """Delete every folder that this process has asked for, and return how many there were.

    For the owner of the job, once no result that was built on them is read any more.
    """
    gone = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there.

    Used where a second evaluation could differ from the first: sampled range
    bounds, and answers from a completion function. A parquet table is evaluated
    once, compressed, and later readers only load the columns they use.
    """
    spark = df.sparkSession
    folder = new_folder(spark, "durable")
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
