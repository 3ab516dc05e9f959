"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import durable


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest node around it."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    return (
        both.join(least, "a")
        .where("b > a")
        .select(F.col("b").alias("b"), F.least("a", "least").alias("a"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, go to the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("least"))
    return (
        links.join(least, "b")
        .select(F.when(F.col("a") == F.col("least"), F.col("b")).otherwise(F.col("a")).alias("b"),
                F.col("least").alias("a"))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches; roots themselves are left out.

    ``links`` has non-null integer columns ``a`` < ``b``. Only minima per node are gathered, and
    a node with very many links is split by the skewed-join rule. Each round is a written table;
    the number of rounds grows with the logarithm of the longest path.
    """
    mark = (F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    now = durable(links.select("a", "b").distinct())
    seen = now.agg(*mark).first()
    while True:
        now = durable(_small_star(_large_star(now)))
        state = now.agg(*mark).first()
        if state == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = state
