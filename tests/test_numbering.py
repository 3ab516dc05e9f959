from __future__ import annotations

import random

from pyspark.sql import functions as F

from runloom.operators.numbering import BLOCK, positions, running_sum


def test_positions_with_a_hot_group(spark):
    rng = random.Random(7)
    rows = [
        (at, "hot" if rng.random() < 0.4 else f"g{rng.randrange(50)}", rng.randrange(200))
        for at in range(20000)
    ]
    rows += [(100000, None, 1), (100001, None, 2)]
    df = spark.createDataFrame(rows, "id long, g string, at long").repartition(8)
    found = {row.id: row.position for row in positions(df, "id", ["at"], ["g"]).collect()}
    groups: dict[str, list] = {}
    for row_id, group, at in rows:
        if group is not None:
            groups.setdefault(group, []).append((at, row_id))
    expected = {row_id: n for group in groups.values() for n, (_, row_id) in enumerate(sorted(group))}
    assert found == expected


def test_positions_of_one_single_group_use_many_tasks(spark):
    df = spark.range(200000).select("id", F.lit("same").alias("g"), F.lit(5).alias("at"))
    ranged = df.repartitionByRange(8, "g", "at", "id")
    sizes = [row["count"] for row in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 60000
    placed = positions(df, "id", ["at"], ["g"])
    assert placed.where(F.col("position") != F.col("id")).count() == 0
    assert placed.count() == 200000


def test_positions_without_groups_are_dense(spark):
    df = spark.range(0, 50000, 7).select((F.col("id") * -1).alias("id"))
    found = sorted((row.position, row.id) for row in positions(df, "id", ["id"]).collect())
    assert [position for position, _ in found] == list(range(len(found)))
    assert [row_id for _, row_id in found] == sorted(row_id for _, row_id in found)


def test_positions_of_nothing(spark):
    assert positions(spark.range(0), "id", ["id"]).count() == 0


def test_running_sum_across_blocks(spark):
    n = 3 * BLOCK + 17
    df = spark.range(n).select(F.lit("a").alias("g"), F.col("id").alias("seq"), (F.col("id") % 5).alias("v"))
    df = df.unionByName(spark.createDataFrame([("b", -3, 2), ("b", 4, 1)], "g string, seq long, v long"))
    found = {(r.g, r.seq): r.total for r in running_sum(df, "g", "seq", F.col("v"), "total").collect()}
    total = 0
    for at in range(n):
        total += at % 5
        assert found["a", at] == total
    assert (found["b", -3], found["b", 4]) == (2, 3)
