"""Positions and running sums that never put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.session import durable

# Consecutive numbers of one group that are handled together: at most 1,024 rows.
BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS


def positions(
    df: DataFrame, row_id: str, order_by: Sequence[str], group_by: Sequence[str] = ()
) -> DataFrame:
    """(group_by..., row_id, position): how many rows of the group come before.

    Rows are range-partitioned on group and order, so a hot group is spread over
    as many tasks as its size asks for; each partition then only needs to know how
    many rows of its first group lie in earlier partitions. The bounds come from a
    sample, hence the durable copy: both readers must see one placement. Only the
    named columns travel. ``row_id`` is unique; rows with NULL in the group are
    left out.
    """
    group = list(group_by)
    order = [*group, *[name for name in order_by if name != row_id], row_id]
    slim = df.select(*order)
    for name in group:
        slim = slim.where(F.col(name).isNotNull())
    placed = durable(
        slim.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(*group, row_id, F.monotonically_increasing_id().alias("_at"))
    ).withColumn("_part", F.shiftright("_at", 33))
    pieces = placed.groupBy(*group, "_part").agg(
        F.min("_at").alias("_start"), F.count("*").alias("_rows")
    )
    # At most one piece per range partition within a group, so this window is small.
    earlier = (
        Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = pieces.select(
        *group,
        "_part",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_start")).alias("_shift"),
    )
    if not group:
        # One row per range partition: bounded by the partition count, not by the data.
        shifts = F.broadcast(shifts)
    return placed.join(shifts, [*group, "_part"]).select(
        *group, row_id, (F.col("_at") + F.col("_shift")).alias("position")
    )


def placed(rows: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """``rows`` in range partitions, ordered, written down once, with their place ``_at``.

    Places rise with the order and are consecutive within a partition. A number of the row's
    own is the last key, so that equal rows spread over partitions too.
    """
    return durable(
        rows.withColumn("_own", F.monotonically_increasing_id())
        .repartitionByRange(*order_by, "_own")
        .sortWithinPartitions(*order_by, "_own")
        .drop("_own")
        .withColumn("_at", F.monotonically_increasing_id())
    )


def numbered(rows: DataFrame, order_by: Sequence[str], after: int, out: str = "id") -> DataFrame:
    """Every row once, with consecutive numbers after ``after`` in ``out``, in the given order.

    NULLs come first and equal rows follow each other in any order; none of the columns has to be
    unique, and no row is looked up by them. Once the rows are placed, only the row counts per
    partition are summed and joined.
    """
    table = placed(rows, order_by).withColumn("_part", F.shiftright("_at", 33))
    pieces = table.groupBy("_part").agg(F.min("_at").alias("_start"), F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = pieces.select(
        "_part",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_start")).alias("_shift"),
    )
    # One row per range partition: bounded by the partition count, not by the data.
    return table.join(F.broadcast(shifts), "_part").select(
        *rows.columns, (F.col("_at") + F.col("_shift") + F.lit(after + 1)).alias(out)
    )


def block_of(seq: str) -> Column:
    return F.shiftright(F.col(seq).cast("long"), BLOCK_BITS)


def running_sum(df: DataFrame, group: str, seq: str, value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the group's rows up to this ``seq``.

    Rows are placed by group and ``seq``, whatever its gaps, and cut into blocks of at most
    ``BLOCK`` neighbours. The wide windows run within blocks; across blocks only one number
    per block is summed.
    """
    rows = placed(df.withColumn("_value", value), [group, seq])
    rows = rows.withColumn("_block", F.shiftright("_at", BLOCK_BITS))
    blocks = rows.groupBy(group, "_block").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        group, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")
    )
    inside = (
        Window.partitionBy(group, "_block")
        .orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets, [group, "_block"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_block", "_value", "_inside", "_before", "_at")
    )
