"""Corpus operators: selection, last entry per title, insert-if-absent."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.schemas import CORPUS_KEY


def by_ids(corpus: DataFrame, ids: Sequence[int] | DataFrame) -> DataFrame:
    """Documents with the given ids; none for an empty list.

    A list of integers becomes an IN filter that reaches the scan, whatever its length;
    anything else in it is an error. A DataFrame with an ``id`` column is joined and may be
    of any size.
    """
    if isinstance(ids, DataFrame):
        chosen = corpus.join(ids, "id", "left_semi")
    else:
        odd = [value for value in ids if not isinstance(value, int) or isinstance(value, bool)]
        if odd:
            raise TypeError(f"document ids are integers, not {odd[0]!r}")
        listed = ", ".join(f"{value}L" for value in sorted(set(ids)))
        chosen = corpus.where(F.expr(f"id IN ({listed})") if listed else F.lit(False))
    return chosen.select("id", "srs_title", "srs_content")


def select_for_batch(corpus: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """The batch rule: no ids, or an empty list, means the whole corpus."""
    return by_ids(corpus, ids) if ids else corpus.select("id", "srs_title", "srs_content")


def entries_of(maps: DataFrame) -> DataFrame:
    """(pos, entries) rows of title -> {content, origin} maps to one row per entry.

    The result's ``pos`` orders by the row's pos, then by the place in its map.
    """
    rows = maps.select("pos", F.posexplode(F.map_entries("entries")).alias("_at", "_entry"))
    return rows.select(
        F.col("_entry.key").alias("title"),
        F.struct("pos", "_at").alias("pos"),
        F.col("_entry.value.content").alias("content"),
        F.col("_entry.value.origin").alias("origin"),
    )


def from_entries(entries: DataFrame) -> DataFrame:
    """Entries (title, pos, content, origin) to one row per title, the last one winning.

    ``pos`` in the result is the title's first position, which is its place in the import. A
    missing pos comes before all others; entries of one title and pos are told apart by
    content and origin, the larger one winning, so no entry needs a position of its own.
    The rank is limited before the exchange: of a title's texts, one per map task moves.
    """
    first = entries.groupBy(F.col("title").alias("_title")).agg(
        F.when(F.count("*") == F.count("pos"), F.min("pos")).alias("_first")
    )
    newest = Window.partitionBy("title").orderBy(
        F.desc_nulls_last("pos"), F.desc_nulls_last("content"), F.desc_nulls_last("origin")
    )
    last = entries.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") == 1)
    return last.join(first, F.col("title").eqNullSafe(F.col("_title"))).select(
        F.col("_first").alias("pos"),
        F.col("origin").alias("srs_origin"),
        F.col("title").alias("srs_title"),
        F.col("content").alias("srs_content"),
    )


def row_key(keys: Sequence[str] = tuple(CORPUS_KEY)) -> Column:
    """One fixed-size digest per row; NULL as soon as any part is NULL."""
    return F.sha2(F.concat(*[F.sha2(F.col(name), 256) for name in keys]), 256)


def stored_digests(existing: DataFrame, keys: Sequence[str] = tuple(CORPUS_KEY)) -> DataFrame:
    """(row_key) of stored rows: as stored, else computed from the texts.

    Rows without a stored digest are a branch of their own. Its filter reaches the
    row groups' null counts, so texts are only read where digests are missing.
    """
    if "row_key" not in existing.columns:
        return existing.select(row_key(keys).alias("row_key"))
    missing = F.col("row_key").isNull()
    computed = existing.where(missing).select(row_key(keys).alias("row_key"))
    return existing.where(~missing).select("row_key").union(computed)


def fresh_ids(
    new: DataFrame, stored: DataFrame, row_id: str, keys: Sequence[str] = tuple(CORPUS_KEY)
) -> DataFrame:
    """``row_id`` of the rows of ``new`` to insert: absent, and the first of their copies.

    ``stored`` holds digests in ``row_key``. Keys compare with plain equality, so a row
    with NULL in any of them always goes in. Digests stand for the long texts. Both
    sides' digests are stacked and grouped once, combined map-side, so a large group
    of copies costs one row per map task. ``row_id`` is unique in ``new``. Digests that ``new``
    carries in ``row_key`` are taken as they are.
    """
    known = "row_key" in new.columns
    digests = new.select(row_id, "row_key" if known else row_key(keys).alias("row_key"))
    present = stored.select("row_key", F.lit(True).alias("_present"))
    first = (
        digests.unionByName(present, allowMissingColumns=True)
        .where(F.col("row_key").isNotNull())
        .groupBy("row_key")
        .agg(F.max("_present").alias("_present"), F.min(row_id).alias(row_id))
        .where(F.col("_present").isNull())
        .select(row_id)
    )
    # Asked of the parts, so that no digest is made a second time.
    parts = [F.col(name).isNull() for name in keys]
    without_key = F.col("row_key").isNull() if known else reduce(or_, parts)
    return first.unionByName(new.where(without_key).select(row_id))


def insert_if_absent(
    new: DataFrame, existing: DataFrame, row_id: str, keys: Sequence[str] = tuple(CORPUS_KEY)
) -> DataFrame:
    """The rows of ``new`` to append."""
    fresh = fresh_ids(new, stored_digests(existing, keys), row_id, keys)
    return new.join(fresh, row_id, "left_semi")


def skipped(new: DataFrame, fresh: DataFrame, row_id: str) -> DataFrame:
    """Origin and title of the rows that ``insert_if_absent`` left out."""
    rows = new.select(row_id, "srs_origin", "srs_title")
    return rows.join(fresh.select(row_id), row_id, "left_anti")
