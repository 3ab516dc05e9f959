"""Corpus stream -> insert-if-absent by an index of digests that is read where it may matter only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runloom.operators.corpus import fresh_ids, row_key, stored_digests
from runloom.session import durable
from runloom.sources.tables import stored
from runloom.streaming.sinks import USE_UP, write_batch

DIGITS = 2  # digits of a digest, one at least, that name its partition: 256 of them
BUCKETS = 4  # bitmaps of 32,768 bits a partition's Bloom filter has
HASHES = 4
BITS = 32768
DIGESTS = "row_key string, batch long, prefix string"
FILTERS = "prefix string, bucket int, bits binary, batch long"


class DigestIndex:
    """Digests of stored rows in ``folder``, by prefix, with a Bloom filter for every prefix.

    ``folder/digests/batch=n/prefix=p`` are the digests that batch n added, ``folder/filters/batch=n`` is the
    whole filter as of batch n: 16^digits partitions of ``buckets`` bitmaps, whatever the number of rows. A
    batch reads what earlier batches wrote and replaces what it wrote itself, so a replay gives the
    same. A filter with few bits for its digests says more often that a partition may matter, never that it
    does not if it does; ``buckets`` follows the expected size (about 10 bits a digest). Both numbers
    belong to the folder and stay the same.
    """

    def __init__(self, spark: SparkSession, folder: str, digits: int = DIGITS, buckets: int = BUCKETS):
        self.spark, self.folder, self.digits, self.buckets = spark, folder, digits, buckets

    def prefix(self) -> Column:
        return F.left("row_key", F.lit(self.digits))

    def marks(self, digests: DataFrame) -> DataFrame:
        """(prefix, row_key, bucket, bit): the places of every digest in its prefix's filter."""
        places = F.array(*[F.pmod(F.xxhash64("row_key", F.lit(k)), F.lit(self.buckets * BITS)) for k in range(HASHES)])
        placed = digests.select(self.prefix().alias("prefix"), "row_key", F.explode(F.array_distinct(places)).alias("_at"))
        return placed.select(
            "prefix", "row_key", F.floor(F.col("_at") / BITS).cast("int").alias("bucket"), (F.col("_at") % BITS).alias("bit")
        )

    def filters(self, before: int) -> DataFrame:
        """(prefix, bucket, bits) as of the last batch before ``before``."""
        kept = stored(self.spark, f"{self.folder}/filters", FILTERS)
        return kept.where(F.col("batch") == before - 1).select("prefix", "bucket", "bits")

    def hit_prefixes(self, digests: DataFrame, before: int) -> list[str]:
        """The prefixes whose filter may know one of ``digests``: at most 16^digits short texts."""
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)) % 2 == 1
        marks = self.marks(digests)
        found = marks.join(self.filters(before), ["prefix", "bucket"], "left")
        known = found.groupBy("prefix", "row_key").agg(F.min(F.coalesce(is_set, F.lit(False))).alias("_all"))
        rows = known.where(F.col("_all")).select("prefix").distinct().collect()
        return sorted(row.prefix for row in rows)

    def candidates(self, digests: DataFrame, before: int) -> DataFrame:
        """(row_key): the stored digests of the partitions that may know one of ``digests``; the others are not read."""
        kept = stored(self.spark, f"{self.folder}/digests", DIGESTS)
        # Both are folder names: the filters choose folders, not rows.
        wanted = F.col("prefix").isin(self.hit_prefixes(digests, before)) & (F.col("batch") < before)
        return kept.where(wanted).select("row_key")

    def add(self, digests: DataFrame, batch: int) -> None:
        """Write the digests of a batch, and the filter with them."""
        digests = durable(digests.where(F.col("row_key").isNotNull()).select("row_key").distinct())
        by_prefix = digests.withColumn("prefix", self.prefix()).repartition("prefix")
        by_prefix.write.mode("overwrite").partitionBy("prefix").parquet(f"{self.folder}/digests/batch={batch}")
        new = self.marks(digests).groupBy("prefix", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        both = self.filters(batch).unionByName(new).groupBy("prefix", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        both.write.mode("overwrite").parquet(f"{self.folder}/filters/batch={batch}")


def insert_indexed(
    entries: DataFrame,
    row_id: str,
    folder: str,
    index: str,
    checkpoint: str,
    existing: DataFrame | None = None,
    trigger: dict | None = None,
    digits: int = DIGITS,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Append unseen (origin, title, content) rows of the stream to ``folder``, as ``insert_stream``.

    A micro-batch reads the filter, and of the stored digests those partitions that its own digests
    may be in; what the filter takes for known is looked up there exactly. ``existing`` are rows
    stored elsewhere that count as seen; they enter the index before the stream starts. Rows with a
    NULL in a key part never equal another row and are always appended.
    """
    spark = entries.sparkSession

    def insert(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        known = DigestIndex(session, index, digits, buckets)
        # What was there before the stream is batch 0 of the index.
        batch = batch_id + 1
        new = rows.withColumn("row_key", row_key())
        digests = new.where(F.col("row_key").isNotNull()).select("row_key").distinct()
        stored_keys = known.candidates(digests, batch)
        fresh = durable(new.join(fresh_ids(new, stored_keys, row_id), row_id, "left_semi"))
        known.add(fresh, batch)
        write_batch(fresh, batch_id, folder)

    if stored(spark, f"{index}/filters", FILTERS).limit(1).isEmpty():
        start = spark.createDataFrame([], "row_key string") if existing is None else stored_digests(existing)
        DigestIndex(spark, index, digits, buckets).add(start, 0)
    return (
        entries.writeStream.foreachBatch(insert)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or USE_UP))
        .start()
    )
