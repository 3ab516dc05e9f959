"""Chunk stream -> how far each reply reads, chunk by chunk, in sequence order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The state lives in RocksDB, on the executor's disk and in the checkpoint, not in its heap.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUNNING = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("end_at", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("state", T.StringType()),
    ]
)
BLOCK_CHARS = 1 << 14


def use_rocksdb(spark: SparkSession) -> None:
    """Choose the state store that running texts need; for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def running(
    chunks: DataFrame,
    delay: str,
    patience: float | None = None,
    digests: bool = True,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(request_id, seq, end_at, digest, state) for every chunk, as soon as all before it are there.

    ``chunks`` is a stream of (request_id, seq, chunk, last, at). Sequence numbers count from 0 without
    gaps and may come in any order and in any micro-batch; of repeated ones the first counts. ``end_at``
    is the length of the text so far, ``digest`` its MD5, ``state`` is ``running``, or ``done`` for the
    chunk marked ``last``. A null chunk is empty; rows without a request, a sequence number or a time
    are left out.

    The watermark is ``delay`` behind the newest time ``at``. A request whose newest chunk is
    ``patience`` seconds behind the watermark is given up: one row says ``abandoned``, with the number of
    the first missing chunk, and its state goes; rows behind the watermark are late and dropped. Without
    ``patience`` no row is late, requests wait for ever, and one short row of state of each finished
    one stays.

    A row of state is a waiting chunk, a block of at most ``block_chars`` characters, or the cursor
    with the block being filled; a task holds one request's waiting chunks up to a block. For the digest a micro-batch reads the earlier blocks of the requests it
    brings something for, one after the other; without ``digests`` no text that was counted is kept.
    """
    # Nested, so that it travels by value: executors need not have this package.
    import hashlib

    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    class Reader(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            # next number, length so far, text of the open block, whether done, when to give up
            self.cursor = handle.getValueState(
                "cursor", "next long, end_at long, open string, done boolean, until long"
            )
            self.blocks = handle.getListState("blocks", "text string")
            self.waiting = handle.getMapState("waiting", "seq long", "chunk string, last boolean")

        def handleInputRows(self, key, rows, timerValues):
            self.load()
            held, size, newest = {}, 0, 0
            for row in rows:
                newest = max(newest, row.at_ms)
                if self.done or row.seq < self.next or row.seq in held:
                    continue
                held[row.seq] = (row.chunk or "", bool(row.last))
                size += len(held[row.seq][0])
                yield from self.read_on(key[0], held)
                # What has to wait is kept in the state, not in memory, once it is much.
                if size > block_chars:
                    self.keep(held)
                    size = 0
            yield from self.read_on(key[0], held)
            if self.done:
                self.forget()
            else:
                self.keep(held)
            if patience is not None:
                self.wait_until(newest + int(patience * 1000))
            self.cursor.update((self.next, self.end_at, self.open, self.done, self.until))

        def load(self) -> None:
            known = tuple(self.cursor.get()) if self.cursor.exists() else (0, 0, "", False, 0)
            self.next, self.end_at, self.open, self.done, self.until = known
            self.total = None
            # Whether the state may have chunks that come next.
            self.stored = not self.done

        def read_on(self, request_id, held):
            """Give out the chunks that follow the cursor without a gap."""
            while not self.done:
                found = held.pop(self.next, None)
                if self.stored and self.waiting.containsKey((self.next,)):
                    found = tuple(self.waiting.getValue((self.next,)))
                    self.waiting.removeKey((self.next,))
                elif found is None:
                    # Until the cursor moves again there is nothing to look for.
                    self.stored = False
                    return
                self.stored = True
                chunk, self.done = found
                self.end_at += len(chunk)
                digest = self.read(chunk)
                state = "done" if self.done else "running"
                yield Row(request_id=request_id, seq=self.next, end_at=self.end_at, digest=digest, state=state)
                self.next += 1

        def read(self, chunk: str):
            """The digest of the text with ``chunk``, which is kept in blocks."""
            if not digests:
                return None
            total = self.digest_so_far()
            total.update(chunk.encode())
            self.open += chunk
            while len(self.open) >= block_chars:
                self.blocks.appendValue((self.open[:block_chars],))
                self.open = self.open[block_chars:]
            return total.hexdigest()

        def digest_so_far(self):
            if self.total is None:
                self.total = hashlib.md5()
                for (block,) in self.blocks.get():
                    self.total.update(block.encode())
                self.total.update(self.open.encode())
            return self.total

        def keep(self, held) -> None:
            for seq, value in held.items():
                if not self.waiting.containsKey((seq,)):
                    self.waiting.updateValue((seq,), value)
            held.clear()

        def forget(self) -> None:
            self.blocks.clear()
            self.waiting.clear()
            self.open = ""

        def wait_until(self, later: int) -> None:
            if later > self.until:
                if self.until:
                    self.handle.deleteTimer(self.until)
                self.handle.registerTimer(later)
                self.until = later

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.load()
            if not self.done:
                digest = self.digest_so_far().hexdigest() if digests else None
                yield Row(
                    request_id=key[0], seq=self.next, end_at=self.end_at, digest=digest, state="abandoned"
                )
            self.forget()
            self.cursor.clear()

        def close(self) -> None:
            pass

    use_rocksdb(chunks.sparkSession)
    rows = chunks.where(F.col("request_id").isNotNull() & F.col("seq").isNotNull() & F.col("at").isNotNull())
    return (
        rows.select(
            F.col("request_id").cast("long").alias("request_id"),
            F.col("seq").cast("long").alias("seq"),
            "chunk",
            "last",
            "at",
            F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"),
        )
        .withWatermark("at", delay)
        .groupBy("request_id")
        .transformWithState(Reader(), RUNNING, "append", "eventTime" if patience is not None else "none")
    )
