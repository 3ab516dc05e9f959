"""Completion calls that are many at a time, tried again, and never made twice for one request."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.operators.completion import Complete
from runloom.session import durable
from runloom.sources.tables import stored

CALLED = [T.StructField("reply", T.StringType()), T.StructField("attempts", T.IntegerType())]


def complete_retried(
    df: DataFrame,
    prompt: Column,
    make_client: Callable[[], Complete],
    in_flight: int = 8,
    attempts: int = 3,
    backoff: float = 0.5,
    limit: float = 60.0,
    per_second: float | None = None,
    calls: int | None = None,
) -> DataFrame:
    """Add ``reply`` and ``attempts`` by calling the user's function, ``in_flight`` calls at a time in a task.

    ``df`` has ``llm_provider``, ``api_id`` and ``temperature``. ``make_client`` runs once per task; what
    it makes is called from several threads. A call that raises is tried again, up to ``attempts`` times,
    after ``backoff`` seconds, twice that, and so on; then the error is the reply. A call that takes over
    ``limit`` seconds counts as failed and is not tried again; until it ends it still counts as in
    flight, so there are never more. ``per_second`` bounds the calls that a task begins in a second,
    repeated ones too. A NULL prompt is not asked: NULL and 0 attempts.

    Rows come back in their order. A task holds the rows of the calls in flight and of one Arrow batch.
    ``calls`` spreads the rows evenly over that many tasks, equal ones too; make the result durable before reading it twice.
    """
    if calls is not None:
        df = df.repartition(calls)
    kept = df.columns
    asked = df.select("*", prompt.alias("_prompt"))
    schema = T.StructType([*df.schema.fields, *CALLED])

    # Nested, so that it travels by value: executors need not have this package.
    def finished(call) -> tuple[str | None, int]:
        return (None, 0) if call is None else call.result()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import threading
        import time
        from collections import deque

        client = make_client()
        slots = threading.Semaphore(in_flight)
        clock = threading.Lock()
        next_start = [0.0]

        def wait_for_turn() -> None:
            if per_second is None:
                return
            with clock:
                begin = max(next_start[0], time.monotonic())
                next_start[0] = begin + 1 / per_second
            time.sleep(max(0.0, begin - time.monotonic()))

        class Call(threading.Thread):
            """One request, with all its attempts. A hanging one does not keep the worker alive."""

            def __init__(self, text, provider, api_id, temperature):
                super().__init__(daemon=True)
                self.request = (text, api_id, temperature)
                self.provider, self.tried, self.reply, self.begun = provider, 0, None, None
                self.given_up = False

            def run(self) -> None:
                try:
                    for number in range(attempts):
                        wait_for_turn()
                        if self.given_up:
                            return
                        self.tried, self.begun = number + 1, time.monotonic()
                        try:
                            self.reply = client(*self.request)
                            return
                        except Exception as problem:
                            self.reply = f"Error processing {self.provider} request: {problem}"
                        self.begun = None
                        if number + 1 < attempts:
                            time.sleep(backoff * 2**number)
                finally:
                    slots.release()

            def result(self) -> tuple[str | None, int]:
                while self.is_alive():
                    begun = self.begun
                    left = limit if begun is None else begun + limit - time.monotonic()
                    if left <= 0:
                        self.given_up = True
                        return f"Error processing {self.provider} request: no answer in {limit} s", self.tried
                    self.join(min(left, 1.0))
                return self.reply, self.tried

        def request(row) -> Call | None:
            if row[0] is None:
                return None
            slots.acquire()
            call = Call(*row)
            call.start()
            return call

        for batch in batches:
            names = ("_prompt", "llm_provider", "api_id", "temperature")
            rows = zip(*(batch.column(name).to_pylist() for name in names))
            open_calls: deque = deque()
            results = []
            for row in rows:
                # The oldest call is waited for first; that bounds calls and replies in hand.
                if len(open_calls) >= in_flight:
                    results.append(finished(open_calls.popleft()))
                open_calls.append(request(row))
            results += [finished(call) for call in open_calls]
            replies, tried = zip(*results) if results else ((), ())
            columns = [batch.column(name) for name in kept]
            columns += [pa.array(replies, pa.string()), pa.array(tried, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "reply", "attempts"])

    return asked.mapInArrow(answer, schema)


ANSWERS = T.StructType([T.StructField("request_key", T.StringType()), T.StructField("reply", T.StringType())])


def request_key(prompt: Column) -> Column:
    """The digest of what is asked: prompt, model and temperature. NULL without a prompt."""
    degrees = F.coalesce((F.col("temperature") + F.lit(0.0)).cast("string"), F.lit(""))
    api_id = F.coalesce("api_id", F.lit(""))
    told = F.concat(F.length(api_id), F.lit(":"), api_id, F.length(degrees), F.lit(":"), degrees, prompt)
    return F.sha2(told, 256)


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """(request_key, reply) of the answer store; empty before its first use."""
    return stored(spark, f"{folder}/*", ANSWERS)


def complete_once(
    df: DataFrame, prompt: Column, row_id: str, folder: str, ask: Callable[[DataFrame, Column], DataFrame]
) -> DataFrame:
    """Add ``reply`` and ``called``, asking for each distinct request once, ever.

    The answer store in ``folder`` is addressed by the digest of (prompt, api_id, temperature). Requests
    that it lacks are asked for by one row each, the one with the smallest ``row_id``, which is unique;
    ``ask(rows, prompt)`` adds ``reply`` to these rows, as ``complete_retried`` does. Their answers are
    appended to the store; a failure (``[Error]``, ``Error processing``) is given out but not stored, so
    it is asked for again next time. ``called`` marks the rows that made a call. A NULL prompt is
    not asked.

    Only digests and ids are grouped; equal requests shrink to one row per task before they move. One
    run at a time adds to a store.
    """
    spark = df.sparkSession
    keyed = df.withColumns({"_request": prompt, "request_key": request_key(prompt)})
    known = answers(spark, folder)
    slim = keyed.where(F.col("request_key").isNotNull()).groupBy("request_key").agg(F.min(row_id).alias(row_id))
    missing = slim.join(known.select("request_key"), "request_key", "left_anti").select(row_id)
    to_ask = keyed.join(missing, row_id, "left_semi")
    # Asked once: the answers are written down before anyone reads them.
    fresh = durable(ask(to_ask, F.col("_request")).select(row_id, "request_key", "reply"))
    failed = F.startswith("reply", F.lit("[Error]")) | F.startswith("reply", F.lit("Error processing "))
    good = fresh.where(F.col("reply").isNotNull() & ~failed)
    good.select(*ANSWERS.names).write.parquet(f"{folder}/run={uuid.uuid4().hex}")
    bad = fresh.where(F.col("reply").isNull() | failed)
    every = answers(spark, folder).unionByName(bad.select(*ANSWERS.names))
    called = fresh.select(F.col(row_id).alias("_asked"))
    marked = keyed.drop("_request").join(called, F.col(row_id) == F.col("_asked"), "left")
    # Rows without a request would gather under one NULL key.
    there = marked.where(F.col("request_key").isNotNull()).join(every, "request_key", "left")
    without = marked.where(F.col("request_key").isNull()).withColumn("reply", F.lit(None).cast("string"))
    return there.unionByName(without).select(*df.columns, "reply", F.col("_asked").isNotNull().alias("called"))
