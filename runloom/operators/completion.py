"""Answers for request rows: recorded in a table, or from the user's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.functions.text import reply_status
from runloom.schemas import RUN_KEY

# (prompt, api_id, temperature) -> reply text
Complete = Callable[[str, str, float], str]


def match_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their recorded response and its status; unanswered are pending.

    ``request_id`` is unique on both sides.
    """
    answered = requests.join(responses.select("request_id", "response"), "request_id", "left")
    return answered.withColumn("response_status", reply_status(F.col("response")))


SEVERAL = "[Error] more than one recorded answer"


def _temperature() -> Column:
    """As text: a floating-point join key is normalised again, by an exchange of its own."""
    return (F.col("temperature") + F.lit(0.0)).cast("string")


# One aggregate for so many requests of a group; more of them are gathered in two steps.
SLOTS = 64
Run = tuple[str, str, float]  # provider, model, temperature


def gather_recorded(
    responses: DataFrame, asked: list[str], *by: str, fits: Column | None = None, runs: Sequence[Run] | None = None
) -> DataFrame:
    """(by..., _said): the recorded answers of a document or a run as one list.

    Of the answers to one request only the newest by ``recorded_at`` is gathered, reduced before it
    moves; without that column, or among equally new ones that differ, it is an error text. What
    was not asked, or is not of a run that ``fits``, is left out first, so the list has at most one
    answer for each run and request, however often it was recorded.

    Where the requests of a group are known, all of ``runs`` or those of the one run that ``by`` names,
    each has its place in one aggregate over the group, and every answer moves once. Up to ``SLOTS`` of
    them, that is; others are reduced by run and request first and gathered after.
    """
    dated = "recorded_at" in responses.columns
    when = {"_at": F.unix_micros(F.col("recorded_at").cast("timestamp"))} if dated else {}
    rows = responses.withColumns(
        {"_temperature": _temperature(), "request": F.concat_ws("_", "stage", "flow"), **when}
    ).where(F.col("response").isNotNull() & F.col("srs_id").isNotNull() & F.col("request").isin(asked))
    if fits is not None:
        rows = rows.where(fits)
    whole_key = {"llm_provider", "llm_model", "_temperature"} <= {*by}
    if runs is not None and not whole_key and len({*runs}) * len(asked) <= SLOTS:
        names = ["llm_provider", "llm_model", "_temperature", "request"]
        places = [(*run, request) for run in dict.fromkeys(runs) for request in asked]
        known = [
            (F.lit(provider), F.lit(model), (F.lit(float(degrees)) + F.lit(0.0)).cast("string"), F.lit(request))
            for provider, model, degrees, request in places
        ]
    elif whole_key:
        names, known = ["request"], [(F.lit(request),) for request in asked]
    else:
        return _gathered_in_steps(rows, dated, *by)
    if not known:
        return rows.limit(0).groupBy(*by).agg(F.array().cast(_SAID).alias("_said"))

    def one(values) -> Column:
        return F.struct(*[value.alias(name) for name, value in zip(names, values)])

    place = F.array_position(F.array(*map(one, known)), one(map(F.col, names)))
    aggregates = []
    for k in range(len(known)):
        aggregates += _newest(F.col("_place") == k + 1, dated, f"_{k}")
    reduced = rows.withColumn("_place", place).where(F.col("_place") > 0).groupBy(*by).agg(*aggregates)
    said = []
    for k, values in enumerate(known):
        part = dict(zip(names, values))
        told = _said(dated, f"_{k}", lambda name: part.get(name, F.col(name)))
        said.append(F.when(F.col(f"_newest_{k}").isNotNull(), told))
    return reduced.select(*by, F.filter(F.array(*said), lambda one: one.isNotNull()).alias("_said"))


_SAID = "array<struct<llm_provider:string,llm_model:string,temperature:string,request:string,response:string>>"


def _newest(here: Column, dated: bool, tail: str = "") -> list[Column]:
    """The newest answer of the rows ``here``, and what tells whether others as new differ from it.

    That is a hash of 64 bits, which travels with every answer and does not compress. Answers that are
    not ``dated`` are equally new: they are equal if the least hash is the greatest, which compress to
    one, and neither a time nor a struct travels.
    """
    digest, response = F.xxhash64("response").alias("digest"), F.col("response").alias("response")
    if dated:
        # A missing time is older than any other.
        up, down = F.coalesce("_at", F.lit(-(1 << 63))), F.coalesce(-F.col("_at"), F.lit((1 << 63) - 1))
        newest = F.max(F.when(here, F.struct(up.alias("at"), digest, response)))
        least = F.min(F.when(here, F.struct(down.alias("at"), digest)))
        return [newest.alias(f"_newest{tail}"), least.alias(f"_least{tail}")]
    return [
        F.max(F.when(here, response)).alias(f"_newest{tail}"),
        F.min(F.when(here, digest)).alias(f"_least{tail}"),
        F.max(F.when(here, digest)).alias(f"_most{tail}"),
    ]


def _said(dated: bool, tail: str, part: Callable[[str], Column]) -> Column:
    newest, least = f"_newest{tail}", f"_least{tail}"
    if dated:
        several, response = F.col(f"{newest}.digest") != F.col(f"{least}.digest"), F.col(f"{newest}.response")
    else:
        several, response = F.col(f"_most{tail}") != F.col(least), F.col(newest)
    return F.struct(
        part("llm_provider").alias("llm_provider"),
        part("llm_model").alias("llm_model"),
        part("_temperature").alias("temperature"),
        part("request").alias("request"),
        F.when(several, SEVERAL).otherwise(response).alias("response"),
    )


def _gathered_in_steps(rows: DataFrame, dated: bool, *by: str) -> DataFrame:
    key = dict.fromkeys([*by, "llm_provider", "llm_model", "_temperature", "request"])
    reduced = rows.groupBy(*key).agg(*_newest(F.lit(True), dated))
    return reduced.groupBy(*by).agg(F.collect_list(_said(dated, "", F.col)).alias("_said"))


def read_recorded(runs: DataFrame, asked: list[str]) -> DataFrame:
    """Runs with ``_said`` to runs with a ``reply_{stage}_{flow}`` column for each request."""

    def reply(name: str) -> Column:
        fits = F.filter(
            "_said",
            lambda r: (r["request"] == name)
            & (r["llm_provider"] == F.col("llm_provider"))
            & (r["llm_model"] == F.col("llm_model"))
            & (r["temperature"] == _temperature()),
        )
        return F.get(fits, F.lit(0))["response"]

    replies = [reply(name).alias(f"reply_{name}") for name in asked]
    return runs.select(*[name for name in runs.columns if name != "_said"], *replies)


def attach_recorded(runs: DataFrame, responses: DataFrame, asked: list[str]) -> DataFrame:
    """Add ``reply_{stage}_{flow}`` from recorded (run key, stage, flow, response): one join.

    Answers grow with the runs. An estimate of them that is too low, as after an explode, must not
    have them all collected for a broadcast.
    """
    key = [*[name for name in RUN_KEY if name != "temperature"], "_temperature"]
    said = gather_recorded(responses, asked, *key).hint("merge")
    joined = runs.withColumn("_temperature", _temperature()).join(said, key, "left")
    return read_recorded(joined.drop("_temperature"), asked)


# Text of the rows that one task asks about, on average.
TASK_BYTES = 32 << 20


def tasks_for(rows: DataFrame, *texts: str, least: int) -> int:
    """How many tasks to ask about ``rows`` in: ``least``, or more where each would read over ``TASK_BYTES``.

    Reads the lengths of ``texts`` once. A row counts as 64 bytes besides its texts.
    """
    size = sum((F.coalesce(F.octet_length(name), F.lit(0)).cast("long") for name in texts), F.lit(64))
    return max(least, -(-(rows.agg(F.sum(size)).first()[0] or 0) // TASK_BYTES))


def complete(
    df: DataFrame,
    prompts: Mapping[str, Column],
    make_client: Callable[[], Complete],
    calls: int | None = None,
) -> DataFrame:
    """Add ``reply_{name}`` for each prompt by calling the user's function.

    ``df`` has ``llm_provider``, ``api_id`` and ``temperature``. ``make_client`` runs
    once per task. A NULL prompt gives a NULL reply; a ``lookup_error`` or an exception
    becomes the reply text, so that one bad request does not end the job. ``calls``
    spreads the rows over that many tasks, which is how many calls run at a time, as far
    as there are cores; ``tasks_for`` gives a number that follows the input, and runs that
    ``fan_out`` has spread need none. Make the result durable before reading it twice.
    """
    if calls is not None:
        df = df.repartition(calls, *RUN_KEY)
    names = list(prompts)
    asked = df.select("*", *[prompts[name].alias(f"_prompt_{name}") for name in names])
    schema = T.StructType(
        [*df.schema.fields, *[T.StructField(f"reply_{name}", T.StringType()) for name in names]]
    )
    kept = df.columns
    given = [
        name if name in kept else None
        for name in ("lookup_error", "llm_provider", "api_id", "temperature")
    ]

    # Nested, so that it travels by value: executors need not have this package.
    def ask(client, prompt, lookup_error, provider, api_id, temperature):
        if prompt is None:
            return None
        if lookup_error is not None:
            return lookup_error
        try:
            return client(prompt, api_id, temperature)
        except Exception as problem:
            return f"Error processing {provider} request: {problem}"

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for batch in batches:
            context = [
                batch.column(name).to_pylist() if name else [None] * batch.num_rows
                for name in given
            ]
            columns = [batch.column(name) for name in kept]
            for name in names:
                texts = batch.column(f"_prompt_{name}").to_pylist()
                replies = [ask(client, *row) for row in zip(texts, *context)]
                columns.append(pa.array(replies, pa.string()))
            yield pa.RecordBatch.from_arrays(
                columns, names=[*kept, *[f"reply_{name}" for name in names]]
            )

    return asked.mapInArrow(answer, schema)
