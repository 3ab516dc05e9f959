"""Pools of calls, and the store of answers."""

from __future__ import annotations

import contextlib
import time

import pytest
from pyspark.sql import functions as F

from runloom.operators import calls, completion
from tests.check import TABLES
from workloads import queries

ASKED = "id long, llm_provider string, api_id string, temperature double, text string"


def asked(spark, texts):
    return spark.createDataFrame([(k, "p", "api", 0.5, text) for k, text in enumerate(texts)], ASKED).coalesce(1)


def traced_client(folder: str):
    """Writes when each call begins and ends; the prompt says what happens: seconds, failures, or hanging."""

    def make_client():
        import threading
        import time

        lock, tried = threading.Lock(), {}

        def answer(prompt, api_id, temperature):
            with lock:
                tried[prompt] = tried.get(prompt, 0) + 1
                number = tried[prompt]
            name = f"{folder}/{prompt.split()[0]}-{number}"
            begin = time.time()
            _, seconds, failures = prompt.split()
            time.sleep(float(seconds))
            with open(name, "w") as file:
                file.write(f"{begin} {time.time()}")
            if number <= int(failures):
                raise ValueError(f"busy {number}")
            return f"said {prompt.split()[0]} at {temperature} by {api_id}"

        return answer

    return make_client


def spans(folder):
    return [tuple(map(float, p.read_text().split())) for p in folder.iterdir()]


def test_calls_in_flight_are_bounded_and_rows_keep_their_order(spark, tmp_path):
    df = asked(spark, [f"r{k} 0.2 0" if k % 5 else None for k in range(30)])
    begin = time.time()
    rows = calls.complete_retried(df, F.col("text"), traced_client(str(tmp_path)), in_flight=6).collect()
    assert [r.id for r in rows] == list(range(30))
    assert all((r.reply, r.attempts) == ((f"said r{r.id} at 0.5 by api", 1) if r.id % 5 else (None, 0)) for r in rows)
    made = spans(tmp_path)
    most = max(sum(b <= at < e for b, e in made) for at, _ in made)
    assert len(made) == 24 and 2 <= most <= 6
    assert time.time() - begin < 60


def test_retries_back_off_and_end(spark, tmp_path):
    df = asked(spark, ["once 0 1", "twice 0 2", "always 0 9"])
    rows = calls.complete_retried(df, F.col("text"), traced_client(str(tmp_path)), attempts=3, backoff=0.2).collect()
    assert [r.attempts for r in rows] == [2, 3, 3]
    assert [r.reply for r in rows][2] == "Error processing p request: busy 3"
    times = {p.name: float(p.read_text().split()[0]) for p in tmp_path.iterdir()}
    assert times["twice-2"] - times["twice-1"] >= 0.2 and times["twice-3"] - times["twice-2"] >= 0.4


def test_a_call_over_the_limit_is_given_up(spark, tmp_path):
    df = asked(spark, ["slow 4 0", "fast 0 0"])
    rows = calls.complete_retried(df, F.col("text"), traced_client(str(tmp_path)), in_flight=2, limit=0.5).collect()
    assert rows[0].reply == "Error processing p request: no answer in 0.5 s" and rows[0].attempts == 1
    assert rows[1].reply.startswith("said fast")


def test_calls_a_second_are_bounded(spark, tmp_path):
    df = asked(spark, [f"r{k} 0 0" for k in range(9)])
    calls.complete_retried(df, F.col("text"), traced_client(str(tmp_path)), in_flight=9, per_second=8).collect()
    begins = sorted(b for b, _ in spans(tmp_path))
    assert begins[-1] - begins[0] >= 0.9


@pytest.fixture
def once(spark, tmp_path):
    def run(rows, **options):
        def ask(wanted, prompt):
            return calls.complete_retried(wanted, prompt, traced_client(str(tmp_path / "calls")), backoff=0.0, **options)

        out = calls.complete_once(rows, F.col("text"), "id", str(tmp_path / "store"), ask)
        return {r.id: (r.reply, r.called) for r in out.collect()}

    (tmp_path / "calls").mkdir()
    return run


def test_each_request_is_asked_once(spark, tmp_path, once):
    rows = asked(spark, ["a 0 0", "b 0 0", "a 0 0", None, "a 0 0", None])
    first = once(rows.repartition(3))
    assert first == {
        0: ("said a at 0.5 by api", True), 1: ("said b at 0.5 by api", True), 2: ("said a at 0.5 by api", False),
        3: (None, False), 4: ("said a at 0.5 by api", False), 5: (None, False),
    }
    made = len(spans(tmp_path / "calls"))
    second = once(rows.repartition(2))
    assert made == len(spans(tmp_path / "calls")) == 2
    assert {k: r for k, (r, _) in second.items()} == {k: r for k, (r, _) in first.items()}
    assert not any(called for _, called in second.values())
    # Another model or temperature is another request.
    other = once(rows.withColumn("temperature", F.lit(0.7)))
    assert other[0] == ("said a at 0.7 by api", True) and other[2] == ("said a at 0.7 by api", False)
    assert once(rows.limit(0)) == {}


def test_failures_are_not_stored(spark, once, tmp_path):
    rows = asked(spark, ["x 0 5", "x 0 5"])
    assert once(rows, attempts=2) == {0: ("Error processing p request: busy 2", True), 1: ("Error processing p request: busy 2", False)}
    assert calls.answers(spark, str(tmp_path / "store")).count() == 0
    assert once(rows, attempts=2)[0][1]


def test_a_client_does_not_keep_its_prompts():
    answer = queries.busy_client()()
    for k in range(16):
        with contextlib.suppress(ValueError):
            answer(f"{k}" * 4096, "api", 0.5)
    (tried,) = [cell.cell_contents for cell in answer.__closure__ if isinstance(cell.cell_contents, dict)]
    assert len(tried) == 16 and max(map(len, tried)) <= 64


def test_calls_are_made_in_more_tasks_with_more_text(spark, monkeypatch):
    monkeypatch.setattr(completion, "TASK_BYTES", 1 << 14, raising=False)
    found = queries.completion_retried(spark, str(TABLES / "sf0.001"))
    assert found.select(F.spark_partition_id()).distinct().count() > spark.sparkContext.defaultParallelism
