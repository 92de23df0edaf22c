"""Inference runs: tries, waits, isolation, concurrency, results."""

import threading
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from promptloom.operators import chunks, infer, reports, results, telemetry
from promptloom.plans.clients import EchoClient, FlakyClient
from promptloom.sources.batches import sample_batch

LAYOUT = infer.CallLayout(4, 4)


def requests(spark, prompts, model="m"):
    rows = [("j", n // 5, n, f"e{n}", prompt, model) for n, prompt in enumerate(prompts, 1)]
    frame = spark.createDataFrame(
        rows, "job_id string, chunk_no bigint, row_number bigint, external_id string, prompt string, model string"
    )
    return infer.request_columns(frame, "standard")


def test_three_rows_one_failing(spark):
    prompts = ["hello", "world", "trigger DNA failure"]
    attempts = infer.run_inference(requests(spark, prompts), lambda: EchoClient(refuse="DNA"), layout=LAYOUT)
    rows = {r.external_id: r for r in results.results_of(attempts).collect()}
    assert [rows[f"e{n}"].status for n in (1, 2, 3)] == ["SUCCEEDED", "SUCCEEDED", "FAILED"]
    assert rows["e1"].response == "echo: hello" and rows["e1"].error is None
    assert rows["e3"].response is None and rows["e3"].error == "refused" and rows["e3"].attempts == 1
    assert all(r.chunk_id and r.latency_ms >= 0 for r in rows.values())


def test_sample_batch_with_retries_and_refusals(spark):
    class FailsOnce:
        def complete(self, request):
            if "DNA" in request.prompt:
                raise infer.PermanentError("refused")
            if request.attempt == 1:
                raise infer.RetryableError("busy")
            return infer.Response("fine", 1, 1)

    batch = sample_batch(spark, 1000).withColumns({"job_id": F.lit("j"), "model": F.lit("")})
    plan = chunks.plan_chunks(batch.select("job_id", "row_number"))
    ready = batch.join(plan.select("job_id", "row_number", "chunk_no"), ["job_id", "row_number"])
    attempts = infer.run_inference(
        infer.request_columns(ready, "standard"), FailsOnce, rule=infer.RetryRule(base=0.001), layout=LAYOUT
    )
    done = results.collapse_attempts(attempts)
    assert {r.status: r["items"] for r in reports.items_by_status(done).collect()} == {"SUCCEEDED": 950, "FAILED": 50}
    assert {r.outcome: r.attempts for r in telemetry.attempts_by_outcome(attempts).collect()} == {
        "success": 950,
        "retryable_error": 950,
        "permanent_error": 50,
    }
    assert telemetry.retries_by_model(attempts).first().retries == 950


def test_attempt_rows_obey_their_rules(spark):
    words = ["0", "2", "4", "5", "9", "refuse", "crash"] * 3
    rule = infer.RetryRule(base=0.01, cap=0.03)
    attempts = infer.run_inference(requests(spark, [f"x {w}" for w in words]), FlakyClient, rule=rule, layout=LAYOUT)
    tries = defaultdict(list)
    for row in attempts.collect():
        tries[row.external_id].append(row)
    assert len(tries) == len(words)
    for rows in tries.values():
        rows.sort(key=lambda r: r.attempt)
        assert [r.attempt for r in rows] == list(range(1, len(rows) + 1))
        assert len(rows) <= 5
        assert all(r.outcome == "retryable_error" for r in rows[:-1])
        for retry, (before, after) in enumerate(zip(rows, rows[1:])):
            wait = (after.started_at - before.ended_at).total_seconds()
            assert 0 <= wait <= min(0.03, 0.01 * 2**retry) + 0.2
    ended = {e: rows[-1] for e, rows in tries.items()}
    assert ended["e5"].error == "busy 5" and ended["e5"].attempt == 5
    assert ended["e6"].outcome == "permanent_error"
    assert ended["e7"].error == "unexpected: boom" and ended["e7"].attempt == 1
    assert ended["e1"].response == "" and ended["e1"].prompt_tokens == 0
    gaps = telemetry.attempt_gaps(attempts, base=0.01, cap=0.03)
    assert gaps.count() == attempts.count() - len(words)
    waits = telemetry.wait_schedule(results.collapse_attempts(attempts))
    assert waits.count() == gaps.count()


def test_open_calls_stay_below_the_limit(spark):
    class Slow:
        def __init__(self):
            self.lock, self.now = threading.Lock(), 0

        def complete(self, request):
            with self.lock:
                self.now += 1
                seen = self.now
            time.sleep(0.005)
            with self.lock:
                self.now -= 1
            return infer.Response("ok", seen, 0)

    layout = infer.CallLayout(2, 3)
    attempts = infer.run_inference(requests(spark, ["p"] * 60), Slow, layout=layout)
    assert attempts.agg(F.max("prompt_tokens")).first()[0] <= 3
    peak = telemetry.peak_inflight(attempts, ["model"]).first().peak
    assert 1 <= peak <= 6


def test_rows_stand_by_while_calls_are_open(spark, monkeypatch):
    """Quick calls find their next row without waking the thread that feeds them."""
    frame = infer.request_columns(
        spark.createDataFrame([("j", 0, n, f"e{n}", "p", "m") for n in range(60)], "job_id string, chunk_no long, row_number long, external_id string, prompt string, model string"),
        "standard",
    )
    arrow, fed = frame.toArrow().combine_chunks(), threading.Event()

    class Waiting:
        def complete(self, request):
            return infer.Response("fed" if fed.wait(5) else "idle", 1, 1)

    def batches():
        for at in range(60):
            if at == 40:
                fed.set()
            yield from arrow.slice(at, 1).to_batches()

    frame_type = type(frame)
    monkeypatch.setattr(frame_type, "repartition", lambda self, *_: self)
    monkeypatch.setattr(frame_type, "mapInArrow", lambda self, run, schema: list(run(batches())))
    answers = [row["response"] for batch in infer.infer(frame, Waiting, layout=infer.CallLayout(1, 2)) for row in batch.to_pylist()]
    assert answers == ["fed"] * 60


def test_clients_are_closed(spark, tmp_path):
    folder = str(tmp_path)

    class Closing(EchoClient):
        def close(self):
            import tempfile

            tempfile.mkstemp(dir=folder)

    infer.run_inference(requests(spark, ["a", "b"]), Closing, layout=infer.CallLayout(2, 1))
    assert len(list(tmp_path.iterdir())) == 2


def test_call_layout():
    assert infer.call_layout(slots=8, max_concurrency=4) == infer.CallLayout(4, 1)
    layout = infer.call_layout(slots=8, max_concurrency=50)
    assert layout.calls_per_task == 6 and layout.partitions == 64
    with pytest.raises(ValueError):
        infer.call_layout(8, 0)


def test_retry_rule_bounds():
    rule = infer.RetryRule()
    for retry in range(6):
        for _ in range(50):
            assert 0 <= rule.wait(retry) <= min(30, 2**retry)
    assert infer.RetryRule(cap=5).wait(10) <= 5
    with pytest.raises(ValueError):
        infer.RetryRule(max_attempts=0)


def test_model_fallback(spark):
    frame = spark.createDataFrame([("a",), ("",), (None,)], "m string")
    got = [r[0] for r in frame.select(infer.model_or_default(F.col("m"), "standard")).collect()]
    assert got == ["a", "standard", "standard"]


def test_chunks_cover_and_do_not_overlap(spark):
    items = spark.range(1, 121).select(
        F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("job_id"), F.col("id").alias("row_number")
    )
    first = chunks.plan_chunks(items, 25).collect()
    again = chunks.plan_chunks(items, 25).collect()
    sizes = defaultdict(int)
    for row in first:
        sizes[row.job_id, row.chunk_no] += 1
    assert sizes == {("a", 0): 25, ("a", 1): 25, ("a", 2): 25, ("a", 3): 5, ("b", 0): 25, ("b", 1): 15}
    assert {(r.row_number, r.chunk_id) for r in first} == {(r.row_number, r.chunk_id) for r in again}
    assert len({r.chunk_id for r in first}) == 6


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path):
    calls, limit = tmp_path / "calls", tmp_path / "limit"
    calls.mkdir()
    limit.write_text("")

    class Counting:
        def __init__(self):
            if limit.exists() and len(list(calls.iterdir())) >= 40:
                raise RuntimeError("stopped")

        def complete(self, request):
            (calls / f"{request.prompt}-{time.time_ns()}").write_text("")
            return infer.Response("fine", 1, 1)

    asked, path = requests(spark, [f"e{n}" for n in range(1, 201)]), str(tmp_path / "run")
    options = {"rows_per_task": 10, "layout": infer.CallLayout(8, 2), "chunk_rows": 5}
    with pytest.raises(Exception, match="stopped"):
        infer.resumable_inference(asked, Counting, path, **options)
    stored = {r.external_id for r in spark.read.parquet(f"{path}/attempts/*.parquet").select("external_id").collect()}
    assert 40 <= len(stored) < 200
    limit.unlink()
    attempts = infer.resumable_inference(asked, Counting, path, **options)
    assert sorted(r.external_id for r in attempts.collect()) == sorted(f"e{n}" for n in range(1, 201))
    sent = [name.name.rsplit("-", 1)[0] for name in calls.iterdir()]
    assert all(sent.count(name) == 1 for name in stored)
    assert max(sent.count(name) for name in set(sent)) <= 2  # at most the open tasks' calls are repeated
    before = len(sent)
    assert infer.resumable_inference(asked, Counting, path, **options).count() == 200
    assert len(list(calls.iterdir())) == before


def test_a_resumable_run_without_requests(spark, tmp_path):
    none = requests(spark, ["p"]).limit(0)
    assert infer.resumable_inference(none, lambda: EchoClient(refuse="x"), str(tmp_path / "run")).count() == 0
