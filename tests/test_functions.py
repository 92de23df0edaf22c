import pytest
from pyspark.sql import functions as F

from promptloom.operators import reports
from promptloom.functions import money, outcomes, text


def values(spark, rows, schema, column):
    return [row[0] for row in spark.createDataFrame(rows, schema).select(column).collect()]


def test_strip_removes_what_python_strip_removes(spark):
    samples = ["  a b ", "\x1c\x85x　", "​kept", "", "\t\n"]
    assert values(spark, [(s,) for s in samples], "s string", text.strip(F.col("s"))) == [s.strip() for s in samples]


def test_sizes_count_code_points(spark):
    samples = ["", "abc", "abcd", "é" * 9, "😀" * 8]
    rows = [(s,) for s in samples]
    assert values(spark, rows, "s string", text.prompt_size(F.col("s"))) == [len(s) // 4 for s in samples]
    expected = [0 if not s else max(1, len(s) // 4) for s in samples]
    assert values(spark, rows, "s string", text.estimated_tokens(F.col("s"))) == expected


def test_last_segment_and_preview(spark):
    refs = [("jobs/a/chunks/b.jsonl",), ("plain",)]
    assert values(spark, refs, "s string", text.last_segment(F.col("s"))) == ["b.jsonl", "plain"]
    texts = [("a\nb",), ("x" * 100,), ("y" * 101,), (None,)]
    assert values(spark, texts, "s string", text.preview(F.col("s"))) == ["a b", "x" * 100, "y" * 100 + "...", ""]


def test_route_template(spark):
    paths = [
        "/jobs/12/status",
        "/jobs/1/2/",
        "https://h.example/jobs/3f2504e0-4f89-11d3-9a0c-0305e82c3301?x=1#y",
        "/jobs/0123456789abcdef0123456789abcdef",
        "/v1/a12",
        "/metrics",
    ]
    assert values(spark, [(p,) for p in paths], "s string", text.route_template(F.col("s"))) == [
        "/jobs/{id}/status",
        "/jobs/{id}/{id}/",
        "/jobs/{id}",
        "/jobs/{id}",
        "/v1/a12",
        "/metrics",
    ]


def test_retryable_codes(spark):
    codes = [200, 400, 401, 403, 404, 429, 500, 502, 503, 504]
    got = values(spark, [(c,) for c in codes], "c int", outcomes.retryable_status(F.col("c")))
    assert got == [False] * 5 + [True] * 5


def test_outcome_classes(spark):
    rows = [
        (None, None, "success"),
        ("rate_limit", 429, "retryable_error"),
        ("timeout", None, "retryable_error"),
        ("connection", None, "retryable_error"),
        ("status", 501, "retryable_error"),
        ("status", 429, "retryable_error"),
        ("status", 404, "permanent_error"),
        ("status", None, "permanent_error"),
        ("parse", None, "unexpected"),
    ]
    frame = spark.createDataFrame(rows, "kind string, code int, expected string")
    wrong = frame.where(outcomes.outcome_class(F.col("kind"), F.col("code")) != F.col("expected"))
    assert wrong.collect() == []


def test_wait_ceilings(spark):
    rows = [(k,) for k in range(7)]
    assert values(spark, rows, "k int", outcomes.wait_ceiling(F.col("k"))) == [1, 2, 4, 8, 16, 30, 30]
    assert values(spark, [(10,)], "k int", outcomes.wait_ceiling(F.col("k"), cap=5)) == [5]


def test_elapsed_is_cut_not_rounded(spark):
    moment = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    later = F.to_timestamp(F.lit("2024-01-01 00:00:01.234999"))
    assert spark.range(1).select(outcomes.elapsed_ms(moment, later)).first()[0] == 1234


def test_json_keeps_nulls(spark):
    frame = spark.createDataFrame([("a", None)], "x string, y string")
    assert frame.select(outcomes.as_json("x", "y")).first()[0] == '{"x":"a","y":null}'


def test_cost_and_prices(spark):
    cost = money.cost_usd(F.lit(2_000_000), F.lit(500_000), F.lit(0.5), F.lit(2.0))
    assert spark.range(1).select(cost).first()[0] == pytest.approx(2.0)
    prices = spark.createDataFrame([(f"m{i}", float(i), 2.0 * i) for i in range(5000)], "model string, input_price double, output_price double")
    rows = spark.createDataFrame([("j", m, "x" * 400) for m in ("m7", "m4999", "other", None)], "job_id string, model string, prompt string")
    report = reports.token_cost(rows, prices, 9.0, F.lit(1000)).collect()
    assert {r.model: round(r.cost_usd * 1e6) for r in report} == {"m7": 14700, "m4999": 10497900, "other": 9900, None: 9900}


@pytest.mark.parametrize("count", [0, 1, 2, 3, 40])
def test_short_texts_are_found(spark, count):
    samples = ["", "   ", "a", " a ", " ab ", "a　b", "a  b", "😀 😀", " " * 200 + "abc" + " " * 200, "x" + " " * 300 + "y"]
    samples += ["a" * 39, "a" * 40, " " * 100 + "b" * 39 + "\n", "word " * 50]
    got = values(spark, [(s,) for s in samples], "s string", text.stripped_shorter_than(F.col("s"), count))
    assert got == [len(s.strip()) < count for s in samples]
