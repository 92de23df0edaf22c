"""Normalising, validating and loading, against the described rules."""

import json
from collections import Counter
from urllib.parse import unquote

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptloom.operators import load, reports
from promptloom.operators.normalize import MALFORMED, normalise_elements
from promptloom.operators.validate import accepted, rejected, standard_rules, validate
from promptloom.plans import ORACLES, QUERIES
from promptloom.sources import batches
from tests.compare import TABLES, oracle_rows, spark_rows

MIXED = [
    {"id": "ok-1", "prompt": "hello"},
    {"id": 7, "prompt": "int id"},
    {"id": None, "prompt": "null id"},
    {"id": "", "prompt": "empty id"},
    {"prompt": "no id"},
    {"id": "  ", "prompt": "blank id"},
    {"id": "np"},
    {"id": "n5", "prompt": 5},
    42,
    "str",
    None,
    ["a"],
    {"id": "ok-1", "prompt": "dup"},
    {"id": "ws", "prompt": " \t "},
    {"id": "ws", "prompt": "fine"},
    {"id": "np", "prompt": "now valid"},
]


def write(tmp_path, name, text):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def items_of(elements, job="j"):
    return normalise_elements(elements).withColumn("job_id", F.lit(job))


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    folder = write(tmp_path_factory.mktemp("mixed"), "b.json", json.dumps(MIXED, indent=1))
    return items_of(batches.read_json_arrays(spark, folder)).drop("path", "batch_error")


def test_mixed_kinds(mixed):
    rows = {r.row_number: r for r in mixed.collect()}
    assert [rows[n].external_id for n in range(1, 17)] == [
        "ok-1", "7", "row-3", "row-4", "row-5", "  ", "np", "n5",
        "row-9", "row-10", "row-11", "row-12", "ok-1", "ws", "ws", "np",
    ]
    assert {n for n, r in rows.items() if r.is_malformed} == {7, 8, 9, 10, 11, 12}
    assert [rows[n].kind for n in (1, 9, 10, 11, 12)] == ["OBJECT", "BIGINT", "STRING", "VOID", "ARRAY"]


def test_mixed_outcomes(mixed):
    judged = validate(mixed)
    errors = {r.row_number: r.error for r in judged.collect()}
    assert {n for n, e in errors.items() if e is None} == {1, 2, 3, 4, 5, 16}
    assert errors[6] == "validation: missing or empty external id"
    assert errors[7] == errors[9] == MALFORMED
    assert errors[13] == "validation: duplicate external id: ok-1"
    assert errors[14] == "validation: prompt shorter than min_chars=1"
    assert errors[15] == "validation: duplicate external id: ws"
    summary = reports.ingest_summary(judged).first()
    assert (summary.total, summary.accepted, summary.rejected) == (16, 6, 10)
    assert accepted(judged).count() == 6 and rejected(judged).count() == 10


@pytest.mark.parametrize("fused", [False, True])
def test_mixed_load(mixed, fused):
    loaded = load.judge_and_load(mixed) if fused else load.idempotent_load(validate(mixed))
    dropped = {r.row_number for r in loaded.where("disposition <> 'inserted'").collect()}
    assert dropped == {7, 13, 15}
    stored = load.item_rows(loaded)
    assert Counter(r.status for r in stored.collect()) == {"PENDING": 6, "FAILED": 7}
    assert stored.where("status = 'FAILED' AND prompt IS NOT NULL").count() == 0
    again = load.judge_and_load(mixed, existing=stored) if fused else load.idempotent_load(validate(mixed), stored)
    counts = Counter(r.disposition for r in again.collect())
    assert counts == {"dropped_existing": 13, "dropped_in_batch": 3}


def test_rule_messages_add_up(spark):
    rows = [(1, " ", ""), (2, " ", "x" * 1000), (3, "p-1", "hello world"), (4, "p-1", "   ")]
    items = spark.createDataFrame(rows, "row_number bigint, external_id string, prompt string").withColumns(
        {"job_id": F.lit("j"), "is_malformed": F.lit(False)}
    )
    judged = {r.row_number: r for r in validate(items, standard_rules(max_tokens=10)).collect()}
    assert judged[1].error == "validation: missing or empty external id; prompt shorter than min_chars=1"
    assert judged[2].errors == [
        "missing or empty external id",
        "prompt ~250 tokens exceeds max 10",
        "duplicate external id:  ",
    ]
    assert judged[3].ok and judged[3].error is None
    assert judged[4].errors == ["prompt shorter than min_chars=1", "duplicate external id: p-1"]
    loose = {r.row_number: r.ok for r in validate(items, [], reject_duplicates=False).collect()}
    assert all(loose.values())


@pytest.mark.parametrize(("valid_row", "winner"), [(20, "PENDING"), (600, "FAILED")])
def test_flush_boundary(spark, valid_row, winner):
    rows = [(10, "x", None, True), (valid_row, "x", "fine", False)]
    items = spark.createDataFrame(rows, "row_number bigint, external_id string, prompt string, is_malformed boolean")
    items = items.withColumn("job_id", F.lit("j"))
    for loaded in (load.judge_and_load(items), load.idempotent_load(validate(items))):
        assert [r.status for r in loaded.where("disposition = 'inserted'").collect()] == [winner]


def model_load(rows, flush):
    """Row-by-row model of ingest: outcome and fate of every row of one batch."""
    seen, out = set(), []
    for number, (key, prompt) in enumerate(rows, 1):
        if prompt is None:
            out.append((number, key, "FAILED"))
            continue
        bad = not key.strip() or not prompt.strip() or key in seen
        seen.add(key)
        out.append((number, key, "FAILED" if bad else "PENDING"))
    table = {}
    for start in range(0, len(out), flush):
        part = out[start : start + flush]
        for number, key, status in [r for r in part if r[2] == "PENDING"] + [r for r in part if r[2] == "FAILED"]:
            table.setdefault(key, number)
    return {(number, key, status, table[key] == number) for number, key, status in out}


ROW = st.tuples(st.sampled_from(["a", "b", "c", " "]), st.sampled_from([None, "", "text", " x "]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(ROW, min_size=1, max_size=14), min_size=20, max_size=20), st.integers(1, 5))
def test_load_follows_the_row_by_row_model(spark, many, flush):
    rows = [
        (f"job{j}", n, key, prompt, prompt is None)
        for j, batch in enumerate(many)
        for n, (key, prompt) in enumerate(batch, 1)
    ]
    items = spark.createDataFrame(
        rows, "job_id string, row_number bigint, external_id string, prompt string, is_malformed boolean"
    )
    expected = {(f"job{j}", *row) for j, batch in enumerate(many) for row in model_load(batch, flush)}
    for loaded in (
        load.judge_and_load(items, flush_rows=flush),
        load.idempotent_load(validate(items), flush_rows=flush),
    ):
        got = {
            (r.job_id, r.row_number, r.external_id, r.status, r.disposition == "inserted") for r in loaded.collect()
        }
        assert got == expected


def test_array_files(spark, tmp_path):
    write(tmp_path, "a.json", '[{"id":"a","prompt":"1"}, 2]')
    write(tmp_path, "b.json", "[]")
    write(tmp_path, "c.json", '[{"id":"c","prompt":"1"},')
    folder = write(tmp_path, "d.json", '{"id":"d","prompt":"1"}')
    rows = batches.read_json_arrays(spark, folder).collect()
    by_file = Counter((r.path.rsplit("/", 1)[-1], r.batch_error) for r in rows)
    assert by_file == {("a.json", None): 2, ("c.json", batches.BROKEN_BATCH): 1, ("d.json", batches.BROKEN_BATCH): 1}


ARRAYS = {
    "a.json": "\n" + json.dumps([*MIXED, 1.5, -12, True, {"é": ["😀", "}]\\\",["]}], indent=2, ensure_ascii=False) + " \n",
    "b.json": " [ ] ",
    "c.json": '[1, {"id": "x"}, tru]',
    "d.json": "[1, 2",
    "e.json": "[1 2]",
    "f.json": '{"id": 1}',
    "g ä%20#.json": "[12345]",
    "h.json": "",
    "i.json": '[{"id":"1"}]\n[{"id":"2"}]',
    "j.json": "[{'id':'a','prompt':'b'}]",
    "k.json": '[{"id":"a","prompt":"b"}, NaN]',
    "l.json": '[{"id":"}{][\\\\"},{"id":"a\\"}b"},{"n":[{},{"m":[[1],{}]}]}]',
    "m.json": "[1,]",
    "n.json": " \n ",
    "o.json": '[{"a":1}}]',
    "p.json": '[{"id":"open',
    "q.json": "  \n" * 50 + '[{"id":"late"},' + " " * 300 + '{"id":"later"}' + "\n" * 200 + "]" + " " * 100,
    "t.json": "[1]}",
    "u.json": '[{"a":1}',
    "v.json": '[{"a":1}, {"b":"\\\\\\""}]',
    "r.json": json.dumps([{"id": f"i{n}", "prompt": "x}{" * (n % 40)} for n in range(60)]),
}
REFUSED = {"c.json", "d.json", "e.json", "f.json", "h.json", "i.json", "j.json", "k.json", "m.json", "n.json", "o.json", "p.json", "s.json", "t.json", "u.json"}


def array_rows(spark, folder, bytes_per_split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(bytes_per_split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = batches.read_json_arrays(spark, folder).withColumn("text", F.to_json("element")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    return Counter((unquote(r.path).rsplit("/", 1)[-1], r.row_number, r.text, r.batch_error) for r in rows)


@pytest.mark.parametrize("bytes_per_split", [64, 1000, 1 << 27])
def test_arrays_of_any_size_have_one_contract(spark, tmp_path, monkeypatch, bytes_per_split):
    for name, text in ARRAYS.items():
        folder = write(tmp_path, name, text)
    (tmp_path / "in" / "s.json").write_bytes(b'[{"id":"\xff"}]')
    monkeypatch.setattr(batches, "PIECE_BYTES", bytes_per_split)
    found = array_rows(spark, folder, bytes_per_split)
    assert {name for name, _, _, error in found if error} == REFUSED
    assert all(n == 1 for n in found.values())
    expected = Counter()
    for name in set(ARRAYS) - REFUSED:
        expected.update((name, at) for at, _ in enumerate(json.loads(ARRAYS[name]), 1))
    assert Counter((name, at) for name, at, _, error in found if not error) == expected
    for name, at, text, error in found:
        if not error:
            assert json.loads(text) == json.loads(ARRAYS[name])[at - 1]


def test_arrays_do_not_depend_on_how_each_scan_is_split(spark, tmp_path, monkeypatch):
    values = [{"id": f"i{n}", "prompt": 'x}{"\\' * (n % 9)} for n in range(4000)]
    folder = write(tmp_path, "a.json", json.dumps(values))
    counts, inner = iter([8, 1, 3, 6, 2, 7, 1, 5, 4] * 9), batches.materialise

    def other_splits(df, label):
        spark.conf.set("spark.sql.files.minPartitionNum", str(next(counts)))
        return inner(df, label)

    monkeypatch.setattr(batches, "materialise", other_splits)
    monkeypatch.setattr(batches, "PIECE_BYTES", 5000)
    try:
        rows = batches.read_json_arrays(spark, folder).withColumn("text", F.to_json("element")).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert [json.loads(r.text) for r in sorted(rows, key=lambda r: r.row_number)] == values


def test_a_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        batches.read_json_arrays(spark, str(tmp_path / "gone")).collect()


def test_json_lines_are_numbered_in_file_order(spark, tmp_path):
    lines = [json.dumps({"id": f"i{n}", "prompt": "x" * (n % 50)}) for n in range(3000)]
    folder = write(tmp_path, "a.jsonl", "\n".join(lines) + "\nnot json\n")
    write(tmp_path, "b.jsonl", '{"id":"only","prompt":"p"}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        items = normalise_elements(batches.read_json_lines(spark, folder)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    first = {r.row_number: r for r in items if r.path.endswith("a.jsonl")}
    assert len(first) == 3001
    assert all(first[n + 1].external_id == f"i{n}" for n in range(3000))
    assert first[3001].is_malformed and first[3001].external_id == "row-3001"
    assert [(r.row_number, r.external_id) for r in items if r.path.endswith("b.jsonl")] == [(1, "only")]


def test_sample_batch(spark):
    rows = {r.row_number: r for r in batches.sample_batch(spark, 1000).collect()}
    assert len(rows) == 1000
    assert rows[1].external_id == "prompt-0001" and rows[1000].external_id == "prompt-1000"
    assert rows[9].prompt == "Summarize the key idea behind DNA replication."
    assert sum("DNA" in r.prompt for r in rows.values()) == 50
    assert len({r.prompt for r in rows.values()}) == 40


def test_files_of_one_chunk_need_no_running_sums(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "running_sums", None)
    texts = {"a": '[1, {"x": "}]"}, "é"]', "b": " [ ] ", "c": "[1,]", "d": '[{"x": 1}', "e": "", "f": '{"x": [1]}', "g": '[{"x": 1} ]\n'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = batches.read_json_arrays(spark, str(tmp_path)).select("path", "row_number", F.to_json("element").alias("json"), "batch_error").collect()
    found = {name: sorted((r.row_number or 0, r.json, r.batch_error) for r in rows if r.path.endswith(f"{name}.json")) for name in texts}
    assert found["a"] == [(1, "1", None), (2, '{"x":"}]"}', None), (3, '"é"', None)]
    assert found["b"] == [] and found["g"] == [(1, '{"x":1}', None)]
    assert all(found[name] == [(0, None, batches.BROKEN_BATCH)] for name in "cdef")


def test_preflight_collects_all_messages(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text("\n  [1]")
    late = tmp_path / "late.json"
    late.write_text(" " * 64 + "[1]")
    wrong = tmp_path / "wrong.json"
    wrong.write_text('{"a": []}')
    rows = [(str(good), "m"), (str(late), "m"), (str(wrong), ""), (str(tmp_path), "m"), (str(tmp_path / "no"), None)]
    manifest = spark.createDataFrame(rows, "input_path string, model string")
    got = {r.input_path: r.errors for r in batches.check_sources(manifest).collect()}
    assert got[str(good)] == []
    assert got[str(late)] == ["input file must be a JSON array"]
    assert got[str(wrong)] == ["input file must be a JSON array", "no model configured"]
    assert got[str(tmp_path)] == [f"input file not found: {tmp_path}"]
    assert got[str(tmp_path / "no")] == [f"input file not found: {tmp_path / 'no'}", "no model configured"]
    assert batches.check_sources(manifest, "standard").where("ok").count() == 1


def test_preflight_names_paths_it_cannot_read_and_goes_on(spark, tmp_path):
    good = tmp_path / "go od.json"
    good.write_text("[1]")
    odd = ["dbfs:/mnt/x.json", "nostore://a/b c.json", "s3a://bu cket/x y.json", "a:b", ""]
    rows = [(path, "m") for path in [str(good), f"file:{good}", f"file://{good}", *odd]]
    manifest = spark.createDataFrame(rows, "input_path string, model string").coalesce(1)
    got = {r.input_path: r.errors for r in batches.check_sources(manifest).collect()}
    assert len(got) == len(rows) and got[str(good)] == got[f"file:{good}"] == got[f"file://{good}"] == []
    assert all(len(got[path]) == 1 for path in odd)
    assert got["dbfs:/mnt/x.json"][0].startswith("cannot read input file: ")


def test_preflight_counts_a_table_of_several_files_once(spark, tmp_path):
    for name in TABLES:
        if name in ("documents", "labels"):
            rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
            rows.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        else:
            (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    names, rows = spark_rows(QUERIES["source_preflight"](spark, str(tmp_path)))
    assert (names, rows) == oracle_rows("/root/testdata/sf0.001", ORACLES["source_preflight"])


def test_item_ids_continue(spark):
    items = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1)], "job_id string, row_number bigint")
    got = {(r.job_id, r.row_number): r.id for r in load.with_item_ids(items, after=10).collect()}
    assert got == {("a", 1): 11, ("a", 2): 12, ("b", 1): 13}


def test_rule_of_ones_own(spark):
    import pandas as pd

    @F.pandas_udf("string")
    def shouting(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: "prompt is all capitals" if text.isupper() else None)

    items = spark.createDataFrame(
        [("j", 1, "a", "HELLO", False), ("j", 2, "b", "Hello", False)],
        "job_id string, row_number bigint, external_id string, prompt string, is_malformed boolean",
    )
    rules = [*standard_rules(), lambda: shouting(F.col("prompt"))]
    got = {r.external_id: r.error for r in load.judge_and_load(items, rules).collect()}
    assert got == {"a": "validation: prompt is all capitals", "b": None}
