"""Reading, normalising, validating and loading batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions.text import preview
from promptloom.operators import limits, load, normalize, reports
from promptloom.operators.validate import mark_repeats, standard_rules, validate, with_outcome, row_messages
from promptloom.plans.registry import query
from promptloom.plans.tables import (
    CONVERSATION_ITEMS_SQL,
    DOCUMENT_ITEMS_SQL,
    conversation_items,
    document_items,
    judged_sql,
    table,
    winners_sql,
)
from promptloom.session import materialise, new_folder, qualified_path
from promptloom.sources import batches, items

# Small enough for many documents to fail the length rule.
TOKENS = 1000
FLUSH = 20
BATCH_ROWS = 5000


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(f"""
SELECT doc_id + 1 AS row_number, 'prompt-' || CASE WHEN doc_id + 1 < 10000
         THEN lpad(CAST(doc_id + 1 AS VARCHAR), 4, '0') ELSE CAST(doc_id + 1 AS VARCHAR) END AS external_id,
       replace({_sql_list(batches.TEMPLATES)}[(doc_id + 1) % {len(batches.TEMPLATES)} + 1], '{{topic}}',
               {_sql_list(batches.TOPICS)}[(doc_id + 1) % {len(batches.TOPICS)} + 1]) AS prompt
FROM documents
""")
def synthetic_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated prompt for every document."""
    numbers = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("n"))
    return batches.sample_items(numbers, "n")


def _event_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as batch elements of all kinds: (event_id, value)."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    odd = (
        F.when(k % 4 == 0, F.col("event_id").cast("string"))
        .when(k % 4 == 1, F.lit('["a"]'))
        .when(k % 4 == 2, F.lit('"text"'))
        .otherwise(F.lit("null"))
    )

    def element(id_json: Column, prompt: Column) -> Column:
        return F.concat(F.lit('{"id": '), id_json, F.lit(', "prompt": '), prompt, F.lit("}"))

    quoted = F.to_json(F.array("props"))
    props = F.substring(quoted, F.lit(2), F.char_length(quoted) - 2)
    value = (
        F.when(kind == "view", element(F.col("event_id").cast("string"), props))
        .when(kind == "click", element(F.concat(F.lit('"u'), F.col("user_id"), F.lit('"')), F.lit('"café"')))
        .when(kind == "purchase", element(F.lit("null"), F.lit('"buy"')))
        .when(kind == "error", element(F.concat(F.lit('"e'), F.col("event_id"), F.lit('"')), k.cast("string")))
        .otherwise(odd)
    )
    return table(spark, sf_dir, "events").select("event_id", value.alias("value"))


_ELEMENTS_SQL = """
elements AS (
  SELECT event_id, CASE event_type
    WHEN 'view' THEN '{"id": ' || event_id || ', "prompt": ' || CAST(to_json(props) AS VARCHAR) || '}'
    WHEN 'click' THEN '{"id": "u' || user_id || '", "prompt": "café"}'
    WHEN 'purchase' THEN '{"id": null, "prompt": "buy"}'
    WHEN 'error' THEN '{"id": "e' || event_id || '", "prompt": ' || json_extract_string(props, '$.k') || '}'
    ELSE CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 4
      WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '["a"]' WHEN 2 THEN '"text"' ELSE 'null' END
    END AS value
  FROM events)
"""


def _normalised_sql(row_number: str) -> str:
    return f"""
numbered AS (SELECT *, {row_number} AS row_number FROM elements),
items AS (
  SELECT row_number,
    CASE json_type(value) WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'NULL' THEN 'VOID'
         ELSE json_type(value) END AS kind,
    CASE WHEN json_type(value) = 'OBJECT' AND coalesce(json_extract_string(value, '$.id'), '') <> ''
         THEN json_extract_string(value, '$.id') ELSE 'row-' || row_number END AS external_id,
    CASE WHEN json_type(value, '$.prompt') = 'VARCHAR' THEN json_extract_string(value, '$.prompt') END AS prompt
  FROM numbered)
"""


@query(f"""
WITH {_ELEMENTS_SQL}, {_normalised_sql("event_id + 1")}
SELECT row_number, kind, external_id, prompt, prompt IS NULL AS is_malformed,
       CASE WHEN prompt IS NULL THEN 'validation: malformed item (missing/invalid prompt)' END AS error
FROM items
""")
def item_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dynamic elements to items, malformed ones with their failure text."""
    rows = _event_elements(spark, sf_dir).select((F.col("event_id") + 1).alias("row_number"), "value")
    items = normalize.normalise_elements(batches.parse_elements(rows, "value"))
    return items.withColumn("error", normalize.failure_text(F.col("is_malformed"), F.array().cast("array<string>")))


def _write_event_arrays(spark: SparkSession, sf_dir: str) -> str:
    """Write events as JSON-array files of at most ``BATCH_ROWS`` elements; returns the folder."""
    folder = new_folder(spark, "arrays")
    ordered = F.sort_array(F.collect_list(F.struct("event_id", "value")))
    (
        _event_elements(spark, sf_dir)
        .groupBy(F.floor(F.col("event_id") / BATCH_ROWS).alias("batch"))
        .agg(ordered.alias("rows"))
        .select(F.concat(F.lit("["), F.array_join("rows.value", ", "), F.lit("]")).alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .text(folder)
    )
    return folder


@query(f"""
WITH {_ELEMENTS_SQL},
{_normalised_sql(f"row_number() OVER (PARTITION BY event_id // {BATCH_ROWS} ORDER BY event_id)")}
SELECT row_number, external_id, prompt, prompt IS NULL AS is_malformed, CAST(NULL AS VARCHAR) AS batch_error
FROM items
""")
def batch_array_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-array files read element by element."""
    elements = batches.read_json_arrays(spark, _write_event_arrays(spark, sf_dir))
    return normalize.normalise_elements(elements).select(
        "row_number", "external_id", "prompt", "is_malformed", "batch_error"
    )


def _array_kinds(rows: Column) -> Column:
    """Texts of array files, whole and broken ones, around the elements ``rows`` (JSON texts)."""
    whole = F.concat(F.lit("["), F.array_join(rows, ", "), F.lit("]"))
    kinds = {
        "whole": whole,
        "spaced": F.concat(F.lit(" \n"), F.lit("[ "), F.array_join(rows, " ,\n\t"), F.lit("\n]\n\n")),
        "empty": F.concat(F.lit(" ["), F.repeat(F.lit(" "), F.size(rows) % 7), F.lit("] ")),
        "blank": F.repeat(F.lit("\n"), F.size(rows)),
        "cut": F.concat(F.lit("["), F.array_join(rows, ",")),
        "cut_element": F.concat(F.lit("["), F.array_join(rows, ","), F.lit(', {"id": "open, "prompt": 1}]')),
        "concatenated": F.concat(whole, F.lit("\n"), whole),
        "brace_behind": F.concat(whole, F.lit("}")),
        "object": F.concat(F.lit('{"rows": '), whole, F.lit("}")),
        "single_quoted": F.concat(F.lit("["), F.array_join(rows, ","), F.lit(", {'id': 'a', 'prompt': 'b'}]")),
        "non_finite": F.concat(F.lit("["), F.array_join(rows, ","), F.lit(", NaN]")),
        "comma_behind": F.concat(F.lit("["), F.array_join(rows, ","), F.lit(",]")),
        "bad_bytes": F.concat(F.lit('[{"id": "'), F.lit(b"\xff").cast("string"), F.lit('"}, '), F.array_join(rows, ","), F.lit("]")),
    }
    return F.array(*[F.struct(F.lit(kind).alias("kind"), text.alias("value")) for kind, text in kinds.items()])


@query(f"""
WITH batches AS (SELECT event_id // {BATCH_ROWS} AS batch, count(*) AS n FROM events GROUP BY 1)
SELECT kind, sum(CASE WHEN kind IN ('whole', 'spaced') THEN n ELSE 0 END)::BIGINT AS elements,
       sum(CASE WHEN kind IN ('whole', 'spaced') THEN n * (n + 1) // 2 ELSE 0 END)::BIGINT AS row_numbers,
       sum(CASE WHEN kind IN ('whole', 'spaced', 'empty') THEN 0 ELSE 1 END)::BIGINT AS refused
FROM batches, (SELECT unnest(['whole', 'spaced', 'blank', 'cut', 'cut_element', 'concatenated', 'brace_behind', 'object',
                              'single_quoted', 'non_finite', 'comma_behind', 'bad_bytes']) AS kind)
GROUP BY kind
""")
def batch_array_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array files of every kind, made of all events: what is read of them and what is refused."""
    folder = new_folder(spark, "array-kinds")
    ordered = F.sort_array(F.collect_list(F.struct("event_id", "value")))
    (
        _event_elements(spark, sf_dir)
        .groupBy(F.floor(F.col("event_id") / BATCH_ROWS).alias("batch"))
        .agg(ordered.alias("rows"))
        .select(F.explode(_array_kinds(F.col("rows.value"))).alias("file"))
        .select("file.kind", "file.value")
        .write.option("maxRecordsPerFile", 1)
        .partitionBy("kind")
        .text(folder)
    )
    read = batches.read_json_arrays(spark, f"{folder}/*")
    kind = F.regexp_extract("path", r"kind=(\w+)", 1).alias("kind")
    return read.groupBy(kind).agg(
        F.count("row_number").alias("elements"),
        F.coalesce(F.sum("row_number"), F.lit(0)).alias("row_numbers"),
        F.count("batch_error").alias("refused"),
    )


@query(f"""
WITH batches AS (SELECT DISTINCT event_id // {BATCH_ROWS} AS batch FROM events)
SELECT 'array' AS input, true AS ok, '' AS errors, count(*) AS batches FROM batches HAVING count(*) > 0
UNION ALL
SELECT 'missing', false, 'input file not found; no model configured', count(*) FROM batches HAVING count(*) > 0
UNION ALL
SELECT 'table', false, 'input file must be a JSON array', 14
""")
def source_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch files, their names with a wrong ending, and the tables themselves, checked before reading."""
    folder = _write_event_arrays(spark, sf_dir)

    def files(path: str, kind: str, model: str | None) -> DataFrame:
        return (
            spark.read.format("binaryFile")
            .load(path)
            .select(F.lit(kind).alias("input"), F.col("path").alias("input_path"), F.lit(model).alias("model"))
        )

    arrays = files(folder, "array", "small").withColumn("batch", F.col("input_path"))
    missing = files(folder, "missing", None).withColumn("input_path", F.concat("input_path", F.lit(".gone")))
    missing = missing.withColumn("batch", F.col("input_path"))
    # A table may be a folder of files: each of them is checked, and the table is one batch.
    below = F.substring("input_path", len(qualified_path(spark, sf_dir)) + 2, 1 << 30)
    tables = files(f"{sf_dir}/*.parquet", "table", "small").withColumn("batch", F.substring_index(below, "/", 1))
    manifest = arrays.unionByName(missing).unionByName(tables)
    without_path = F.transform("errors", lambda e: F.regexp_replace(e, "^(input file not found): .*", "$1"))
    checked = batches.check_sources(manifest).select("input", "batch", "ok", without_path.alias("errors"))
    found = checked.groupBy("input", "batch").agg(
        F.bool_and("ok").alias("ok"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("errors")))).alias("errors")
    )
    return found.groupBy("input", "ok", F.array_join("errors", "; ").alias("errors")).agg(F.count("*").alias("batches"))


@query(f"""
WITH {DOCUMENT_ITEMS_SQL}, {judged_sql("doc_items", max_tokens=TOKENS)}
SELECT job_id, row_number, external_id, ok, status, error FROM judged
""")
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule messages of every document."""
    judged = validate(document_items(spark, sf_dir), standard_rules(max_tokens=TOKENS))
    return judged.select("job_id", "row_number", "external_id", "ok", "status", "error")


@query(f"""
WITH {CONVERSATION_ITEMS_SQL}, {judged_sql("conv_items", min_chars=60, max_tokens=TOKENS)}
SELECT row_number, external_id, ok, status, error, CAST(messages AS BIGINT) AS messages FROM judged
""")
def validate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected conversation turns; several rules may fail at once."""
    judged = validate(conversation_items(spark, sf_dir), standard_rules(60, TOKENS))
    return judged.select("row_number", "external_id", "ok", "status", "error", F.size("errors").cast("bigint").alias("messages"))


@query(f"""
WITH {CONVERSATION_ITEMS_SQL}, {judged_sql("conv_items")}
SELECT job_id, row_number, external_id, NOT is_malformed AND row_number > first_row AS is_repeat FROM judged
""")
def first_seen_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose conversation id was seen before in the batch."""
    return mark_repeats(conversation_items(spark, sf_dir)).select("job_id", "row_number", "external_id", "is_repeat")


@query(f"""
WITH {CONVERSATION_ITEMS_SQL}, {judged_sql("conv_items", min_chars=60)}, {winners_sql(FLUSH)}
SELECT job_id, external_id, row_number FROM won WHERE is_winner
""")
def load_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn that gets each id of the item table."""
    return load.winners(validate(conversation_items(spark, sf_dir), standard_rules(60)), FLUSH)


@query(f"""
WITH {CONVERSATION_ITEMS_SQL}, {judged_sql("conv_items", min_chars=60)}, {winners_sql(FLUSH)}
SELECT job_id, row_number, external_id, status, error,
       CASE WHEN is_winner THEN 'inserted' ELSE 'dropped_in_batch' END AS disposition
FROM won
""")
def judged_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation and load decision of every turn in one pass."""
    loaded = load.judge_and_load(conversation_items(spark, sf_dir), standard_rules(60), FLUSH)
    return loaded.select("job_id", "row_number", "external_id", "status", "error", "disposition")


@query(f"""
WITH {CONVERSATION_ITEMS_SQL}, {judged_sql("conv_items")}, {winners_sql(FLUSH)}
SELECT load, row_number, external_id, status, error, CASE WHEN is_winner AND ok AND load = 1 THEN prompt END AS prompt,
       CASE WHEN NOT is_winner THEN 'dropped_in_batch' WHEN load = 1 THEN 'inserted' ELSE 'dropped_existing' END AS disposition
FROM won, (VALUES (1), (2)) AS loads(load)
""")
def item_table_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations loaded twice into a stored item table: N rows, then none."""
    path, rows = f"{new_folder(spark, 'item-table')}/items", conversation_items(spark, sf_dir)
    loads = [items.load_items(rows, path, f"load-{n}", 0, flush_rows=FLUSH).withColumn("load", F.lit(n)) for n in (1, 2)]
    return loads[0].unionByName(loads[1]).select("load", "row_number", "external_id", "status", "error", "prompt", "disposition")


@query(f"""
WITH {CONVERSATION_ITEMS_SQL}, {judged_sql("conv_items")}, {winners_sql(FLUSH)}
SELECT row_number, external_id, status,
       CASE WHEN NOT is_winner THEN 'dropped_in_batch'
            WHEN external_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) THEN 'dropped_existing'
            ELSE 'inserted' END AS disposition
FROM won
""")
def idempotent_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load into a table that already holds the ids of the labels."""
    existing = table(spark, sf_dir, "labels").select(
        F.lit("conversations").alias("job_id"), F.col("doc_id").cast("string").alias("external_id")
    )
    judged = validate(conversation_items(spark, sf_dir))
    return load.idempotent_load(judged, existing.distinct(), FLUSH).select(
        "row_number", "external_id", "status", "disposition"
    )


@query(f"""
WITH {DOCUMENT_ITEMS_SQL}, {judged_sql("doc_items", max_tokens=TOKENS)}
SELECT job_id, external_id, status, CAST(CASE WHEN ok THEN length(prompt) END AS BIGINT) AS prompt_chars, error
FROM judged
""")
def bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected documents stacked and written as item rows."""
    judged = validate(document_items(spark, sf_dir), standard_rules(max_tokens=TOKENS))
    columns = ["job_id", "row_number", "external_id", "status"]
    stacked = load.stack_rows(
        judged.where("ok").select(*columns, "prompt"), judged.where("NOT ok").select(*columns, "error")
    )
    stored = materialise(load.item_rows(load.idempotent_load(stacked)), "items")
    return stored.select(
        "job_id", "external_id", "status", F.char_length("prompt").cast("bigint").alias("prompt_chars"), "error"
    )


@query(f"""
WITH {DOCUMENT_ITEMS_SQL}, {judged_sql("doc_items", max_tokens=TOKENS)}
SELECT job_id, count(*) AS total, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS accepted,
       CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS rejected
FROM judged GROUP BY job_id
""")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read, accepted and rejected per batch."""
    return reports.ingest_summary(validate(document_items(spark, sf_dir), standard_rules(max_tokens=TOKENS)))


@query(f"""
WITH {CONVERSATION_ITEMS_SQL}, {judged_sql("conv_items")}
SELECT CASE WHEN ok THEN 'accepted' ELSE 'rejected' END AS result, count(*) AS items FROM judged GROUP BY 1
""")
def ingest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by ingest result."""
    return reports.ingest_results(validate(conversation_items(spark, sf_dir)))


@query(f"""
WITH {DOCUMENT_ITEMS_SQL}, {judged_sql("doc_items", max_tokens=TOKENS)}, {winners_sql(500)}
SELECT job_id, count(*) AS total, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS accepted,
       CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS rejected,
       CAST(sum(CASE WHEN is_winner THEN 1 ELSE 0 END) AS BIGINT) AS loaded
FROM won GROUP BY job_id
""")
def ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents validated and loaded: the summary of each batch and its rows in the item table."""
    loaded = load.judge_and_load(document_items(spark, sf_dir), standard_rules(max_tokens=TOKENS))
    return loaded.groupBy("job_id").agg(
        F.count("*").alias("total"),
        F.count_if("ok").alias("accepted"),
        F.count_if(~F.col("ok")).alias("rejected"),
        F.count_if(F.col("disposition") == load.INSERTED).alias("loaded"),
    )


@query("""
SELECT doc_id + 1 AS row_number, CAST(doc_id AS VARCHAR) AS external_id,
       CASE WHEN length(text) > 100 THEN left(replace(text, chr(10), ' '), 100) || '...'
            ELSE replace(text, chr(10), ' ') END AS preview
FROM documents ORDER BY doc_id LIMIT 10
""")
def batch_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten prompts, cut to one line each."""
    first = document_items(spark, sf_dir).orderBy("row_number").limit(10)
    return first.select("row_number", "external_id", preview(F.col("prompt")).alias("preview"))


# Declared checks.

PRICE_IN, PRICE_OUT = 0.5, 1.5


@query(f"""
WITH totals AS (
  SELECT source AS job_id, count(*) AS items,
         sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END) AS prompt_tokens
  FROM documents GROUP BY 1),
costed AS (
  SELECT *, prompt_tokens / 1000000 * {PRICE_IN}::DOUBLE + items * 2048 / 1000000 * {PRICE_OUT}::DOUBLE AS usd FROM totals)
SELECT job_id, items, items > 40 AS too_many_items, round(usd, 6) AS projected_usd, usd > 0.2 AS over_budget FROM costed
""")
def batch_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with too many rows or too high a projected cost."""
    checked = limits.batch_limits(document_items(spark, sf_dir), PRICE_IN, PRICE_OUT, max_items=40, budget_usd=0.2)
    return checked.withColumn("projected_usd", F.round("projected_usd", 6))


_WINDOWS = {"en": 3000, "fr": 2500, "de": 2200}


@query("""
WITH sized AS (
  SELECT CAST(doc_id AS VARCHAR) AS external_id,
         CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END + 2048 AS need,
         CASE lang WHEN 'en' THEN 3000 WHEN 'fr' THEN 2500 WHEN 'de' THEN 2200 END AS win
  FROM documents)
SELECT external_id, need > win IS NOT TRUE AS ok,
       CASE WHEN need > win THEN 'validation: prompt and output need ' || need || ' tokens, window is ' || win END AS error
FROM sized
""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that leave no room for the output in their model's window."""
    windows = spark.createDataFrame(list(_WINDOWS.items()), "model string, window int")
    items = limits.with_windows(document_items(spark, sf_dir), windows)
    return validate(items, [limits.fits_context()], reject_duplicates=False).select("external_id", "ok", "error")


@query(r"""
SELECT CAST(page_id AS VARCHAR) AS external_id,
       CASE WHEN regexp_matches(html, '\{[A-Za-z_][A-Za-z0-9_]*\}')
            THEN 'validation: unfilled placeholder: ' || regexp_extract(html, '\{[A-Za-z_][A-Za-z0-9_]*\}') END AS error
FROM pages
""")
def placeholder_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts that still hold a {name} placeholder."""
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("external_id"),
        F.col("html").alias("prompt"),
        F.col("html").isNull().alias("is_malformed"),
    )
    judged = with_outcome(pages.withColumn("errors", row_messages([limits.no_placeholder()])))
    return judged.select("external_id", "error")


@query("""
WITH items AS (SELECT role AS job_id, conv_id AS external_id, count(*) AS n FROM conversations GROUP BY 1, 2)
SELECT job_id, count(*) AS repeated_ids, CAST(sum(n - 1) AS BIGINT) AS surplus_rows
FROM items WHERE n > 1 GROUP BY job_id
""")
def duplicate_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches to refuse because ids repeat; each role is a batch."""
    items = table(spark, sf_dir, "conversations").select(
        F.col("role").alias("job_id"), F.col("conv_id").alias("external_id"), F.lit(False).alias("is_malformed")
    )
    return limits.batches_with_repeats(items)
