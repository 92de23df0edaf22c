"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of ten consecutive words of the benchmark texts; a shorter text is
one pattern. Patterns of one length are searched together: the block of the last two words
under the search window tells how far the window can be shifted without passing an
occurrence. Only where the shift is zero, the patterns that end in that block are looked up
by the hash of the block, filtered by their first two words, and compared word by word.

Patterns are divided into shards by hash, so that no shard is larger than ``shard_bytes``;
a shard is collected and broadcast, and one pass over the documents searches it. Benchmarks
up to that size need one pass. Between passes the rows are written to the shared folder.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.llm.common import add_columns, table
from promptloom.llm.registry import query
from promptloom.session import materialise

WINDOW = 10
SHARD_BYTES = 32 << 20

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Bytes of words, A-Z in lower case; all else is a blank. Bytes from 0x80 on are parts of words.
_FOLD = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256)
)
_FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("hits", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _folded(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, _BREAKS), lambda word: word != "")


def windows_of(benchmark: DataFrame, item_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Distinct ``window, item_id``: the patterns, as words joined by a blank."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), _folded(F.col(text_col)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return (
        items.where(F.size("w") > 0)
        .select("item_id", "w", F.explode(starts).alias("at"))
        .select(F.concat_ws(" ", F.slice("w", F.col("at"), window)).alias("window"), "item_id")
        .distinct()
    )


class WuManber:
    """Search for many word sequences at once."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        self.items = patterns
        self.single = {p[0]: p for p in patterns if len(p) == 1}
        self.by_length: dict[int, tuple[dict, dict]] = {}
        for pattern in patterns:
            length = len(pattern)
            if length == 1:
                continue
            shift, buckets = self.by_length.setdefault(length, ({}, defaultdict(list)))
            for end in range(1, length):
                block = (pattern[end - 1], pattern[end])
                shift[block] = min(shift.get(block, length), length - 1 - end)
            buckets[pattern[-2], pattern[-1]].append(pattern)

    def occurrences(self, words: list[bytes]):
        """``(start, pattern)`` of all occurrences."""
        if self.single:
            for at, word in enumerate(words):
                if word in self.single:
                    yield at, self.single[word]
        for length, (shift, buckets) in self.by_length.items():
            far, end, count, shift_of = length - 1, length - 1, len(words), shift.get
            while end < count:
                block = (words[end - 1], words[end])
                step = shift_of(block, far)
                if step:
                    end += step
                    continue
                start = end - length + 1
                head = (words[start], words[start + 1])
                for pattern in buckets[block]:
                    if pattern[:2] == head and tuple(words[start : end + 1]) == pattern:
                        yield start, pattern
                end += 1


def _union(ranges: list[list[int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for start, end in sorted(ranges):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return merged


def _searched(docs: DataFrame, text_col: str, shard, found: bool, keep: list[str]) -> DataFrame:
    def make():
        search = WuManber({tuple(k.encode().split(b" ")): v for k, v in shard.value.items()})

        def step(batch: pa.RecordBatch) -> list:
            counts, hits, ids = [], [], []
            before = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()) if found else None
            for text in batch.column(0):
                words = words_of(text.as_py())
                ranges, items = next(before) if before else ([], [])
                ranges, items = list(ranges), set(items)
                for start, pattern in search.occurrences(words):
                    ranges.append([start, start + len(pattern)])
                    items |= search.items[pattern]
                counts.append(len(words))
                hits.append(_union(ranges))
                ids.append(sorted(items))
            return [counts, hits, ids]

        return step

    inputs = [F.col(f"`{text_col}`").cast("binary"), *([F.col("hits"), F.col("item_ids")] if found else [])]
    return add_columns(docs, inputs, _FIELDS, make, keep)


def find_benchmark_words(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` and ``item_ids``.

    ``hits`` are the ranges of words ``[start, end)`` inside occurrences, merged and in order;
    ``item_ids`` the items (as strings, sorted) with an occurring window. A null or empty text
    has no words and no hits. Items without words are no patterns. The windows of an item with
    a null id count for hits but name no item; items that share an id are one item. Repeated
    rows are judged one by one. Columns of ``docs`` with the new names are replaced.
    """
    context = docs.sparkSession.sparkContext
    windows = materialise(windows_of(benchmark, item_col, item_text_col, window), "windows")
    size = windows.agg(F.sum(F.length("window") + F.length(F.coalesce("item_id", F.lit(""))) + 100)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    keep = [name for name in docs.columns if name not in _FIELDS.names]
    found = docs
    for number in range(shards):
        mine = windows.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(shards)) == number)
        patterns: dict[str, set[str]] = defaultdict(set)
        for row in mine.toLocalIterator():
            patterns[row["window"]] |= {row["item_id"]} - {None}
        found = _searched(found, text_col, context.broadcast(dict(patterns)), number > 0, keep)
        if number < shards - 1:
            found = materialise(found, "searched")
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The rows of ``docs`` without a benchmark window, with the columns of ``docs``."""
    fresh = {name: f"__own_{name}" for name in _FIELDS.names if name in docs.columns}
    found = find_benchmark_words(docs.withColumnsRenamed(fresh), benchmark, **names)
    kept = found.where(F.size("hits") == 0).drop(*_FIELDS.names)
    return kept.withColumnsRenamed({new: old for old, new in fresh.items()}).select(*[f"`{c}`" for c in docs.columns])


ORACLE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pattern AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM pattern),
starts AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n),
hit AS (
  SELECT s.r, s.i, p.n, p.item_id
  FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM starts) s JOIN pattern p ON s.n = p.n AND s.win = p.win),
words AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
items AS (
  SELECT r, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


@query(ORACLE)
def op1_decontaminate(spark, sf_dir):
    """Words of every document that lie inside benchmark windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark_words(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda total, hit: total + (hit[1] - hit[0]).cast("bigint"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
