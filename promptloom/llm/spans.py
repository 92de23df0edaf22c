"""Spans of a text by kind, counted in code points, and what the queries return of them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.llm.common import add_columns

Span = tuple[str, int, int]

SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
)
_FIELDS = T.StructType([T.StructField("base_spans", SPANS), T.StructField("all_spans", SPANS)])


def overlaps(start: int, stop: int, spans: Sequence[Span]) -> bool:
    return any(start < b and a < stop for _, a, b in spans)


def in_code_points(text: bytes, spans: list[Span]) -> list[Span]:
    """Byte offsets of ``text`` turned into code points, in one walk."""
    if not spans or text.isascii():
        return spans
    places, at, points = {}, 0, 0
    for place in sorted({x for _, a, b in spans for x in (a, b)}):
        points += len(text[at:place].decode("utf-8", "replace"))
        at = places[place] = place
        places[place] = points
    return [(kind, places[a], places[b]) for kind, a, b in spans]


def find_spans(
    docs: DataFrame, text_col: str, kinds: Sequence[str], make: Callable[[], Callable[[bytes], tuple[list[Span], list[Span]]]]
) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``, by start, then in the order of ``kinds``."""

    def start():
        find, rank = make(), {kind: i for i, kind in enumerate(kinds)}

        def step(batch: pa.RecordBatch) -> list:
            found: list[list] = [[], []]
            for value in batch.column(0):
                text = value.as_py() or b""
                base, more = find(text)
                for out, spans in zip(found, (base, [*base, *more]), strict=True):
                    spans = sorted(in_code_points(text, spans), key=lambda s: (s[1], rank[s[0]], s[2]))
                    out.append([{"kind": k, "start": a, "stop": b} for k, a, b in spans])
            return found

        return step

    return add_columns(docs, [F.col(f"`{text_col}`").cast("binary")], _FIELDS, start)


def digest_columns(found: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """``doc_id, n_<kind>…, base_sha256, spans`` of what ``find_spans`` returned."""

    def joined(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def number(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[number(k) for k in kinds], F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("all_spans").alias("spans"))


def sha256_of(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
