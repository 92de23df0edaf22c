"""What the operators of this subpackage share: words, hashes, and Arrow batches of rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from promptloom.session import materialise, ship_package

# White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
NOT_SPACE = r"[^\x20\x09-\x0D]+"

ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PIECE = 1 << 16  # bytes of a text that are hashed at once
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * ODD)


def _powers(base: np.uint64, count: int) -> np.ndarray:
    factors = np.full(count, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


_POWERS, _BACK_POWERS = _powers(ODD, 2 * _PIECE), _powers(_BACK, 2 * _PIECE)


def _piece_hashes(piece: bytes) -> np.ndarray:
    """A word's hash is a polynomial in the codes of its bytes, from differences of running sums."""
    codes = np.frombuffer(piece, np.uint8)
    inside = np.concatenate([[False], ~_SPACES[codes], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    if len(codes) < len(_POWERS):
        up, back = _POWERS[: len(codes)], _BACK_POWERS[starts]
    else:  # one word as long as this
        up, back = _powers(ODD, len(codes)), _powers(_BACK, len(codes))[starts]
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_CODES[codes] * up, dtype=np.uint64, out=sums[1:])
    return mix((sums[stops] - sums[starts]) * back)


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of ``text``, which stand between white space, in order."""
    text = text or b""
    if len(text) <= _PIECE:
        return _piece_hashes(text)
    pieces, at = [], 0
    while at < len(text):
        end = _SPACE.search(text, at + _PIECE)
        stop = end.start() if end else len(text)
        pieces.append(_piece_hashes(text[at:stop]))
        at = stop
    return np.concatenate(pieces)


def runs_of_words(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` consecutive words, in order."""
    count = len(hashes) - width + 1
    if count <= 0:
        return hashes[:0]
    value = hashes[:count].copy()
    for step in range(1, width):
        value = value * ODD + hashes[step : step + count]
    return mix(value)


def add_columns(
    df: DataFrame,
    inputs: Sequence[str | Column],
    fields: T.StructType,
    make: Callable[[], Callable[[pa.RecordBatch], list]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` with columns computed from Arrow batches of ``inputs``.

    ``make`` is called once per task; what it returns gets a batch of the input columns and
    gives one list or array per field. ``keep`` names the columns of ``df`` that stay (all of
    them if it is None). A kept column that has the name of a new one is replaced.
    """
    ship_package(df.sparkSession)
    kept = [name for name in (df.columns if keep is None else keep) if name not in fields.names]
    count = len(inputs)
    columns = [F.col(f"`{x}`") if isinstance(x, str) else x for x in inputs]
    rows = df.select(
        F.struct(*[c.alias(f"i{i}") for i, c in enumerate(columns)]).alias("in"),
        *[F.col(f"`{name}`") for name in kept],
    )
    schema = T.StructType([*rows.schema.fields[1:], *fields.fields])
    added = list(to_arrow_schema(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            given = batch.column(0)
            values = step(pa.RecordBatch.from_arrays([given.field(i) for i in range(count)], [f"i{i}" for i in range(count)]))
            arrays = [v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, added, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *arrays], [*batch.schema.names[1:], *(f.name for f in added)]
            )

    return rows.mapInArrow(run, schema)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``materialise``, and let Spark remove the shuffle files of what has been written.

    Spark removes them when the driver collects its garbage, which an idle driver seldom does;
    a job of many steps would keep the files of all of them.
    """
    result = materialise(df, label)
    df.sparkSession.sparkContext._jvm.System.gc()
    return result


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
