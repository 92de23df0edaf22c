"""Compare a query with its SQL in DuckDB as multisets of rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    return _rows(names, result.fetchall())


def spark_rows(frame) -> tuple[list[str], Counter]:
    return _rows(frame.columns, [tuple(row) for row in frame.collect()])


def _rows(names: list[str], rows: list[tuple]) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple((type(row[i]).__name__, row[i]) for i in order) for row in rows)
