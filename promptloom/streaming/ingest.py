"""Incremental, idempotent ingest of item streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from promptloom.operators.load import FLUSH_ROWS
from promptloom.operators.validate import Rule
from promptloom.sources.items import load_items
from promptloom.streaming.runs import run_folder


def load_batch(batch: DataFrame, epoch: int, path: str, rules: Sequence[Rule] | None, flush_rows: int) -> None:
    """Load a micro-batch into the item table; a repeated one writes the same rows again."""
    run_id = run_folder(batch.sparkSession, epoch).split("/")[0].removeprefix("run_id=")
    load_items(batch, path, run_id, epoch, rules, flush_rows)


def ingest_stream(
    items: DataFrame, path: str, rules: Sequence[Rule] | None = None, flush_rows: int = FLUSH_ROWS
) -> DataStreamWriter:
    """Writer that loads a stream of items into the item table at ``path``.

    A batch whose ids repeat should arrive in one micro-batch; across micro-batches the
    earlier one wins. What became of every row of the stream is in ``items.read_loads``.
    """
    return items.writeStream.foreachBatch(lambda batch, epoch: load_batch(batch, epoch, path, rules, flush_rows))
