"""Idempotent load of judged rows into the item table.

Within a flush of the reader accepted rows are written before rejected ones, and the first
writer of (job_id, external_id) wins. The winner is therefore the minimum of
(flush, is_failed, row_number), which needs no sort and is combined on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.text import whole_quotient
from promptloom.operators.prefix import number_rows
from promptloom.operators.validate import Rule, repeat_message, row_messages, standard_rules, with_outcome

# Fixed value: rows per flush.
FLUSH_ROWS = 500

INSERTED = "inserted"
DROPPED_IN_BATCH = "dropped_in_batch"
DROPPED_EXISTING = "dropped_existing"

_ROW = ["job_id", "row_number"]
_ITEM = ["job_id", "external_id"]


def flush_number(row_number: Column, flush_rows: int = FLUSH_ROWS) -> Column:
    return whole_quotient(row_number - 1, flush_rows)


def stack_rows(valid: DataFrame, failed: DataFrame) -> DataFrame:
    """Accepted and rejected rows as one frame; a column one side lacks is null there."""
    return valid.unionByName(failed, allowMissingColumns=True)


def _rank(row_number: Column, failed: Column, flush_rows: int) -> Column:
    """(flush, failed, row_number) as one number in the same order.

    A number can be minimised in a hash aggregation; a struct would have to be sorted.
    """
    flush = flush_number(row_number, flush_rows)
    place = row_number - 1 - flush * flush_rows
    return flush * (2 * flush_rows) + failed.cast("bigint") * flush_rows + place


def _ranked_row(rank: Column, flush_rows: int) -> Column:
    """Row number out of ``_rank``."""
    return whole_quotient(rank, 2 * flush_rows) * flush_rows + F.pmod(rank, F.lit(flush_rows)) + 1


def winners(judged: DataFrame, flush_rows: int = FLUSH_ROWS) -> DataFrame:
    """The row that gets each (job_id, external_id): (job_id, external_id, row_number)."""
    rank = _rank(F.col("row_number"), F.col("status") == "FAILED", flush_rows)
    return (
        judged.groupBy(*_ITEM)
        .agg(F.min(rank).alias("_rank"))
        .select(*_ITEM, _ranked_row(F.col("_rank"), flush_rows).alias("row_number"))
    )


def _known_items(existing: DataFrame) -> DataFrame:
    return existing.select(*_ITEM, F.lit(True).alias("_known"))


def idempotent_load(judged: DataFrame, existing: DataFrame | None = None, flush_rows: int = FLUSH_ROWS) -> DataFrame:
    """Add ``disposition`` to every judged row; the three values together cover the input.

    Only keys take part in deciding; the wide rows move once, by their row number.
    ``existing`` is the item table, which holds each (job_id, external_id) once.
    """
    won = winners(judged, flush_rows)
    if existing is None:
        decided = won.withColumn("disposition", F.lit(INSERTED))
    else:
        decided = won.join(_known_items(existing), _ITEM, "left").withColumn(
            "disposition", F.when(F.col("_known"), DROPPED_EXISTING).otherwise(INSERTED)
        )
    return judged.join(decided.select(*_ROW, "disposition"), _ROW, "left").withColumn(
        "disposition", F.coalesce("disposition", F.lit(DROPPED_IN_BATCH))
    )


def judge_and_load(
    items: DataFrame,
    rules: Sequence[Rule] | None = None,
    flush_rows: int = FLUSH_ROWS,
    existing: DataFrame | None = None,
) -> DataFrame:
    """``validate`` and ``idempotent_load`` with one aggregation and one join of the rows.

    Per (job_id, external_id) only two rows matter: the first parseable row, which alone can
    be accepted, and the first row of any kind. If the first parseable row passes its rules
    it competes as an accepted row with the first row of all; otherwise all rows fail and
    the first row of all wins.
    """
    messages = row_messages(standard_rules() if rules is None else rules)
    judged = items.withColumn("errors", messages)
    # Row number and failure in one number: even if the row passes, odd if it fails.
    coded = F.col("row_number") * 2 + (F.size("errors") > 0).cast("bigint")
    per_id = judged.groupBy(*_ITEM).agg(
        F.min(F.when(~F.col("is_malformed"), coded)).alias("_first"), F.min("row_number").alias("_lowest")
    )
    first_row = whole_quotient(F.col("_first"), 2)
    first_passes = F.col("_first").isNotNull() & (F.pmod(F.col("_first"), F.lit(2)) == 0)
    best = F.least(
        _rank(first_row, F.lit(False), flush_rows), _rank(F.col("_lowest"), F.lit(True), flush_rows)
    )
    winner_row = F.when(first_passes, _ranked_row(best, flush_rows)).otherwise(F.col("_lowest"))
    decided = per_id.select(*_ITEM, first_row.alias("_first_row"), winner_row.alias("_winner_row"))
    taken = F.lit(INSERTED)
    if existing is not None:
        decided = decided.join(_known_items(existing), _ITEM, "left")
        taken = F.when(F.col("_known"), DROPPED_EXISTING).otherwise(INSERTED)
    marks = (
        decided.withColumn("_taken", taken)
        .withColumn(
            "row_number", F.explode(F.array_distinct(F.array_compact(F.array("_first_row", "_winner_row"))))
        )
        .select(
            *_ROW,
            F.coalesce(F.col("row_number") == F.col("_first_row"), F.lit(False)).alias("_is_first"),
            F.when(F.col("row_number") == F.col("_winner_row"), F.col("_taken")).alias("_won"),
        )
    )
    marked = judged.join(marks, _ROW, "left").withColumn(
        "is_repeat", ~F.col("is_malformed") & ~F.coalesce("_is_first", F.lit(False))
    )
    return (
        with_outcome(
            marked.withColumn("errors", F.array_compact(F.concat("errors", F.array(repeat_message()))))
        )
        .withColumn("disposition", F.coalesce("_won", F.lit(DROPPED_IN_BATCH)))
        .drop("is_repeat", "_is_first", "_won")
    )


def item_rows(loaded: DataFrame) -> DataFrame:
    """Rows of the item table out of a load: the inserted ones; rejected rows lose their prompt."""
    return loaded.where(F.col("disposition") == INSERTED).select(
        "job_id",
        "row_number",
        "external_id",
        F.when(F.col("status") == "PENDING", F.col("prompt")).alias("prompt"),
        "status",
        "error",
    )


def with_item_ids(items: DataFrame, after: int = 0) -> DataFrame:
    """Gap-free ``id`` in (job_id, row_number) order, continuing after ``after``."""
    return number_rows(items, [], ["job_id", "row_number"], "id").withColumn("id", F.col("id") + F.lit(after))
