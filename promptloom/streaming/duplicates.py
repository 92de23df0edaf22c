"""Ids seen before, over an unbounded stream of items."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from promptloom.session import ship_package


def distinct_items(items: DataFrame, fan: int = 32) -> DataFrame:
    """Pass one row per (job_id, external_id) and drop the later ones.

    Apply it to parseable rows before the other rules. The first stage drops repeats within
    ``fan`` slices of an id, so an id that never stops coming is spread over tasks and at
    most ``fan`` of its rows ever reach the second stage.
    """
    sliced = items.withColumn("_slice", F.pmod(F.xxhash64("row_number"), F.lit(fan)))
    return (
        sliced.dropDuplicates(["job_id", "external_id", "_slice"])
        .drop("_slice")
        .dropDuplicates(["job_id", "external_id"])
    )


def distinct_items_within(items: DataFrame, at: str, delay: str) -> DataFrame:
    """As ``distinct_items`` with state bounded by a watermark: ids are forgotten after ``delay``."""
    return items.withWatermark(at, delay).dropDuplicatesWithinWatermark(["job_id", "external_id"])


def seen_counts(items: DataFrame) -> DataFrame:
    """First row and number of rows of every id so far; combined on the map side."""
    return items.groupBy("job_id", "external_id").agg(
        F.min("row_number").alias("first_row"), F.count("*").alias("rows")
    )


REPEATS = "job_id string, external_id string, row_number bigint, first_row bigint, error string"
_KNOWN = "job_id array<string>, external_id array<string>, first_row array<bigint>, ends array<bigint>"

# Groups of ids that share a state: a call for each id would cost more than its rows. A stream keeps its number.
ID_GROUPS = 1 << 12


def repeated_items(items: DataFrame, keep_for_seconds: float, groups: int = ID_GROUPS) -> DataFrame:
    """The rows whose id came before: (job_id, external_id, row_number, first_row, error).

    The counterpart of ``distinct_items`` that reports what that one drops. An id is remembered
    for ``keep_for_seconds`` after its first row, then it counts as new; so the state is
    bounded by the ids of that time. Of rows of one micro-batch the smallest number is the
    first. Only ids and numbers move; ids are hashed to ``groups``, and the rows of one group
    and micro-batch meet in one task, which holds their numbers. Null ids are ids like others.
    """
    ship_package(items.sparkSession)
    keep_ms = max(1, int(keep_for_seconds * 1000))

    def report(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        stored = zip(*state.get, strict=True) if state.exists else ()
        known = {(job_id, external_id): (first, ends) for job_id, external_id, first, ends in stored if now < ends}
        numbers: dict[tuple, list[int]] = {}
        for part in () if state.hasTimedOut else parts:
            for *name, number in zip(*(part[c].tolist() for c in ("job_id", "external_id", "row_number")), strict=True):
                numbers.setdefault(tuple(x if isinstance(x, str) else None for x in name), []).append(number)
        found = []
        for name, own in numbers.items():
            # The rows of a micro-batch come in no order.
            if name not in known:
                known[name] = (min(own), now + keep_ms)
                own.remove(known[name][0])  # a repeated number is a repeat, too
            error = None if name[1] is None else f"duplicate external id: {name[1]}"
            found += [(*name, number, known[name][0], error) for number in own]
        if known:
            state.update(tuple(map(list, zip(*((*name, *kept) for name, kept in known.items()), strict=True))))
            state.setTimeoutDuration(max(1, min(ends for _, ends in known.values()) - now))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=["job_id", "external_id", "row_number", "first_row", "error"])

    keyed = items.select(
        F.col("job_id").cast("string"), F.col("external_id").cast("string"), F.col("row_number").cast("bigint").alias("row_number")
    ).withColumn("_group", F.pmod(F.xxhash64("job_id", "external_id"), F.lit(groups)))
    return keyed.groupBy("_group").applyInPandasWithState(
        report, REPEATS, _KNOWN, "append", GroupStateTimeout.ProcessingTimeTimeout
    )
