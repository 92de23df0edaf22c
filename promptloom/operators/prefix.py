"""Gap-free numbering and running totals without a single-task window.

Rows are range-sorted by (group, order), so one large group spans many partitions, and
stored together with their partition and place. What a row still lacks is what its group
holds in earlier partitions. That comes from a table with one row per group and partition,
which is made from counts and never from rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.session import materialise, ship_package

_PART, _PLACE = "_part", "_place"
_PLACE_BITS = 33  # layout of monotonically_increasing_id

# Largest table of groups per partition that is sent to all executors (some MB).
MOST_BROADCAST_ROWS = 100_000


def placed_rows(df: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``df`` range-sorted by (group, order) with partition number and place, written once."""
    keys = [*group, *order]
    spot = F.col("_spot")
    return materialise(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_spot", F.monotonically_increasing_id())
        .withColumn(_PART, F.shiftright(spot, _PLACE_BITS))
        .withColumn(_PLACE, spot.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
        .drop("_spot"),
        "placed",
    )


def _join_parts(placed: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Look up each row's (group, part) in a stored table that holds all of them.

    The table is broadcast only if it was counted and found small; a larger one is joined by
    (group, part), of which no pair has more rows than a partition.
    """
    renamed = parts.withColumnsRenamed({key: f"_p{key}" for key in keys})
    if renamed.limit(MOST_BROADCAST_ROWS + 1).count() <= MOST_BROADCAST_ROWS:
        renamed = F.broadcast(renamed)
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_p{key}"))
    return placed.join(renamed, same).drop(*[f"_p{key}" for key in keys])


def number_placed(
    placed: DataFrame, group: Sequence[str], part: str, place: str, name: str, last: str | None = None
) -> DataFrame:
    """Number stored rows that stand in order already.

    The parts of a group follow each other by ``part``; within one part the rows of a group
    have consecutive ``place`` numbers, from whatever start. No row is moved or sorted.
    """
    by_part = Window.partitionBy(*group).orderBy(part)
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        placed.groupBy(*group, part)
        .agg(F.count("*").alias("_n"), F.min(place).alias("_start"))
        .select(
            *group,
            part,
            (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_start") + 1).alias("_shift"),
            F.when(F.lead(part).over(by_part).isNull(), F.col("_start") + F.col("_n") - 1).alias("_end"),
        )
    )
    joined = _join_parts(placed, materialise(parts, "parts"), [*group, part])
    numbered = joined.withColumn(name, F.col(place) + F.col("_shift"))
    if last is not None:
        numbered = numbered.withColumn(last, F.coalesce(F.col(place) == F.col("_end"), F.lit(False)))
    return numbered.drop(part, place, "_shift", "_end")


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    name: str = "seq",
    last: str | None = None,
) -> DataFrame:
    """Number the rows of each group 1, 2, 3, … in the given order.

    ``last`` names a further column that is true for the last row of each group. ``df`` is
    written once, so hand in keys rather than long texts where that is possible.
    """
    return number_placed(placed_rows(df, group, order), group, _PART, _PLACE, name, last)


def running_totals(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], values: Mapping[str, str]
) -> DataFrame:
    """For each ``name: column`` in ``values`` the sum from the group's first row to this one."""
    placed = placed_rows(df, group, order)
    earlier = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*group, _PART).agg(*[F.sum(column).alias(name) for name, column in values.items()])
    before = parts.select(
        *group, _PART, *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_b{name}") for name in values]
    )
    upto = Window.partitionBy(*group, _PART).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({name: F.sum(column).over(upto) for name, column in values.items()})
    joined = _join_parts(local, materialise(before, "parts"), [*group, _PART])
    return joined.withColumns({name: F.col(name) + F.col(f"_b{name}") for name in values}).drop(
        _PART, _PLACE, *[f"_b{name}" for name in values]
    )


def running_sums(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], values: Mapping[str, str]
) -> DataFrame:
    """``running_totals`` of BIGINT columns, summed right where the rows have been sorted.

    The rows are shuffled once, by range. Arrow batches are summed as they leave the sort and
    stored, and what a group holds in earlier partitions is added from a table with one row per
    group and partition. A null counts as 0.
    """
    ship_package(df.sparkSession)
    keys, names = [*group, *order], list(values)
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_PART, F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, *(T.StructField(name, T.LongType(), False) for name in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, dict.fromkeys(names, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            first = [batch.column(g)[0] for g in group]
            starts = group_starts([batch.column(g) for g in group], batch.num_rows)
            starts[0] = last is None or not all(a.equals(b) for a, b in zip(first, last, strict=True))
            begin = np.maximum.accumulate(np.where(starts, np.arange(batch.num_rows), -1))
            columns = []
            for name, column in values.items():
                own = pc.fill_null(batch.column(column).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                upto = np.cumsum(own)
                sums = upto - np.where(begin >= 0, (upto - own)[begin], -carried[name])
                carried[name] = int(sums[-1])
                columns.append(pa.array(sums, pa.int64()))
            last = [batch.column(g)[batch.num_rows - 1] for g in group]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    local = materialise(ranged.mapInArrow(run, schema), "running")
    earlier = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = local.groupBy(*group, _PART).agg(*[F.sum(F.col(column).cast("bigint")).alias(name) for name, column in values.items()])
    before = parts.select(*group, _PART, *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_b{name}") for name in names])
    joined = _join_parts(local, materialise(before, "parts"), [*group, _PART])
    return joined.withColumns({name: F.col(name) + F.col(f"_b{name}") for name in names}).drop(_PART, *[f"_b{name}" for name in names])


def group_starts(columns: list[pa.Array], rows: int) -> np.ndarray:
    """Rows that differ from the one before in any of the columns; nulls are equal."""
    starts = np.zeros(rows, bool)
    for column in columns:
        one, other = column.slice(0, rows - 1), column.slice(1)
        differ = pc.fill_null(pc.not_equal(one, other), False)
        starts[1:] |= pc.or_(differ, pc.xor(pc.is_null(one), pc.is_null(other))).to_numpy(zero_copy_only=False)
    return starts
