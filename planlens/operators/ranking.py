"""Positions in a global order without sorting all rows in one task.

A window without partitions would pull every row into one task.  Here rows are
dealt out by ranges of the whole order, sorted within their range and stored;
a row's position is its place in its range plus the number of rows in the
ranges before.  Only one row per range passes through a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from planlens.session import materialise

#: ``monotonically_increasing_id`` keeps the row number of a task in so many bits, and the task above them.
ROW_BITS = 33


def in_ranges(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The rows, sorted and stored by ranges of ``order``, with ``_range`` and their place ``_at`` in it (from 0).

    Rows that tie in ``order`` are told apart by a digest of all their columns,
    so that a value which many rows share is still cut into ranges; only rows
    equal in every column stay together.  Ranges follow a sample of the whole
    key, whatever its first characters.  No column may be a map.
    """
    order = [F.col(k).asc_nulls_last() if isinstance(k, str) else k for k in order]
    keys = [*order, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The ranges come from a sample, so they are fixed by storing them: both readers below see the same ones.
    stored = materialise(dealt.withColumn("_id", F.monotonically_increasing_id()))
    return stored.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.shiftright("_id", ROW_BITS).alias("_range"),
        F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_at"),
    )


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """The rows with their 1-based position in ``order``, without gaps or shared places.

    A column name sorts ascending with NULL last; an expression sorts as it says.
    Writes one table while it is built.
    """
    rows = in_ranges(df, order)
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    placed = rows.join(F.broadcast(starts), F.col("_range") == F.col("_r"))  # one row per shuffle partition
    columns = [F.col(f"`{c}`") for c in df.columns]
    return placed.select(*columns, (F.col("_start") + F.col("_at") + 1).alias(name))
