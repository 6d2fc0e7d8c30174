"""Equi-joins on one key in which NULL matches NULL.

There is one path for every key and size.  The side that may hold many rows of
one key is always one that adaptive execution can split (the left one of left,
semi and anti joins, either one of an inner join) or is cut into pieces.  Which side is broadcast is
left to the optimizer, which knows the sizes.  Where the right side is different ids alone, a task holds its
share of these and lets the left rows pass: sorted, half of them on one key would fill its memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Pieces for each shuffle partition that a hot key is cut into; several, so that chance deals them out evenly.
PIECES = 8


def _keyed(df: DataFrame, on: str) -> DataFrame:
    return df.withColumnRenamed(on, "_r_key")


def _joined(left: DataFrame, right: DataFrame, on: str, how: str) -> DataFrame:
    renamed = _keyed(right, on)
    return left.join(renamed, left[on].eqNullSafe(renamed["_r_key"]), how).drop("_r_key")


def _different(ids: DataFrame, on: str, **marks: Column) -> DataFrame:
    """The different ids, with constant ``marks``, to be held in a hash table by the task that joins them."""
    return ids.select(on).distinct().withColumns(marks).hint("shuffle_hash")


def left_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """All left rows, of which a key may have many, with their matches."""
    return _joined(left, right, on, "left")


def semi_join(left: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Left rows whose key occurs in ``ids``; a NULL key matches a NULL id."""
    return _joined(left, _different(ids, on), on, "left_semi")


def anti_join(left: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Left rows whose key does not occur in ``ids``; NULL keys stay unless NULL is an id."""
    return _joined(left, _different(ids, on), on, "left_anti")


def inner_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """The matches alone; either side may have many rows of a key."""
    return _joined(left, right, on, "inner")


def lookup_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """All rows of a unique ``left`` with their many, possibly very many, ``right`` matches.

    A left join cannot split its right side.  So the right rows of a key are cut
    into pieces by a digest of the row, and a left row goes to each piece that its
    key has, or, without any match, to none, where the second join leaves it
    alone.  ``left`` is read once, ``right`` once for its keys and pieces and once
    for its rows; a hot key spreads over all partitions.  Rows that are equal in
    every column share a piece.  No column of ``right`` may be a map.
    """
    most = PIECES * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    renamed = _keyed(right, on)
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in renamed.columns])
    rows = renamed.withColumn("_r_piece", F.pmod(digest, F.lit(most)))
    pieces = rows.select(F.col("_r_key").alias(on), F.col("_r_piece").alias("_piece")).distinct()
    spread = left_join(left, pieces, on)
    same = spread[on].eqNullSafe(rows["_r_key"]) & (spread["_piece"] == rows["_r_piece"])
    return spread.join(rows, same, "left").drop("_piece", "_r_key", "_r_piece")


def mark_member(left: DataFrame, ids: DataFrame, on: str, name: str) -> DataFrame:
    """Left rows with a true/false column: does the key occur in ``ids``?"""
    marked = left_join(left, _different(ids, on, **{name: F.lit(True)}), on)
    return marked.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def full_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Full outer join of tables that are unique (or nearly so) in their key."""
    renamed = _keyed(right, on)
    joined = left.join(renamed, left[on].eqNullSafe(renamed["_r_key"]), "full")
    return joined.withColumn(on, F.coalesce(on, "_r_key")).drop("_r_key")
