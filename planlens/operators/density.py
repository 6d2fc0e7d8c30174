"""Exact quantiles and kernel densities of a bounded value per group.

Groups are the levels of a figure (a handful).  No step gathers the values of a
group: quantiles descend through bins, densities go over a fixed set of nodes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

LEVEL_BITS = 16
LEVELS = 3
NODES = 512


def _counted(cells: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Running number of rows before and up to each bin; at most 2**LEVEL_BITS bins per key."""
    window = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumn("_upto", F.sum("_rows").over(window)).withColumn("_before", F.col("_upto") - F.col("_rows"))


def quantiles(
    df: DataFrame, group: str, value: str, low: float, high: float, probabilities: Sequence[float]
) -> DataFrame:
    """Linearly interpolated quantiles of values in [low, high], one row per group.

    Values are cut into 2**48 cells.  The bins of the upper 16 bits tell which
    bin holds a wanted rank, the next 16 bits are then counted in that bin only,
    and so on; the last step returns the smallest value of the cell.
    Columns: group, ``n``, and the array ``quantiles``.
    """
    bits = LEVEL_BITS * LEVELS
    cell = F.least(F.floor((F.col(value) - low) / (high - low) * float(2**bits)), F.lit(2**bits - 1))
    rows = df.select(F.col(group).alias("_g"), F.col(value).alias("_v"), cell.alias("_cell"))

    def at_level(level: int) -> Column:
        return F.shiftright(F.col("_cell"), bits - LEVEL_BITS * (level + 1))

    counts = rows.groupBy("_g", at_level(0).alias("_prefix")).agg(F.count(F.lit(1)).alias("_rows"))
    totals = counts.groupBy(F.col("_g").alias("_t")).agg(F.sum("_rows").alias("n"))
    ranks = [
        F.struct(F.lit(2 * i + side).alias("slot"), edge((F.col("n") - 1) * p).cast("long").alias("rank"))
        for i, p in enumerate(probabilities)
        for side, edge in enumerate((F.floor, F.ceil))
    ]
    wanted = totals.select("_t", F.inline(F.array(*ranks)))
    located = _counted(counts, ["_g"], "_prefix").join(F.broadcast(wanted), F.col("_g") == F.col("_t"))
    targets = _hit(located)
    for level in range(1, LEVELS):
        inside = rows.withColumn("_up", at_level(level - 1)).join(
            F.broadcast(targets), F.col("_g").eqNullSafe(F.col("_tg")) & (F.col("_up") == F.col("_tp"))
        )
        cells = inside.groupBy("_g", "slot", "rank", at_level(level).alias("_prefix")).agg(
            F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_least")
        )
        targets = _hit(_counted(cells, ["_g", "slot"], "_prefix"))
    values = targets.groupBy("_tg").agg(
        *[F.max(F.when(F.col("slot") == s, F.col("_least"))).alias(f"_q{s}") for s in range(2 * len(probabilities))]
    )
    result = totals.join(values, F.col("_t") == F.col("_tg"))
    positions = [(F.col("n") - 1) * p for p in probabilities]
    interpolated = [
        F.col(f"_q{2 * i}") + (h - F.floor(h)) * (F.col(f"_q{2 * i + 1}") - F.col(f"_q{2 * i}"))
        for i, h in enumerate(positions)
    ]
    return result.select(F.col("_t").alias(group), "n", F.array(*interpolated).alias("quantiles"))


def _hit(counted: DataFrame) -> DataFrame:
    """The bins that hold the wanted ranks, with the rank inside the bin."""
    hit = counted.where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_upto")))
    least = [F.col("_least")] if "_least" in counted.columns else []
    return hit.select(
        F.col("_g").alias("_tg"), "slot", (F.col("rank") - F.col("_before")).alias("rank"), F.col("_prefix").alias("_tp"), *least
    )


def bandwidths(df: DataFrame, group: str, value: str, low: float, high: float) -> DataFrame:
    """Rule-of-thumb bandwidth 0.9 * min(sd, IQR / 1.34) * n ** -0.2 per group.

    Groups with fewer than two values have none.  Without spread between the
    quartiles the standard deviation is used, without any spread the size of the values.
    """
    quarters = quantiles(df, group, value, low, high, (0.25, 0.75))
    spread = df.groupBy(F.col(group).alias("_sg")).agg(
        F.stddev_samp(value).alias("_sd"), F.abs(F.min(value)).alias("_size")
    )
    both = quarters.join(spread, F.col(group) == F.col("_sg")).where(F.col("n") >= 2)
    iqr = (F.col("quantiles")[1] - F.col("quantiles")[0]) / 1.34
    narrow = F.least(F.col("_sd"), iqr)
    scale = (
        F.when(narrow > 0, narrow).when(F.col("_sd") > 0, F.col("_sd")).when(F.col("_size") > 0, F.col("_size")).otherwise(1.0)
    )
    return both.select(group, "n", (0.9 * scale * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"))


def kernel_density(
    df: DataFrame, group: str, value: str, low: float, high: float, points: int = 512
) -> DataFrame:
    """Gaussian kernel density per group at equally spaced points of [low, high].

    Every value is shared between its two neighbours of 512 nodes, which reach
    four bandwidths beyond the limits; the kernel sums over the nodes are then
    interpolated to the points.  Work after the one pass over the values is a fixed
    512 * points per group.
    """
    kept = df.where(F.col(value).between(low, high))
    widths = bandwidths(kept, group, value, low, high)
    start = low - 4 * F.col("bw")
    step = (high - low + 8 * F.col("bw")) / (NODES - 1)
    scaled = widths.select(F.col(group).alias("_wg"), "n", "bw", start.alias("_start"), step.alias("_step"))
    placed = kept.join(F.broadcast(scaled), F.col(group) == F.col("_wg")).select(
        F.col(group), "n", "bw", "_start", "_step", ((F.col(value) - F.col("_start")) / F.col("_step")).alias("_at")
    )
    node = F.floor("_at")
    share = F.col("_at") - node
    shares = F.array(
        F.struct(node.alias("node"), (1 - share).alias("weight")), F.struct((node + 1).alias("node"), share.alias("weight"))
    )
    parameters = [group, "n", "bw", "_start", "_step"]
    weights = placed.select(*parameters, F.inline(shares)).groupBy(*parameters, "node")
    nodes = weights.agg(F.sum("weight").alias("weight"))
    spread = nodes.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i"))
    y = low + F.col("_i") * ((high - low) / (points - 1))
    position = (y - F.col("_start")) / F.col("_step")
    below = F.floor(position)

    def kernel(at: Column) -> Column:
        return F.exp(-F.pow((at - F.col("node")) * F.col("_step") / F.col("bw"), F.lit(2.0)) / 2)

    part = position - below
    height = (1 - part) * kernel(below) + part * kernel(below + 1)
    return spread.groupBy(group, "_i", "n", "bw").agg(F.sum(F.col("weight") * height).alias("_sum")).select(
        group,
        F.col("_i").alias("point"),
        y.alias("y"),
        (F.col("_sum") / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))).alias("density"),
    )
