"""Motion between frames as relations: block matching, and values moved along a flow.

The same search as :func:`parallaxis.operators.temporal.block_flow`, on exploded pixels.  All
frames of a call have one size.  Candidates are rows, so a frame's work is spread over its
pixels; keys are (frame, y, x) throughout, and no frame meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallaxis.config import TemporalConfig
from parallaxis.operators.geometry import area_downscale, bilinear_resize


def clamped(at: Column, size: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), at))


def search(source: DataFrame, target: DataFrame, keys: list[str], height: int, width: int, radius: int, patch: int, value: str) -> DataFrame:
    """``dx, dy`` for each source pixel: the shift within ``radius`` whose patch differs least; the first of equals.

    Beyond a border the target repeats it; patches have zeros there.
    """
    side, r = 2 * radius + 1, patch // 2
    asks = source.select(*keys, "y", "x", F.col(value).alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("k"))
    down, across = F.floor(F.col("k") / side).cast("int") - radius, F.col("k") % side - radius
    asks = asks.withColumn("_y", clamped(F.col("y") + down, height)).withColumn("_x", clamped(F.col("x") + across, width))
    found = asks.join(target.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), F.col(value).alias("_b")), [*keys, "_y", "_x"])
    line = W.partitionBy(*keys, "k", "y").orderBy("x").rowsBetween(-r, r)
    column = W.partitionBy(*keys, "k", "x").orderBy("y").rowsBetween(-r, r)
    cost = found.select(*keys, "k", "y", "x", F.sum(F.abs(F.col("_a") - F.col("_b"))).over(line).alias("_c")).withColumn("_c", F.sum("_c").over(column))
    best = cost.groupBy(*keys, "y", "x").agg(F.min(F.struct("_c", "k"))["k"].alias("k"))
    return best.select(*keys, "y", "x", across.alias("dx"), down.alias("dy"))


def warp(px: DataFrame, flow: DataFrame, keys: list[str], height: int, width: int, values: tuple[str, ...]) -> DataFrame:
    """``values`` at ``(x + dx, y + dy)`` for each row of ``flow``, and ``inside``: whether that lies in the frame.

    Bilinear, with the border repeated outside.  Each row asks its four neighbours (fewer where
    a weight is 0), which answer by one equi-join and a weighted sum.
    """

    def sides(at, size):
        at = F.greatest(F.lit(0.0), F.least(F.lit(size - 1.0), at))
        low = F.floor(at).cast("int")
        both = F.array(F.struct(low.alias("at"), (1.0 - (at - low)).alias("w")), F.struct((low + 1).alias("at"), (at - low).alias("w")))
        return F.filter(both, lambda s: s["w"] > 0)

    to_y, to_x = F.col("y") + F.col("dy"), F.col("x") + F.col("dx")
    inside = (to_x >= 0) & (to_x <= width - 1) & (to_y >= 0) & (to_y <= height - 1)
    asks = flow.select(*keys, "y", "x", inside.alias("inside"), F.explode(sides(to_y, height)).alias("_v"), to_x.alias("_to"))
    asks = asks.withColumn("_h", F.explode(sides(F.col("_to"), width)))
    asks = asks.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), "inside", F.col("_v.at").alias("y"), F.col("_h.at").alias("x"), (F.col("_v.w") * F.col("_h.w")).alias("_w"))
    sums = [F.sum(F.col("_w") * F.col(v)).alias(v) for v in values]
    return asks.join(px.select(*keys, "y", "x", *values), [*keys, "y", "x"]).groupBy(*keys, F.col("_y").alias("y"), F.col("_x").alias("x")).agg(*sums, F.bool_and("inside").alias("inside"))


def block_flow(source: DataFrame, target: DataFrame, keys: list[str], height: int, width: int, cfg: TemporalConfig, value: str = "luma") -> DataFrame:
    """``dx, dy`` with ``target(x + dx, y + dy)`` like ``source(x, y)``: a search at half size, and one around what it finds."""
    h, w = height // 2, width // 2
    half = lambda px: area_downscale(px.where((F.col("y") < 2 * h) & (F.col("x") < 2 * w)), keys, 2, value)
    coarse = search(half(source), half(target), keys, h, w, cfg.radius_coarse, cfg.patch, value)
    coarse = coarse.select(*keys, "y", "x", (2.0 * F.col("dx")).alias("dx"), (2.0 * F.col("dy")).alias("dy"))
    coarse = bilinear_resize(coarse, keys, h, w, height, width, ("dx", "dy"))
    moved = warp(target, coarse, keys, height, width, (value,))
    fine = search(source, moved, keys, height, width, cfg.radius_fine, cfg.patch, value)
    rest = fine.select(*keys, "y", "x", F.col("dx").alias("_dx"), F.col("dy").alias("_dy"))
    return coarse.join(rest, [*keys, "y", "x"]).select(*keys, "y", "x", (F.col("dx") + F.col("_dx")).alias("dx"), (F.col("dy") + F.col("_dy")).alias("dy"))
