"""Both eyes in one pass, side by side, and how they differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxis.config import DisparityConfig, FillConfig, SplatConfig
from parallaxis.functions.numeric import clamp, to_byte
from parallaxis.operators.depth import disparity
from parallaxis.operators.fill import fill_holes
from parallaxis.operators.splat import forward_splat
from parallaxis.sources.frames import dealt

EYES = {0: "shift_left", 1: "shift_right"}


def render(px: DataFrame, keys: list[str], colors: list[str], d: DisparityConfig, s: SplatConfig, f: FillConfig, partitions: int | None = None) -> DataFrame:
    """Pixels of both eyes (``eye`` 0 left, 1 right), splatted and filled; ``partitions`` as in :func:`forward_splat`."""
    moved = disparity(px, keys, d)
    if d.strength == 0:
        still = moved.withColumn("eye", F.explode(F.array(F.lit(0), F.lit(1))))
        return still.withColumn("covered", F.lit(True)).withColumn("filled", F.lit(False)).withColumn("unfilled", F.lit(False)).withColumn("depth", F.col("z"))
    eyes = moved.withColumn("eye", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("shift", F.when(F.col("eye") == 0, F.col("shift_left")).otherwise(F.col("shift_right")))
    return fill_holes(forward_splat(eyes, [*keys, "eye"], "shift", colors, s, partitions), [*keys, "eye"], colors, f)


def side_by_side(eyes: DataFrame, keys: list[str], colors: list[str]) -> DataFrame:
    """The right eye stands behind the left: ``x`` runs over twice the width; colours as bytes."""
    at = (F.col("x") + F.col("eye") * F.col("width")).cast("int")
    return eyes.select(*keys, "y", at.alias("x"), *[to_byte(clamp(F.coalesce(F.col(c), F.lit(0.0)), 0, 1)).alias(c) for c in colors])


def eye_difference(sbs: DataFrame, keys: list[str], color: str, width: int, partitions: int | None = None) -> DataFrame:
    """Mean and largest difference of the halves, the share over 1, and whether that makes stereo.

    The halves meet in one aggregate over ``(y, x mod width)`` rather than a self-join.
    """
    pair = (sbs if partitions is None else dealt(sbs, [*keys, "y"], partitions)).groupBy(*keys, "y", (F.col("x") % width).alias("xm")).agg(
        F.max(F.when(F.col("x") < width, F.col(color))).alias("l"), F.max(F.when(F.col("x") >= width, F.col(color))).alias("r")
    )
    diff = F.abs(F.col("l") - F.col("r"))
    out = pair.groupBy(*keys).agg(F.avg(diff).alias("mean_diff"), F.max(diff).alias("max_diff"), F.avg((diff > 1).cast("double")).alias("share"))
    return out.withColumn("is_stereo", F.col("share") > 0.01)
