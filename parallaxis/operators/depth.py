"""Depth to signed disparity, on exploded pixels.

``keys`` name a frame; a frame's scalars come from one aggregate by these keys and are joined
back on them, so both sides share one distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallaxis.config import DisparityConfig
from parallaxis.functions.numeric import clamp


def is_valid_depth(z: Column) -> Column:
    return z.isNotNull() & ~F.isnan(z) & (z > 0) & (z < float("inf"))


def validate_depth(px: DataFrame, keys: list[str], z: str = "z") -> DataFrame:
    """Each frame's rows, bad rows, and whether all are positive and finite."""
    ok = is_valid_depth(F.col(z))
    return px.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("bad"), F.bool_and(ok).alias("valid"))


def rejections(px: DataFrame, keys: list[str], z: str = "z") -> DataFrame:
    """``n, reason`` of each frame: why its depths cannot be used, or null.  A frame is used whole or not at all."""
    finite = F.col(z).isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf"))
    reason = F.when(~F.bool_and(finite), "non-finite").when(~F.bool_and(is_valid_depth(F.col(z))), "non-positive")
    return px.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), reason.alias("reason"))


def inverse_depth(z: str = "z") -> Column:
    """``1 / z``, null where depth is not valid."""
    return F.when(is_valid_depth(F.col(z)), F.lit(1.0) / F.col(z))


def robust_bounds(px: DataFrame, keys: list[str], cfg: DisparityConfig, where: Column | None = None, z: str = "z") -> DataFrame:
    """``q_low, q_high``: exact interpolated percentiles of inverse depth, over ``where`` if given."""
    inverse = inverse_depth(z) if where is None else F.when(where, inverse_depth(z))
    p = F.percentile(inverse, F.array(F.lit(cfg.percentile_min / 100), F.lit(cfg.percentile_max / 100)))
    return px.groupBy(*keys).agg(p.alias("p")).select(*keys, F.col("p")[0].alias("q_low"), F.col("p")[1].alias("q_high"))


def frame_scalars(px: DataFrame, keys: list[str], cfg: DisparityConfig) -> DataFrame:
    """Bounds, width and validity of each frame, in one aggregate; without strength the bounds are the extremes."""
    inverse = inverse_depth()
    facts = [(F.max("x") + 1).cast("double").alias("width"), F.bool_and(is_valid_depth(F.col("z"))).alias("valid")]
    if cfg.bounds is not None:
        low, high = F.lit(cfg.bounds[0]), F.lit(cfg.bounds[1])
        return px.groupBy(*keys).agg(*facts).select(*keys, "width", "valid", low.alias("q_low"), high.alias("q_high"))
    if cfg.strength == 0:
        return px.groupBy(*keys).agg(*facts, F.min(inverse).alias("q_low"), F.max(inverse).alias("q_high"))
    p = F.percentile(inverse, F.array(F.lit(cfg.percentile_min / 100), F.lit(cfg.percentile_max / 100)))
    return px.groupBy(*keys).agg(*facts, p.alias("p")).select(*keys, "width", "valid", F.col("p")[0].alias("q_low"), F.col("p")[1].alias("q_high"))


def disparity(px: DataFrame, keys: list[str], cfg: DisparityConfig) -> DataFrame:
    """Adds ``q``, ``disparity``, ``shift_left`` and ``shift_right`` to every pixel of the frames that are not rejected.

    A frame with any depth that is not positive and finite has no rows here; :func:`rejections`
    says which and why.  Frames that were dealt out by ``keys`` are not moved again.
    """
    bounded = px.join(frame_scalars(px, keys, cfg).where("valid").drop("valid"), keys)
    span = F.col("q_high") - F.col("q_low")
    q = F.when(span <= 1e-7, F.lit(cfg.q_screen)).otherwise(clamp(F.try_divide(inverse_depth() - F.col("q_low"), span), 0, 1))
    out = bounded.withColumn("q", q)
    if cfg.strength == 0:  # nothing moves: known when the plan is built
        d = F.lit(0.0)
    else:
        low = -cfg.max_fraction if cfg.min_fraction is None else cfg.min_fraction
        d = clamp(cfg.strength * F.col("width") * (F.col("q") - cfg.q_screen), F.col("width") * low, F.col("width") * cfg.max_fraction)
    return out.withColumn("disparity", d).withColumn("shift_left", F.col("disparity") / 2).withColumn("shift_right", -F.col("disparity") / 2)


def summary(px: DataFrame, keys: list[str], column: str) -> DataFrame:
    return px.groupBy(*keys).agg(F.min(column).alias("low"), F.max(column).alias("high"), F.avg(column).alias("mean"))
