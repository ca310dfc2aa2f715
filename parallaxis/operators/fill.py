"""Holes of a row: their boundaries, widths, spans and filling.  One window order serves all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallaxis.config import FillConfig


def boundaries(px: DataFrame, keys: list[str], colors: list[str]) -> DataFrame:
    """Adds the nearest covered pixel on either side: ``left`` and ``right`` structs (null: none)."""
    row = W.partitionBy(*keys, "y").orderBy("x")
    here = F.when(F.col("covered"), F.struct(F.col("x").alias("x"), F.col("depth").alias("z"), *colors))
    back, ahead = row.rowsBetween(W.unboundedPreceding, 0), row.rowsBetween(0, W.unboundedFollowing)
    return px.withColumn("left", F.last(here, ignorenulls=True).over(back)).withColumn("right", F.first(here, ignorenulls=True).over(ahead))


def hole_widths(bounded: DataFrame, keys: list[str], cfg: FillConfig) -> DataFrame:
    """Adds ``hole_width`` (0 where covered), ``large`` and ``starts_large``."""
    width = F.col("width").cast("int")
    both = F.col("left").isNotNull() & F.col("right").isNotNull()
    span = F.when(both, F.col("right.x") - F.col("left.x") - 1).when(F.col("right").isNotNull(), F.col("right.x")).when(F.col("left").isNotNull(), width - 1 - F.col("left.x")).otherwise(width)
    out = bounded.withColumn("hole_width", F.when(F.col("covered"), 0).otherwise(span)).withColumn("large", F.col("hole_width") > cfg.max_hole_width)
    before = F.lag("large", 1, False).over(W.partitionBy(*keys, "y").orderBy("x"))
    return out.withColumn("starts_large", F.col("large") & ~before)


def fill_holes(px: DataFrame, keys: list[str], colors: list[str], cfg: FillConfig) -> DataFrame:
    """Holes take the farther boundary; boundaries of like depth are interpolated; edges are extended."""
    b = hole_widths(boundaries(px, keys, colors), keys, cfg)
    left, right = F.col("left").isNotNull(), F.col("right").isNotNull()
    zl, zr, tol = F.col("left.z"), F.col("right.z"), 1 + cfg.depth_tolerance
    t = (F.col("x") - F.col("left.x")) / F.greatest(F.col("right.x") - F.col("left.x"), F.lit(1))

    def value(l, r):
        return F.when(left & right, F.when(zl > zr * tol, l).when(zr > zl * tol, r).otherwise((1.0 - t) * l + t * r)).when(left, l).otherwise(r)

    active = ~F.col("covered") & (left | right) & (F.lit(True) if cfg.fill_large else ~F.col("large"))
    out = b.withColumn("filled", active).withColumn("unfilled", ~F.col("covered") & ~active)
    fills = {c: F.when(F.col("filled"), value(F.col(f"left.{c}"), F.col(f"right.{c}"))).otherwise(F.col(c)) for c in colors}
    fills["depth"] = F.when(F.col("filled"), value(zl, zr)).otherwise(F.col("depth"))
    return out.withColumns(fills)


def diagnostics(widths: DataFrame, keys: list[str], cfg: FillConfig) -> DataFrame:
    """Counters of each frame, and a warning where a span is too wide."""
    d = widths.groupBy(*keys).agg(
        F.count_if(~F.col("covered")).alias("holes"),
        F.avg(F.when(F.col("covered"), 0.0).otherwise(1.0)).alias("hole_fraction"),
        F.max("hole_width").alias("max_hole_width"),
        F.count_if("starts_large").alias("large_holes"),
    )
    return d.withColumn("warning", F.when(F.col("large_holes") > 0, F.format_string(f"%d holes wider than {cfg.max_hole_width}, at most %d", "large_holes", "max_hole_width")))
