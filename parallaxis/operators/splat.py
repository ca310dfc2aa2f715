"""Forward splatting with a z-buffer, in one shuffle.

Landings are dealt out by image row.  The z-buffer is a window over a target pixel, the sums
an aggregate over the same pixel, and the row-wise windows of hole filling come next: all of
them are satisfied by the one distribution on (frame, row).  ``partitions`` fixes into how many
tasks the landings are dealt, so that a task's memory need not grow with the table; without it
Spark joins small partitions to larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallaxis.config import SplatConfig
from parallaxis.sources.frames import dealt


def _landings(shift: str) -> list[Column]:
    to = F.col("x") + F.col(shift)
    base, part = F.floor(to).cast("int"), to - F.floor(to)
    return [F.struct(base.alias("xt"), (1.0 - part).alias("w")), F.struct((base + 1).alias("xt"), part.alias("w"))]


def _landed(px: DataFrame, places: list[Column], cfg: SplatConfig) -> DataFrame:
    out = px.withColumn("land", F.explode(F.array(*places))).withColumn("xt", F.col("land.xt")).withColumn("w", F.col("land.w")).drop("land")
    return out.where((F.col("xt") >= 0) & (F.col("xt") < F.col("width")) & (F.col("w").isNull() | (F.col("w") > cfg.least_weight)))


def contributions(px: DataFrame, keys: list[str], shift: str, cfg: SplatConfig) -> DataFrame:
    """Each pixel's two landings ``xt`` with weights; those outside or of no weight are left out."""
    return _landed(px, _landings(shift), cfg)


def z_buffer(landed: DataFrame, keys: list[str]) -> DataFrame:
    return landed.groupBy(*keys, "y", "xt").agg(F.min("z").alias("z_near"))


def _sums(landed: DataFrame, keys: list[str], colors: list[str], cfg: SplatConfig, partitions: int | None) -> DataFrame:
    """Weight, depth and colours of each target pixel from what survives the z-buffer (null where nothing covers it)."""
    target = [*keys, "y", "xt"]
    near = F.min(F.when(F.col("w").isNotNull(), F.col("z"))).over(W.partitionBy(*target))
    ok = F.col("w").isNotNull() & (F.col("z") <= F.col("_near") * (1 + cfg.relative_tolerance) + cfg.absolute_tolerance)
    used = F.when(ok, F.col("w"))
    sums = (
        dealt(landed, [*keys, "y"], partitions)
        .withColumn("_near", near)
        .groupBy(*target)
        .agg(F.max("width").alias("width"), F.sum(used).alias("_w"), F.sum(used * F.col("z")).alias("_z"), *[F.sum(used * F.col(c)).alias(f"_{c}") for c in colors])
    )
    weight = F.when(F.col("_w") > cfg.least_weight, F.col("_w"))
    return sums.select(*target, "width", weight.alias("weight"), (F.col("_z") / weight).alias("depth"), *[(F.col(f"_{c}") / weight).alias(c) for c in colors])


def blend(landed: DataFrame, keys: list[str], colors: list[str], cfg: SplatConfig, partitions: int | None = None) -> DataFrame:
    """Covered target pixels only: ``weight``, ``depth`` and the colours."""
    return _sums(landed, keys, colors, cfg, partitions).where(F.col("weight").isNotNull()).drop("width")


def forward_splat(px: DataFrame, keys: list[str], shift: str, colors: list[str], cfg: SplatConfig, partitions: int | None = None) -> DataFrame:
    """Every target pixel: ``covered``, and depth and colours where it is (null in holes).

    Each pixel also lands on its own place without weight, so holes are rows of the same
    aggregate and no join with the grid is needed.
    """
    here = F.struct(F.col("x").alias("xt"), F.lit(None).cast("double").alias("w"))
    drawn = _sums(_landed(px, [*_landings(shift), here], cfg), keys, colors, cfg, partitions)
    return drawn.withColumnRenamed("xt", "x").withColumn("covered", F.col("weight").isNotNull())
