"""Disparity from luma, edges and height, and backward warps of luma and chroma."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallaxis.config import HeuristicConfig
from parallaxis.functions.numeric import clamp


def split_planes(raw: DataFrame, keys: list[str], height: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Luma rows, chroma rows, and apart from them the keys of frames of another shape, with their ``rows`` and ``columns``.

    A planar frame has ``1.5 * height`` rows of ``width`` values, luma first; both sides are even.
    """
    if height % 2 or width % 2:
        raise ValueError("frames with chroma at half size need an even width and height")
    sizes = raw.groupBy(*keys).agg((F.max("y") + 1).alias("rows"), (F.max("x") + 1).alias("columns"), F.count(F.lit(1)).alias("n"))
    right = (F.col("rows") == height * 3 // 2) & (F.col("columns") == width) & (F.col("n") == height * 3 // 2 * width)
    good = raw.join(sizes.where(right).select(*keys), keys, "left_semi")
    return good.where(F.col("y") < height), good.where(F.col("y") >= height).withColumn("y", F.col("y") - height), sizes.where(~right).select(*keys, "rows", "columns")


def pixels_moved(luma, gx, gy, y, height: int, cfg: HeuristicConfig):
    """Disparity in whole pixels from a pixel's luma, its differences to the left and above, and its row."""
    wl, we, wv = cfg.weights
    edge = clamp((F.abs(gx) + F.abs(gy)) / 510.0, 0, 1)
    score = clamp(cfg.strength * (wl * luma / 255.0 + we * edge + wv * (y / max(1.0, height - 1.0))), 0, 1) * float(cfg.max_pixels)
    whole = F.floor(score + 0.5) if cfg.half_up else F.rint(score)
    return F.least(F.greatest(whole.cast("int"), F.lit(0)), F.lit(cfg.max_pixels))


def heuristic_disparity(px: DataFrame, keys: list[str], height: int, cfg: HeuristicConfig) -> DataFrame:
    """Adds ``d``, in whole pixels from 0 to ``max_pixels``."""
    gx = F.col("luma") - F.lag("luma", 1).over(W.partitionBy(*keys, "y").orderBy("x"))
    gy = F.col("luma") - F.lag("luma", 1).over(W.partitionBy(*keys, "x").orderBy("y"))
    graded = px.withColumn("gx", F.coalesce(gx, F.lit(0))).withColumn("gy", F.coalesce(gy, F.lit(0)))
    return graded.withColumn("d", pixels_moved(F.col("luma"), F.col("gx"), F.col("gy"), F.col("y"), height, cfg)).drop("gx", "gy")


def backward_warp(px: DataFrame, keys: list[str], width: int, value: str = "luma") -> DataFrame:
    """``left[x] = value[max(0, x - d)]``, ``right[x] = value[min(width - 1, x + d)]``: equi-joins."""
    source = px.select(*keys, "y", F.col("x").alias("xs"), F.col(value).alias("v"))
    out = px.withColumn("eye", F.explode(F.array(F.lit(0), F.lit(1))))
    out = out.withColumn("xs", F.when(F.col("eye") == 0, F.greatest(F.lit(0), F.col("x") - F.col("d"))).otherwise(F.least(F.lit(width - 1), F.col("x") + F.col("d"))))
    return out.select(*keys, "y", "x", "eye", "xs").join(source, [*keys, "y", "xs"]).select(*keys, "y", "x", "eye", F.col("v").alias(value))


def warp_chroma(chroma: DataFrame, luma_d: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Chroma at half size, moved by half of the disparity at its even luma pixel."""
    half = luma_d.where((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0)).select(*keys, (F.col("y") / 2).cast("int").alias("y"), (F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("d") / 2).cast("int").alias("d"))
    moved = chroma.join(half, [*keys, "y", "x"])
    return backward_warp(moved, keys, width // 2, "u")


def lines(px: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each row of pixels as one array, ``line``."""
    return px.groupBy(*keys, "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", F.col(value).alias("v")))), lambda p: p["v"]).alias("line"))


def both_eyes(rows: DataFrame, keys: list[str], width: int, value: str) -> DataFrame:
    """Pixels of rows moved by ``d`` to both sides, the right eye's beside the left's; all within a row."""
    at = F.sequence(F.lit(0), F.lit(width - 1))
    left = F.transform(at, lambda x: F.get("line", F.greatest(F.lit(0), x - F.get("d", x))))
    right = F.transform(at, lambda x: F.get("line", F.least(F.lit(width - 1), x + F.get("d", x))))
    return rows.select(*keys, "y", F.posexplode(F.concat(left, right)).alias("x", value))


def side_by_side(luma: DataFrame, chroma: DataFrame, keys: list[str], height: int, width: int, cfg: HeuristicConfig) -> tuple[DataFrame, DataFrame]:
    """Both planes of the stereo frame, the right eye's beside the left's: ``y, x, luma`` and, at half size, ``y, x, u``.

    Rows are arrays: a pixel is shuffled once, the row above comes by a lag over the frame's
    rows, and warps and differences to the left stay within a row.
    """
    if height % 2 or width % 2:
        raise ValueError("frames with chroma at half size need an even width and height")
    above = F.lag("line").over(W.partitionBy(*keys).orderBy("y"))
    v = lambda line, x: F.get(line, x)
    step = lambda x: F.when(x > 0, v("line", x) - v("line", x - 1)).otherwise(0)
    move = lambda x: pixels_moved(v("line", x), step(x), F.coalesce(v("line", x) - v("_above", x), F.lit(0)), F.col("y"), height, cfg)
    rows = lines(luma, keys, "luma").withColumn("_above", above)
    rows = rows.withColumn("d", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), move)).drop("_above")
    half = rows.where(F.col("y") % 2 == 0).select(*keys, (F.col("y") / 2).cast("int").alias("y"), F.transform(F.sequence(F.lit(0), F.lit(width // 2 - 1)), lambda x: F.floor(F.get("d", 2 * x) / 2).cast("int")).alias("d"))
    return both_eyes(rows, keys, width, "luma"), both_eyes(lines(chroma, keys, "u").join(half, [*keys, "y"]), keys, width // 2, "u")


def black_frame(frames: DataFrame, height: int, width: int) -> DataFrame:
    """What stands in for frames without any good one before: luma 0, chroma 128."""
    from parallaxis.sources.frames import spread

    return spread(frames, y=height, x=width).withColumn("luma", F.lit(0)).withColumn("u", F.lit(128)).withColumn("v", F.lit(128))
