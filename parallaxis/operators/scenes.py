"""Letterbox, fades, histograms, cuts and shots of videos, on exploded luma.

With ``min_scene_frames = 1`` a frame's decision needs its predecessor only, so cuts are
window expressions over one row for each frame; larger values make the rule depend on its
own past decisions and are folded frame by frame in :mod:`parallaxis.operators.cuts`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallaxis.config import SceneConfig
from parallaxis.functions.numeric import luma
from parallaxis.operators.geometry import area_resize, area_sums


def letterbox(px: DataFrame, keys: list[str], cfg: SceneConfig) -> DataFrame:
    """``h, w`` and the active box ``ymin, ymax, xmin, xmax`` (ends exclusive) of each frame.

    Every pixel counts for its row and its column, so both kinds of means come from one
    aggregate, summed up map-side before the shuffle.  Without ``detect_letterbox`` all is active.
    """
    if not cfg.detect_letterbox:
        whole = px.groupBy(*keys).agg((F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"))
        return whole.select(*keys, "h", "w", F.lit(0).alias("ymin"), F.col("h").alias("ymax"), F.lit(0).alias("xmin"), F.col("w").alias("xmax"))
    line = F.explode(F.array(F.struct(F.lit(0).alias("axis"), F.col("y").cast("int").alias("at")), F.struct(F.lit(1).alias("axis"), F.col("x").cast("int").alias("at"))))
    means = px.withColumn("_l", line).groupBy(*keys, F.col("_l.axis").alias("axis"), F.col("_l.at").alias("at")).agg(F.avg("luma").alias("m"))
    of = lambda axis, lit: F.when((F.col("axis") == axis) & ((F.col("m") >= cfg.letterbox_threshold) if lit else F.lit(True)), F.col("at"))
    both = means.groupBy(*keys).agg(
        (F.max(of(0, False)) + 1).alias("h"), (F.max(of(1, False)) + 1).alias("w"),
        F.min(of(0, True)).alias("y0"), (F.max(of(0, True)) + 1).alias("y1"), F.min(of(1, True)).alias("x0"), (F.max(of(1, True)) + 1).alias("x1"),
    )
    tall = F.coalesce(F.col("y1") - F.col("y0"), F.lit(0)) >= F.floor(F.col("h") * 0.2)
    wide = F.coalesce(F.col("x1") - F.col("x0"), F.lit(0)) >= F.floor(F.col("w") * 0.2)
    crop = F.coalesce(tall & wide & (F.col("h") >= 4) & (F.col("w") >= 4) & F.col("y0").isNotNull() & F.col("x0").isNotNull(), F.lit(False))
    pick = lambda inside, full, name: F.when(crop, F.col(inside)).otherwise(full).alias(name)
    return both.select(*keys, "h", "w", pick("y0", F.lit(0), "ymin"), pick("y1", F.col("h"), "ymax"), pick("x0", F.lit(0), "xmin"), pick("x1", F.col("w"), "xmax"))


def active(px: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    inside = (F.col("y") >= F.col("ymin")) & (F.col("y") < F.col("ymax")) & (F.col("x") >= F.col("xmin")) & (F.col("x") < F.col("xmax"))
    return px.join(boxes, keys).where(inside)


def brightness(cropped: DataFrame, keys: list[str], cfg: SceneConfig, channels: tuple[str, ...] = ("luma",)) -> DataFrame:
    """``mean_luma`` and ``is_fade`` of each frame's active part: the mean over all of its channels."""
    mean = F.avg(sum(F.col(c) for c in channels) / len(channels))
    return cropped.groupBy(*keys).agg(mean.alias("mean_luma")).withColumn("is_fade", F.col("mean_luma") < cfg.fade_threshold)


def thumbnails(cropped: DataFrame, keys: list[str], cfg: SceneConfig, channels: tuple[str, ...] = ("luma",)) -> DataFrame:
    """The active part of each frame, with its box, as a small image: ``y, x``, channels and ``gray``."""
    thumbs = area_resize(cropped, keys, cfg.thumb_height, cfg.thumb_width, channels)
    gray = F.rint(luma(*[F.col(c) for c in channels])).cast("int") if len(channels) == 3 else F.col(channels[0])
    return thumbs.withColumn("gray", gray)


def histograms(thumbs: DataFrame, keys: list[str], cfg: SceneConfig, channels: tuple[str, ...] = ("luma",)) -> DataFrame:
    """``bins``: shares of the equal bins of 0..256, channel after channel, as an array from one aggregate."""
    step = 256 // cfg.bins
    counts = [F.avg(((F.col(c) >= k * step) & (F.col(c) < (k + 1) * step)).cast("double")) for c in channels for k in range(cfg.bins)]
    return thumbs.groupBy(*keys).agg(F.array(*counts).alias("bins"))


def correlation(a: Column, b: Column, n: int) -> Column:
    """Pearson correlation of two arrays; without variance 1."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    covered = dot(a, b) - n * mean(a) * mean(b)
    spread = F.sqrt(F.greatest(F.lit(0.0), dot(a, a) - n * mean(a) * mean(a)) * F.greatest(F.lit(0.0), dot(b, b) - n * mean(b) * mean(b)))
    return F.when(spread > 1e-12, covered / spread).otherwise(1.0)


def summaries(px: DataFrame, keys: list[str], cfg: SceneConfig, channels: tuple[str, ...] = ("luma",)) -> DataFrame:
    """A row for each frame: its size and box, ``mean_luma``, ``is_fade``, ``bins`` and ``gray``, the thumbnail as an array.

    Pixels are read twice, for the box and for the thumbnail; the rest follows from the
    thumbnail's sums, since every active pixel has the same total weight in it.
    """
    box = ("h", "w", "ymin", "ymax", "xmin", "xmax")
    sums = area_sums(active(px, letterbox(px, keys, cfg), keys), keys, cfg.thumb_height, cfg.thumb_width, channels, box)
    levels = sums.withColumns({f"_{c}": F.rint(F.col(c) / F.col("_area")).cast("int") for c in channels})
    gray = F.rint(luma(*[F.col(f"_{c}") for c in channels])).cast("int") if len(channels) == 3 else F.col(f"_{channels[0]}")
    step = 256 // cfg.bins
    bins = [F.count_if(F.floor(F.col(f"_{c}") / step) == k) for c in channels for k in range(cfg.bins)]
    n = cfg.thumb_height * cfg.thumb_width
    rows = levels.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in box],
        (sum(F.sum(c) / (F.max("_area") * n) for c in channels) / len(channels)).alias("mean_luma"),
        F.transform(F.array(*bins), lambda b: b / n).alias("bins"),
        F.transform(F.array_sort(F.collect_list(F.struct("y", "x", gray.alias("g")))), lambda p: p["g"]).alias("gray"),
    )
    return rows.withColumn("is_fade", F.col("mean_luma") < cfg.fade_threshold)


def scene_cuts(px: DataFrame, video: str, cfg: SceneConfig, channels: tuple[str, ...] = ("luma",)) -> DataFrame:
    """``score``, ``is_fade``, ``is_cut`` and the box of each frame.

    Content is compared on thumbnails of the active part.  A change of size is a cut, and so is
    the frame after it, which has nothing to be compared with.
    """
    if cfg.min_scene_frames != 1:
        raise ValueError("cuts with min_scene_frames over 1 are a fold: see operators.cuts")
    rows = summaries(px, [video, "frame"], cfg, channels)
    order = W.partitionBy(video).orderBy("frame")
    prev = lambda c: F.lag(c).over(order)
    rows = rows.withColumns({"p_bins": prev("bins"), "p_fade": prev("is_fade"), "p_gray": prev("gray"), "resized": F.coalesce((prev("h") != F.col("h")) | (prev("w") != F.col("w")), F.lit(False))})
    rows = rows.withColumn("p_resized", prev("resized"))
    distance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1.0 - correlation(F.col("bins"), F.col("p_bins"), cfg.bins * len(channels))) / 2.0))
    apart = F.aggregate(F.zip_with("gray", "p_gray", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, d: s + d)
    content = 0.6 * distance + 0.4 * F.coalesce(apart / F.size("gray") / 255.0, F.lit(0.0))
    forced = F.col("p_bins").isNull() | F.col("resized") | F.col("p_resized") | (F.col("is_fade") != F.col("p_fade"))
    score = F.when(forced, 1.0).when(F.col("is_fade"), 0.0).otherwise(content)
    rows = rows.withColumn("score", score)
    cut = F.when(forced, True).when(F.col("is_fade"), False).otherwise(F.col("score") >= cfg.cut_threshold)
    return rows.withColumn("is_cut", cut).drop("p_bins", "p_fade", "p_gray", "resized", "p_resized", "bins", "gray")


def shots(cuts: DataFrame, video: str) -> DataFrame:
    """Adds ``shot`` (from 1) and ``in_shot``, the frame's place in it."""
    order = W.partitionBy(video).orderBy("frame")
    out = cuts.withColumn("shot", F.sum(F.col("is_cut").cast("int")).over(order))
    return out.withColumn("in_shot", F.row_number().over(W.partitionBy(video, "shot").orderBy("frame")) - 1)
