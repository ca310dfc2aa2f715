"""Sizes of depth maps, padding, area and bilinear resizing, on exploded pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallaxis.functions.numeric import fitted_dimension, padded_dimension, requested_dimension


def depth_geometry(media: DataFrame, factor: float) -> DataFrame:
    """Requested and padded sizes, and the pads on the right and below."""
    out = media.withColumn("req_w", requested_dimension(F.col("width"), F.lit(factor))).withColumn("req_h", requested_dimension(F.col("height"), F.lit(factor)))
    out = out.withColumn("pad_w", padded_dimension(F.col("req_w"))).withColumn("pad_h", padded_dimension(F.col("req_h")))
    return out.withColumn("right", F.col("pad_w") - F.col("req_w")).withColumn("bottom", F.col("pad_h") - F.col("req_h"))


def fitted_size(media: DataFrame) -> DataFrame:
    longest = F.greatest("width", "height")
    return media.withColumn("fit_w", fitted_dimension(F.col("width"), longest)).withColumn("fit_h", fitted_dimension(F.col("height"), longest))


def pad(px: DataFrame, keys: list[str], height: int, width: int, bottom: int, right: int, reflect: bool = True) -> DataFrame:
    """Padding on the right and below: every pixel names the places that show it, by arithmetic; no join."""

    def places(at, size, extra):
        if reflect and size > extra:
            mirror = F.lit(2 * (size - 1)) - at
            more = F.when((mirror >= size) & (mirror < size + extra), F.array(mirror.cast("int")))
        else:
            more = F.when(at == size - 1, F.sequence(F.lit(size), F.lit(size + extra - 1))) if extra else F.lit(None).cast("array<int>")
        return F.concat(F.array(at.cast("int")), F.coalesce(more, F.array().cast("array<int>")))

    out = px.withColumn("_y", F.explode(places(F.col("y"), height, bottom))).withColumn("_x", F.explode(places(F.col("x"), width, right)))
    return out.withColumn("y", F.col("_y")).withColumn("x", F.col("_x")).drop("_y", "_x")


def area_downscale(px: DataFrame, keys: list[str], factor: int, value: str) -> DataFrame:
    """Means over blocks of ``factor`` by ``factor`` pixels."""
    block = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return px.groupBy(*keys, block("y"), block("x")).agg(F.avg(value).alias(value))


def bilinear_resize(px: DataFrame, keys: list[str], height: int, width: int, to_height: int, to_width: int, value: str | tuple[str, ...]) -> DataFrame:
    """Bilinear at pixel centres: every source pixel goes to the targets it weighs in, and sums meet there.

    Their range follows from the scale, so a row grows by about the scale, not by the size.
    """

    def weights(at, size, to):
        centre = lambda t: F.least(F.greatest((t + 0.5) * (size / to) - 0.5, F.lit(0.0)), F.lit(size - 1.0))
        first = F.when(at == 0, 0).otherwise(F.greatest(F.lit(0), F.ceil((at - 0.5) * (to / size) - 0.5).cast("int") - 1))
        last = F.when(at == size - 1, to - 1).otherwise(F.least(F.lit(to - 1), F.floor((at + 1.5) * (to / size) - 0.5).cast("int") + 1))
        every = F.transform(F.sequence(first, last), lambda t: F.struct(t.alias("to"), (1.0 - F.abs(centre(t) - at)).alias("w")))
        return F.filter(every, lambda s: s["w"] > 0)

    out = px.withColumn("_v", F.explode(weights(F.col("y"), height, to_height))).withColumn("_h", F.explode(weights(F.col("x"), width, to_width)))
    return out.groupBy(*keys, F.col("_v.to").alias("y"), F.col("_h.to").alias("x")).agg(*[F.sum(F.col(v) * F.col("_v.w") * F.col("_h.w")).alias(v) for v in ((value,) if isinstance(value, str) else value)])


def area_sums(px: DataFrame, keys: list[str], to_height: int, to_width: int, channels: tuple[str, ...], same: tuple[str, ...] = ()) -> DataFrame:
    """Weighted sums of the source below each target pixel, for any ratio, and ``_area``, their weight; ``same``: columns alike in a frame, kept.

    ``px`` has ``ymin, ymax, xmin, xmax``, the part of each frame that is resized.  Overlaps are whole
    numbers of 1 / (source size * target size), so sums are exact.
    """

    def overlaps(at, size, to):
        first, last = F.floor(at * to / size).cast("int"), F.floor(((at + 1) * to - 1) / size).cast("int")
        part = lambda t: (F.least((at + 1) * to, (t + 1) * size) - F.greatest(at * to, t * size)).cast("long")
        return F.transform(F.sequence(first, last), lambda t: F.struct(t.alias("to"), part(t).alias("part")))

    tall, wide = F.col("ymax") - F.col("ymin"), F.col("xmax") - F.col("xmin")
    out = px.withColumn("_v", F.explode(overlaps(F.col("y") - F.col("ymin"), tall, to_height))).withColumn("_h", F.explode(overlaps(F.col("x") - F.col("xmin"), wide, to_width)))
    sums = [F.sum(F.col(c) * F.col("_v.part") * F.col("_h.part")).alias(c) for c in channels]
    area = F.max(tall.cast("long") * wide).alias("_area")
    return out.groupBy(*keys, F.col("_v.to").alias("y"), F.col("_h.to").alias("x")).agg(*sums, area, *[F.max(c).alias(c) for c in same])


def area_resize(px: DataFrame, keys: list[str], to_height: int, to_width: int, channels: tuple[str, ...]) -> DataFrame:
    """Means of the source's area below each target pixel (:func:`area_sums`), rounded half to even."""
    return area_sums(px, keys, to_height, to_width, channels).withColumns({c: F.rint(F.col(c) / F.col("_area")).cast("int") for c in channels}).drop("_area")


def preprocess(px: DataFrame, keys: list[str], height: int, width: int, factor: float, multiple: int = 14, channels: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """What a depth model reads: bytes resized by ``factor``, normalised by channel, and mirrored to a multiple of ``multiple``."""
    to_height, to_width = max(1, int(height * factor + 0.5)), max(1, int(width * factor + 0.5))
    px = px.select(*keys, "y", "x", *[F.col(c).cast("double").alias(c) for c in channels])
    rgb = bilinear_resize(px, keys, height, width, to_height, to_width, channels) if factor != 1 else px
    return pad(normalize(rgb, channels), keys, to_height, to_width, -to_height % multiple, -to_width % multiple)


def depth_edges(px: DataFrame, keys: list[str], height: int, width: int, limit: float, smooth: bool = True) -> DataFrame:
    """``gradient`` relative to depth, and ``edge`` where it is over ``limit``; smoothed over 3 by 3 first or not.

    Outside are zeros if it is smoothed; else the border's neighbours are mirrored.

    Each row of pixels becomes one array, and rows meet their neighbours by lags over one order
    of the frame's rows, so a pixel is shuffled once.
    """
    order = W.partitionBy(*keys).orderBy("y")
    nothing = F.array_repeat(F.lit(0.0), width)
    mirrored = lambda x: F.when(x < 0, min(1, width - 1)).when(x >= width, max(0, width - 2)).otherwise(x)
    at = lambda row, x: F.coalesce(F.get(row, x), F.lit(0.0)) if smooth else F.get(row, mirrored(x))

    def over(rows, across):
        """For each row the arrays ``across(above, here, below, x)`` of it and its neighbours."""
        up, down = F.lag("z").over(order), F.lead("z").over(order)
        near = rows.withColumns({"_up": F.coalesce(up, nothing if smooth else F.coalesce(down, F.col("z"))), "_down": F.coalesce(down, nothing if smooth else F.coalesce(up, F.col("z")))})
        return near, lambda: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: across(F.col("_up"), F.col("z"), F.col("_down"), x))

    rows = px.groupBy(*keys, "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", F.col("z").cast("double").alias("z")))), lambda p: p["z"]).alias("z"))
    if smooth:
        rows, mean = over(rows, lambda up, here, down, x: sum(at(row, x + dx) for row in (up, here, down) for dx in (-1, 0, 1)) / 9)
        rows = rows.select(*keys, "y", mean().alias("z"))
    column = lambda up, here, down, x: at(up, x) + 2 * at(here, x) + at(down, x)
    line = lambda row, x: at(row, x - 1) + 2 * at(row, x) + at(row, x + 1)
    rows, found = over(rows, lambda up, here, down, x: F.struct((column(up, here, down, x + 1) - column(up, here, down, x - 1)).alias("gx"), (line(down, x) - line(up, x)).alias("gy"), at(here, x).alias("here")))
    out = rows.select(*keys, "y", F.posexplode(found()).alias("x", "_g")).select(*keys, "y", "x", "_g.*")
    out = out.withColumn("gradient", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) / F.greatest(F.col("here"), F.lit(1e-6)))
    return out.withColumn("edge", F.col("gradient") > limit)


# The channel means and deviations that image models are trained with.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def normalize(px: DataFrame, channels: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    return px.withColumns({c: (F.col(c) / 255.0 - m) / s for c, m, s in zip(channels, MEAN, DEVIATION, strict=True)})


def stretch(px: DataFrame, keys: list[str], value: str, levels: int) -> DataFrame:
    """Minimum to maximum of a frame as 0 to ``levels``, truncated; flat frames are 0."""
    ends = px.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    share = F.try_divide(F.col(value) - F.col("_low"), F.col("_high") - F.col("_low"))
    return px.join(ends, keys).withColumn("level", F.coalesce(F.floor(share * float(levels)), F.lit(0)).cast("int")).drop("_low", "_high")


def colored(px: DataFrame, level: str, levels: int, anchors: tuple[tuple[int, int, int], ...]) -> DataFrame:
    """``r, g, b`` of levels from 0 to ``levels``: along a line through the anchors, rounded half to even."""
    at = F.col(level) / float(levels) * (len(anchors) - 1)
    low = F.floor(at).cast("int")
    high = F.least(low + 1, F.lit(len(anchors) - 1))

    def channel(c):
        values = F.array(*[F.lit(float(a[c])) for a in anchors])
        return F.rint(F.get(values, low) + (F.get(values, high) - F.get(values, low)) * (at - low)).cast("int")

    return px.withColumns({name: channel(c) for c, name in enumerate("rgb")})
