"""Values carried from frame to frame: smoothed bounds, scale alignment, fallback, jitter, and
the motion-compensated stabiliser.

The stabiliser's mask depends on its own last output, so it is a true recursion: frames of a
shot are folded in order, and shots, between which nothing is carried, run apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallaxis.config import TemporalConfig

#: The least span of smoothed bounds; where it binds it is written back into the state.
LEAST_SPAN = 1e-6


def ema_bounds(bounds: DataFrame, video: str, cfg: TemporalConfig) -> DataFrame:
    """Smoothed ``low, high`` of each frame from ``q_low, q_high``, and the span's floor kept in the state.

    The floor makes this a recursion, so a video's frames are folded in order; rows arrive in
    Arrow batches and the state is two numbers, however long the video.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, low, high = None, 0.0, 0.0
        for rows in batches:
            lows, highs = [], []
            for v, a, b in zip(rows[video], rows["q_low"], rows["q_high"], strict=True):
                if v != held:
                    held, low, high = v, a, b
                else:
                    low, high = (1 - cfg.eta) * low + cfg.eta * a, (1 - cfg.eta) * high + cfg.eta * b
                if high - low < LEAST_SPAN:
                    high = low + LEAST_SPAN
                lows.append(low)
                highs.append(high)
            yield rows[[video, "frame"]].assign(low=lows, high=highs)

    kinds = dict(bounds.dtypes)
    rows = bounds.select(video, "frame", F.col("q_low").cast("double"), F.col("q_high").cast("double"))
    return rows.repartition(video).sortWithinPartitions(video, "frame").mapInPandas(fold, f"{video} {kinds[video]}, frame {kinds['frame']}, low double, high double")


def scale_alignment(pairs: DataFrame, keys: list[str], cfg: TemporalConfig, lower_median: bool = False) -> DataFrame:
    """``scale`` between the inverse depths ``inv`` and ``inv_before`` of shared pixels.

    The median ratio, limited to ``1 +- max_scale``; 1 with fewer than ``min_shared`` pixels
    or where the inverse depth hardly varies.
    """
    ratio = F.col("inv") / F.greatest(F.col("inv_before"), F.lit(1e-6))
    median = F.percentile_approx(ratio, 0.5, 1_000_000) if lower_median else F.percentile(ratio, F.lit(0.5))
    rows = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("shared"), (F.percentile("inv", F.lit(0.75)) - F.percentile("inv", F.lit(0.25))).alias("iqr"), median.alias("ratio"))
    limited = F.greatest(F.lit(1 - cfg.max_scale), F.least(F.lit(1 + cfg.max_scale), F.col("ratio")))
    return rows.withColumn("scale", F.when((F.col("shared") >= cfg.min_shared) & (F.col("iqr") > 1e-4), limited).otherwise(F.lit(1.0)))


def valid_share(pairs: DataFrame, keys: list[str], cfg: TemporalConfig) -> DataFrame:
    """``valid_fraction``: the share of pixels of ``luma, z`` that hold against ``luma_before, z_before``."""
    holds = (F.abs(F.col("luma") - F.col("luma_before")) <= cfg.photometric) & (F.abs(F.col("z") - F.col("z_before")) / F.greatest(F.col("z"), F.lit(1e-6)) <= cfg.depth_difference)
    return pairs.groupBy(*keys).agg(F.avg(holds.cast("double")).alias("valid_fraction"))


def last_good(frames: DataFrame, video: str, good, value: str, default) -> DataFrame:
    """``out``: the value of good frames; else that of the last good one, else ``default``."""
    held = F.last(F.when(good, F.col(value)), ignorenulls=True).over(W.partitionBy(video).orderBy("frame"))
    return frames.withColumn("out", F.coalesce(held, F.lit(default)))


def jitter(px: DataFrame, video: str, dx: str, dy: str | None = None, is_cut: str | None = None) -> DataFrame:
    """RMSE and MAE of inverse depth against the frame before, moved by the known motion of each frame.

    Motion may be fractional: what was at ``(x + dx, y + dy)`` is read between its neighbours, and
    pixels whose past lies outside are not counted.  Frames with ``is_cut`` have no past and are left out.
    """
    keys = [video, "frame"]
    size = px.groupBy(video).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    to_y, to_x = (F.col("y") + F.col(dy) if dy else F.col("y")).cast("double"), (F.col("x") + F.col(dx)).cast("double")
    rows = px.where(~F.col(is_cut)) if is_cut else px
    rows = rows.join(size, video).select(*keys, (1.0 / F.col("z")).alias("inv"), F.col("y").alias("_y"), F.col("x").alias("_x"), to_y.alias("_ty"), to_x.alias("_tx"), "_h", "_w")
    rows = rows.where((F.col("_ty") >= 0) & (F.col("_ty") <= F.col("_h") - 1) & (F.col("_tx") >= 0) & (F.col("_tx") <= F.col("_w") - 1))
    sides = lambda at: F.filter(F.array(F.struct(F.floor(at).cast("int").alias("at"), (1.0 - (at - F.floor(at))).alias("w")), F.struct((F.floor(at) + 1).cast("int").alias("at"), (at - F.floor(at)).alias("w"))), lambda s: s["w"] > 0)
    asks = rows.withColumn("_v", F.explode(sides(F.col("_ty")))).withColumn("_p", F.explode(sides(F.col("_tx"))))
    asks = asks.select(*keys, "inv", "_y", "_x", (F.col("frame") - 1).alias("_f"), F.col("_v.at").alias("y"), F.col("_p.at").alias("x"), (F.col("_v.w") * F.col("_p.w")).alias("_weight"))
    before = px.select(video, F.col("frame").alias("_f"), "y", "x", (1.0 / F.col("z")).alias("_before"))
    was = asks.join(before, [video, "_f", "y", "x"]).groupBy(*keys, "_y", "_x", "inv").agg(F.sum(F.col("_weight") * F.col("_before")).alias("_was"))
    err = F.abs(F.col("inv") - F.col("_was"))
    return was.groupBy(*keys).agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(err).alias("mae"))


# -- dense kernels on packed frames -------------------------------------------------------


def box_mean(a: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square with zeros outside, which count in the divisor."""
    r = size // 2
    p = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(r, r), (r, r)])
    s = p.cumsum(-1).cumsum(-2)
    s = np.pad(s, [(0, 0)] * (a.ndim - 2) + [(1, 0), (1, 0)])
    return (s[..., size:, size:] - s[..., :-size, size:] - s[..., size:, :-size] + s[..., :-size, :-size]) / size**2


def sample(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear samples, borders repeated."""
    h, w = a.shape
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = y - y0, x - x0
    return (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy


def warp(a: np.ndarray, flow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a`` sampled along ``flow`` (dx, dy), and where that stays inside."""
    h, w = a.shape
    y, x = np.mgrid[0:h, 0:w].astype(float)
    x, y = x + flow[0], y + flow[1]
    return sample(a, y, x), (x >= 0) & (x <= w - 1) & (y >= 0) & (y <= h - 1)


def resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear at pixel centres."""
    y = (np.arange(h) + 0.5) * a.shape[0] / h - 0.5
    x = (np.arange(w) + 0.5) * a.shape[1] / w - 0.5
    return sample(a, *np.meshgrid(y, x, indexing="ij"))


def shrunk(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means of the source pixels that each target pixel touches."""

    def along(a, size):
        n = a.shape[0]
        if n == size:
            return a
        k = np.arange(size)
        low, high = k * n // size, -(-(k + 1) * n // size)
        total = np.concatenate([np.zeros((1, *a.shape[1:])), a.cumsum(0)])
        return (total[high] - total[low]) / (high - low).reshape(-1, *[1] * (a.ndim - 1))

    return along(along(a, h).T, w).T


def search(source: np.ndarray, target: np.ndarray, radius: int, patch: int, temperature: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The shift within ``radius`` of least mean difference over a patch; the first of equals.

    Candidates come one after another, with the best so far kept, so memory is a few images; those
    of a small image (up to 4096 pixels) come all at once.  With ``temperature`` shifts are averaged by weights that fall with their difference.
    """
    h, w = source.shape
    padded = np.pad(target, radius, mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(padded, (h, w)).reshape(-1, h, w) if h * w <= 1 << 12 else None
    shifts = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]
    cost = lambda dy, dx: box_mean(np.abs(padded[radius + dy : radius + dy + h, radius + dx : radius + dx + w] - source), patch)
    if windows is not None:  # a small image: all at once
        best = box_mean(np.abs(windows - source), patch)
        k, least = best.argmin(axis=0), best.min(axis=0)
        best_x, best_y = (k % (2 * radius + 1) - radius).astype(float), (k // (2 * radius + 1) - radius).astype(float)
    else:
        least, best_x, best_y = np.full((h, w), np.inf), np.zeros((h, w)), np.zeros((h, w))
        for dy, dx in shifts:
            c = cost(dy, dx)
            better = c < least
            least[better], best_x[better], best_y[better] = c[better], dx, dy
    if temperature is None:
        return best_x, best_y
    total, mean_x, mean_y = np.zeros((h, w)), np.zeros((h, w)), np.zeros((h, w))
    for dy, dx in shifts:
        weight = np.exp((least - cost(dy, dx)) / max(1e-4, temperature))
        total, mean_x, mean_y = total + weight, mean_x + weight * dx, mean_y + weight * dy
    return mean_x / total, mean_y / total


def block_flow(source: np.ndarray, target: np.ndarray, cfg: TemporalConfig) -> np.ndarray:
    """Displacements (dx, dy) with ``target(x + dx, y + dy)`` like ``source(x, y)``, in two scales."""
    h, w = source.shape
    half = lambda a: a[: h // 2 * 2, : w // 2 * 2].reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3))
    coarse = [resize(2.0 * s, h, w) for s in search(half(source), half(target), cfg.radius_coarse, cfg.patch)]
    moved, _ = warp(target, np.stack(coarse))
    fine = search(source, moved, cfg.radius_fine, cfg.patch, cfg.temperature if cfg.subpixel else None)
    return np.stack([c + f for c, f in zip(coarse, fine, strict=True)])


def estimator_size(h: int, w: int, cfg: TemporalConfig) -> tuple[int, int]:
    """The even size at which motion is estimated: small frames as they are, others scaled and capped."""
    even = lambda n: max(2, n - n % 2)
    if max(h, w) <= cfg.max_estimator < 1 << 30:
        return even(h), even(w)
    return tuple(even(max(cfg.min_estimator, min(cfg.max_estimator, int(n * cfg.flow_scale)))) for n in (h, w))


def both_flows(gray: np.ndarray, before: np.ndarray, cfg: TemporalConfig) -> tuple[np.ndarray, np.ndarray]:
    """The flow of ``gray`` to the frame before and back, estimated on small copies and brought to full size and scale."""
    h, w = gray.shape
    low_h, low_w = estimator_size(h, w, cfg)
    now, was = shrunk(gray, low_h, low_w), shrunk(before, low_h, low_w)
    full = lambda flow: np.stack([resize(f * s, h, w) for f, s in zip(flow, (w / low_w, h / low_h), strict=True)])
    return full(block_flow(now, was, cfg)), full(block_flow(was, now, cfg))


def depth_edges(z: np.ndarray, limit: float, smooth: bool = True) -> np.ndarray:
    """Where the Sobel gradient, relative to depth, is over ``limit``; zeros outside if smoothed, else mirrored."""
    d = box_mean(z, 3) if smooth else z
    p = np.pad(d, 1) if smooth or min(z.shape) < 2 else np.pad(d, 1, mode="reflect")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return np.hypot(gx, gy) / np.maximum(d, 1e-6) > limit


class Stabilizer:
    """Depth held steady along motion, with the state of one frame."""

    def __init__(self, cfg: TemporalConfig):
        self.cfg = cfg
        self.reset()

    def reset(self) -> None:
        self.gray = self.depth = self.low = self.high = None
        self.index = 0

    def step(self, luma: np.ndarray, z: np.ndarray, is_cut: bool = False, box: tuple[int, int, int, int] | None = None) -> dict:
        """The next frame; ``box`` (y and x, ends exclusive) is the part whose depths make the bounds."""
        c = self.cfg
        gray = luma / 255.0
        if self.gray is not None and self.gray.shape != gray.shape:
            is_cut = True
        elif c.find_cuts and self.gray is not None and np.abs(gray - self.gray).mean() >= c.cut_threshold:
            is_cut = True
        if is_cut or (c.find_cuts and luma.mean() < c.fade_threshold):
            self.reset()
        part = z if box is None else z[box[0] : box[1], box[2] : box[3]]
        low, high = np.quantile(1.0 / part, [c.percentile_min / 100, c.percentile_max / 100])
        self.low = low if self.low is None else (1 - c.eta) * self.low + c.eta * low
        self.high = high if self.high is None else (1 - c.eta) * self.high + c.eta * high
        self.high = max(self.high, self.low + LEAST_SPAN) if self.high - self.low < LEAST_SPAN else self.high
        first = self.gray is None or not c.enabled
        out, confidence, share, scale = (z, np.ones(z.shape), 0.0 if c.enabled else 1.0, 1.0) if first else self.blend(gray, z)
        state = {"depth": out, "confidence": confidence, "valid_fraction": share, "scale": scale, "low": float(self.low), "high": float(self.high), "is_cut": self.index == 0, "in_shot": self.index}
        self.gray, self.depth = gray, out
        self.index += 1
        return state

    def blend(self, gray: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Depth, confidence of each pixel's past, share of valid pixels, and the scale of the past."""
        c = self.cfg
        back, ahead = both_flows(gray, self.gray, c)
        before, inside = warp(self.depth, back)
        seen, _ = warp(self.gray, back)
        miss = np.hypot(*(back + np.stack([warp(f, back)[0] for f in ahead])))
        photo = np.abs(gray - seen) * 255.0
        valid = inside & (miss <= c.consistency) & (photo <= c.photometric) & (np.abs(z - before) / np.maximum(z, 1e-6) <= c.depth_difference)
        edge = depth_edges(z, c.edge, c.smooth_edges)
        scale, use = 1.0, valid & ~edge
        if c.align_scale and use.sum() >= c.min_shared:
            now = 1.0 / z[use]
            q75, q25 = np.quantile(now, [0.75, 0.25])
            if q75 - q25 > 1e-4:
                ratio = now / np.maximum(1.0 / before[use], 1e-6)
                median = np.partition(ratio, (len(ratio) - 1) // 2)[(len(ratio) - 1) // 2] if c.lower_median else np.median(ratio)
                scale = float(np.clip(median, 1 - c.max_scale, 1 + c.max_scale))
        trust = np.clip(1 - miss / max(c.consistency, 1e-3), 0, 1) * np.clip(1 - photo / max(c.photometric, 1e-3), 0, 1)
        confidence = np.where(edge, 0.0, trust * valid)
        weight = c.alpha * confidence
        return np.maximum(weight * before / scale + (1 - weight) * z, 1e-4), confidence, float(valid.mean()), scale


def packed(px: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each frame: ``h, w`` and ``luma``, ``z`` as arrays in row order."""
    cell = F.struct("y", "x", F.col("luma").cast("double").alias("luma"), F.col("z").cast("double").alias("z"))
    rows = px.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.array_sort(F.collect_list(cell)).alias("c"))
    return rows.select(*keys, "h", "w", F.col("c.luma").alias("luma"), F.col("c.z").alias("z"))


STABLE = "video long, frame int, shot int, in_shot int, low double, high double, valid_fraction double, scale double, confidence array<double>, depth array<double>"


def stabilize(frames: DataFrame, cfg: TemporalConfig) -> DataFrame:
    """Packed ``video, shot, frame, h, w, luma, z`` to stabilised depth.

    State is cleared at a cut, so each shot is a group by itself.  A group's frames come in
    order and in Arrow batches: one frame's state is held, however long the shot.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = Stabilizer(cfg), None
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if (r.video, r.shot) != key:
                    held.reset()
                    key = (r.video, r.shot)
                s = held.step(np.asarray(r.luma).reshape(r.h, r.w), np.asarray(r.z).reshape(r.h, r.w))
                out.append((r.video, r.frame, r.shot, s["in_shot"], s["low"], s["high"], s["valid_fraction"], s["scale"], s["confidence"].ravel(), s["depth"].ravel()))
            yield pd.DataFrame(out, columns=["video", "frame", "shot", "in_shot", "low", "high", "valid_fraction", "scale", "confidence", "depth"])

    ordered = frames.select("video", "shot", "frame", "h", "w", "luma", "z").repartition("video", "shot").sortWithinPartitions("video", "shot", "frame")
    return ordered.mapInPandas(fold, STABLE)
