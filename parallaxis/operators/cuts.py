"""The cut detector as a fold over packed frames, with the state of one small image.

Same rules as :mod:`parallaxis.operators.scenes`, and ``min_scene_frames`` besides, which makes
each decision depend on the last.  A frame's pixels are read once; letterbox, thumbnail,
histogram and brightness come from them together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parallaxis.config import SceneConfig

WEIGHTS = np.array([0.299, 0.587, 0.114])


def active_box(px: np.ndarray, threshold: float) -> tuple[int, int, int, int]:
    """``ymin, ymax, xmin, xmax`` of the part inside dark bars; the whole frame if that is too small."""
    h, w = px.shape[:2]
    lit_y, lit_x = (np.flatnonzero(px.mean(axis=axes) >= threshold) for axes in ((1, 2), (0, 2)))
    if h < 4 or w < 4 or not len(lit_y) or not len(lit_x):
        return 0, h, 0, w
    y0, y1, x0, x1 = lit_y[0], lit_y[-1] + 1, lit_x[0], lit_x[-1] + 1
    return (int(y0), int(y1), int(x0), int(x1)) if y1 - y0 >= int(h * 0.2) and x1 - x0 >= int(w * 0.2) else (0, h, 0, w)


def thumbnail(px: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of the areas below each target pixel, in whole numbers until the division, rounded half to even."""

    def overlaps(size, to):
        at, target = np.arange(size), np.arange(to)[:, None]
        return np.maximum(0, np.minimum((at + 1) * to, (target + 1) * size) - np.maximum(at * to, target * size))

    sums = np.einsum("ty,yxc,sx->tsc", overlaps(px.shape[0], height), px.astype(np.int64), overlaps(px.shape[1], width), optimize=True)
    return np.rint(sums / (px.shape[0] * px.shape[1])).astype(np.int64)


@dataclass
class Seen:
    """What is kept of the past: the last frame's size, bins, gray thumbnail and fade, and the place of the last cut."""

    h: int = 0
    w: int = 0
    bins: np.ndarray | None = None
    gray: np.ndarray | None = None
    fade: bool = False
    last_cut: int = 0
    index: int = 0


class CutDetector:
    def __init__(self, cfg: SceneConfig, seen: Seen | None = None):
        self.cfg, self.seen = cfg, seen or Seen()

    def step(self, px: np.ndarray) -> dict:
        """The decision on the next frame, ``(h, w, channels)`` of bytes."""
        c, s, (h, w) = self.cfg, self.seen, px.shape[:2]
        index, s.index = s.index, s.index + 1
        if s.index > 1 and (s.h, s.w) != (h, w):  # nothing to compare with, here and at the next frame
            self.seen = Seen(h=h, w=w, index=index + 1)
            return {"is_cut": True, "score": 1.0, "is_fade": False, "box": (0, h, 0, w)}
        box = active_box(px, c.letterbox_threshold) if c.detect_letterbox else (0, h, 0, w)
        part = px[box[0] : box[1], box[2] : box[3]]
        fade = bool(part.mean() < c.fade_threshold)
        thumb = thumbnail(part, c.thumb_height, c.thumb_width)
        gray = np.rint(thumb @ WEIGHTS) if px.shape[2] == 3 else thumb[:, :, 0]
        bins = np.concatenate([np.bincount(thumb[:, :, k].ravel() // (256 // c.bins), minlength=c.bins)[: c.bins] for k in range(px.shape[2])]) / gray.size
        if s.bins is None or fade != s.fade:
            score, cut = 1.0, True
        elif fade:
            score, cut = 0.0, False
        else:
            a, b, n = bins, s.bins, len(bins)
            spread = np.sqrt(max(0.0, a @ a - n * a.mean() ** 2) * max(0.0, b @ b - n * b.mean() ** 2))
            distance = (1 - (a @ b - n * a.mean() * b.mean()) / spread) / 2 if spread > 1e-12 else 0.0
            score = float(0.6 * min(1.0, max(0.0, distance)) + 0.4 * np.abs(gray - s.gray).mean() / 255)
            cut = score >= c.cut_threshold and index - s.last_cut >= c.min_scene_frames
        self.seen = Seen(h, w, bins, gray, fade, index if cut else s.last_cut, index + 1)
        return {"is_cut": bool(cut), "score": score, "is_fade": fade, "box": box}


def image(raw, h: int, w: int) -> np.ndarray:
    """Packed values, bytes or numbers, as ``(h, w, channels)``."""
    values = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes | bytearray | memoryview) else np.asarray(raw)
    return values.reshape(h, w, -1)


DECISION = "video long, frame long, score double, is_fade boolean, is_cut boolean, shot long, ymin int, ymax int, xmin int, xmax int"
DECISION_COLUMNS = [part.split()[0] for part in DECISION.split(", ")]


def detect_cuts(frames: DataFrame, cfg: SceneConfig, value: str = "rgb") -> DataFrame:
    """A decision on each frame of ``video, frame, h, w`` and its packed pixels; ``shot`` counts cuts from 1."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, detector, shot = None, None, 0
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if detector is None or r.video != video:
                    video, detector, shot = r.video, CutDetector(cfg), 0
                d = detector.step(image(r.px, r.h, r.w))
                shot += d["is_cut"]
                out.append((video, r.frame, d["score"], d["is_fade"], d["is_cut"], shot, *d["box"]))
            yield pd.DataFrame(out, columns=DECISION_COLUMNS)

    rows = frames.select(frames["video"].cast("long").alias("video"), frames["frame"].cast("long").alias("frame"), "h", "w", frames[value].alias("px"))
    return rows.repartition("video").sortWithinPartitions("video", "frame").mapInPandas(fold, DECISION)
