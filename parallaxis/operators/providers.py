"""Where depth comes from: a contract for providers, batches of frames, and two stand-ins (no depth model is shipped)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parallaxis.config import batch_size, depth_scale
from parallaxis.operators.geometry import DEVIATION, MEAN
from parallaxis.operators.temporal import resize, shrunk

PATCH = 14


class DepthProvider(Protocol):
    #: Whether images come with the channel means and deviations of image models taken out, instead of as 0 to 255.
    normalized: bool

    def predict_batch(self, images: np.ndarray) -> np.ndarray:
        """Depth ``(n, h, w)`` for images ``(n, h, w, 3)`` that have nothing to do with each other; smaller is nearer."""


class Ramp:
    """Depth that falls from left to right; the same for every image."""

    normalized = False

    def __init__(self, far: float = 5.0, near: float = 1.0):
        self.far, self.near = far, near

    def predict_batch(self, images: np.ndarray) -> np.ndarray:
        return np.broadcast_to(np.linspace(self.far, self.near, images.shape[2]), images.shape[:3]).copy()


class FromLuma:
    """Brighter is nearer."""

    normalized = False

    def predict_batch(self, images: np.ndarray) -> np.ndarray:
        return 5.0 - 4.0 * (images @ np.array([0.299, 0.587, 0.114])) / 255.0


def resized(px: np.ndarray, h: int, w: int) -> np.ndarray:
    """``(y, x)`` or ``(y, x, channels)`` at another size: means of areas where both sides shrink, else bilinear."""
    if px.shape[:2] == (h, w):
        return px
    one = shrunk if h <= px.shape[0] and w <= px.shape[1] else resize
    return one(px, h, w) if px.ndim == 2 else np.stack([one(px[:, :, c], h, w) for c in range(px.shape[2])], axis=-1)


def multiple(n: int) -> int:
    """The nearest multiple of the patch, at least one; the larger of two as near."""
    return max(PATCH, (2 * n + PATCH) // (2 * PATCH) * PATCH)


def model_sizes(h: int, w: int, target: int | None, scale: float | None) -> tuple[tuple[int, int], tuple[int, int]]:
    """The size an image is resized to, and the one it is padded to.

    With ``scale`` sides are scaled, rounded half up, and padded to multiples of the patch; with
    ``target`` the longest side becomes that and both sides multiples of the patch; else nothing changes.
    """
    if scale is not None:
        small = tuple(max(1, int(n * scale + 0.5)) for n in (h, w))
        return small, tuple(-(-n // PATCH) * PATCH for n in small)
    if target is not None:
        fitted = tuple(multiple(max(1, round(n * (target / max(h, w))))) for n in (h, w))
        return fitted, fitted
    return (h, w), (h, w)


def padded(px: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mirrored on the right and below, or repeated where the image is too small for that."""
    for axis, n in ((0, h), (1, w)):
        extra = n - px.shape[axis]
        if extra:
            px = np.pad(px, [(0, extra if a == axis else 0) for a in range(px.ndim)], mode="reflect" if px.shape[axis] > extra else "edge")
    return px


_providers: dict[str, DepthProvider] = {}

PREDICTED = "video long, frame long, h int, w int, processed_h int, processed_w int, min_depth double, max_depth double, mean_depth double, depth array<double>"
PREDICTED_COLUMNS = [part.split()[0] for part in PREDICTED.split(", ")]


def predict_depth(
    frames: DataFrame, provider: DepthProvider | Callable[[], DepthProvider], batch: int = 1, target: int | None = None, scale: str | float | None = None, original_size: bool = True, positive: bool = False
) -> DataFrame:
    """Depth of packed RGB frames ``video, frame, h, w, rgb``.

    Frames of one size go to the provider in stacks of ``batch``, also across the batches in which
    rows arrive; what waits for company is bounded, and whatever waits at the end goes alone.  A
    worker makes its provider once (give a function for one that is costly to make or to send).
    Depth comes back in the frame's size, or with ``original_size=False`` in the size it was
    resized to.  ``positive`` raises depths to 1e-6; otherwise one that is not positive is an error.
    """
    count, factor, key = batch_size(batch), None if scale is None else depth_scale(scale), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _providers:
            _providers.clear()
            _providers[key] = provider() if isinstance(provider, type) or not hasattr(provider, "predict_batch") else provider
        held = _providers[key]
        waiting: dict[tuple[int, int], list] = {}

        def predicted(h, w, rows):
            (to_h, to_w), (full_h, full_w) = model_sizes(h, w, target, factor)
            images = np.stack([padded(resized(np.frombuffer(raw, np.uint8).reshape(h, w, 3).astype(float), to_h, to_w), full_h, full_w) for *_, raw in rows])
            if held.normalized:
                images = (images / 255.0 - np.array(MEAN)) / np.array(DEVIATION)
            depth = np.asarray(held.predict_batch(images), float)
            if depth.shape != images.shape[:3]:
                raise ValueError(f"a provider's depth must have the size of its images, {images.shape[:3]}, not {depth.shape}")
            out = []
            for (video, frame, _), z in zip(rows, depth, strict=True):
                z = z[:to_h, :to_w]
                z = resized(z, h, w) if original_size else z
                z = np.maximum(z, 1e-6) if positive else z
                if not np.isfinite(z).all() or (z <= 0).any():
                    raise ValueError("a provider's depth must be positive and finite")
                out.append((video, frame, *z.shape, full_h, full_w, z.min(), z.max(), z.mean(), z.ravel()))
            return pd.DataFrame(out, columns=PREDICTED_COLUMNS)

        for b in batches:
            for video, frame, h, w, raw in zip(b["video"], b["frame"], b["h"], b["w"], b["rgb"], strict=True):
                rows = waiting.setdefault((h, w), [])
                rows.append((video, frame, raw))
                if len(rows) == count:
                    yield predicted(h, w, waiting.pop((h, w)))
                elif sum(map(len, waiting.values())) > 4 * count:
                    largest = max(waiting, key=lambda s: len(waiting[s]))
                    yield predicted(*largest, waiting.pop(largest))
        for (h, w), rows in waiting.items():
            yield predicted(h, w, rows)

    return frames.select("video", "frame", "h", "w", "rgb").mapInPandas(run, PREDICTED)
