"""Small helpers of the image source: channel order, and portable pixmaps, which Java does not read."""

from __future__ import annotations

import re

import numpy as np


def to_rgb(px: np.ndarray) -> bytes:
    """RGB bytes of rows of 1 (gray) or at least 3 channels."""
    return np.ascontiguousarray(np.repeat(px[:, :, :1], 3, axis=2) if px.shape[2] < 3 else px[:, :, :3]).tobytes()


def from_bgr(data: bytes, height: int, width: int, channels: int) -> bytes:
    """RGB bytes of an image whose colours come last to first (and then alpha)."""
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return to_rgb(px[:, :, 2::-1] if channels >= 3 else px)


def netpbm(raw: bytes) -> tuple[int | None, int | None, bytes | None, str | None]:
    """``height, width, rgb, problem`` of a binary pixmap of 8 bits."""
    head = re.match(rb"P([56])(?:\s+(?:#[^\n]*\n\s*)*)(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s", raw)
    if not head or head[4] != b"255":
        return None, None, None, "not a binary pixmap of 8 bits"
    width, height, n = int(head[2]), int(head[3]), 3 if head[1] == b"6" else 1
    if len(raw) < head.end() + height * width * n:
        return None, None, None, "shorter than its header says"
    px = np.frombuffer(raw, np.uint8, height * width * n, head.end()).reshape(height, width, n)
    return height, width, to_rgb(px), None
