"""Stateful forms for streams: smoothed signals with reset, stabilised depth, and the cut detector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parallaxis.config import SceneConfig, TemporalConfig
from parallaxis.operators.cuts import DECISION, DECISION_COLUMNS, CutDetector, Seen, image
from parallaxis.operators.temporal import Stabilizer


class Smooth(StatefulProcessor):
    """Exponential smoothing of ``value`` in order of ``frame``; state is one number and a count.

    Frames of a batch are sorted.  A frame at or before the last one seen comes too late: it is
    given out with ``late`` and without a value, so nothing is lost unseen.
    """

    def __init__(self, eta: float, reset_gap: int | None = None):
        self.eta, self.reset_gap = eta, reset_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("smoothed", "value double, frame long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values("frame")
        held = self.state.get() if self.state.exists() else None
        value, last = held if held is not None else (None, -1)
        out = []
        for frame, x in zip(table["frame"], table["value"], strict=True):
            if frame <= last:
                out.append((key[0], int(frame), None, True))
                continue
            if value is None or (self.reset_gap is not None and frame - last > self.reset_gap):
                value = float(x)
            else:
                value = (1 - self.eta) * value + self.eta * float(x)
            last = int(frame)
            out.append((key[0], last, value, False))
        if value is not None:
            self.state.update((value, last))
        yield pd.DataFrame(out, columns=["video", "frame", "smoothed", "late"]).astype({"smoothed": "float64"})

    def close(self) -> None:
        pass


def smooth_stream(frames: DataFrame, eta: float, reset_gap: int | None = None) -> DataFrame:
    """``video, frame, smoothed, late`` from a stream (or table) of ``video, frame, value``."""
    # a table needs the coordinator of state stores too, which the first use of streams starts
    _ = frames.sparkSession.streams.active
    return frames.groupBy("video").transformWithStateInPandas(
        statefulProcessor=Smooth(eta, reset_gap), outputStructType="video long, frame long, smoothed double, late boolean", outputMode="Append", timeMode="None"
    )


class StabilizeStream(StatefulProcessor):
    """The stabiliser over a stream of packed frames: the state is one frame's grey and depth.  Late frames are given out as such."""

    KIND = "h int, w int, gray array<double>, depth array<double>, low double, high double, place int, frame long"

    def __init__(self, cfg: TemporalConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", self.KIND)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, last = Stabilizer(self.cfg), -1
        if self.state.exists():
            h, w, gray, depth, held.low, held.high, held.index, last = self.state.get()
            held.gray, held.depth = np.reshape(gray, (h, w)).astype(float), np.reshape(depth, (h, w)).astype(float)
        out = []
        for r in pd.concat(list(rows)).sort_values("frame").itertuples(index=False):
            if r.frame <= last:
                out.append((key[0], int(r.frame), None, None, None, None, None, True))
                continue
            s = held.step(np.asarray(r.luma, float).reshape(r.h, r.w), np.asarray(r.z, float).reshape(r.h, r.w))
            last = int(r.frame)
            out.append((key[0], last, s["in_shot"], s["low"], s["high"], s["valid_fraction"], s["depth"].ravel().tolist(), False))
        if held.gray is not None:
            h, w = held.gray.shape
            self.state.update((h, w, held.gray.ravel().tolist(), held.depth.ravel().tolist(), float(held.low), float(held.high), held.index, last))
        yield pd.DataFrame(out, columns=["video", "frame", "in_shot", "low", "high", "valid_fraction", "depth", "late"]).astype({"in_shot": "Int32", "low": "float64", "high": "float64", "valid_fraction": "float64"})

    def close(self) -> None:
        pass


def stabilize_stream(frames: DataFrame, cfg: TemporalConfig) -> DataFrame:
    """Stabilised depth from a stream (or table) of packed frames ``video, frame, h, w, luma, z``; ``late`` frames have none."""
    _ = frames.sparkSession.streams.active
    return frames.groupBy("video").transformWithStateInPandas(
        statefulProcessor=StabilizeStream(cfg), outputStructType="video long, frame long, in_shot int, low double, high double, valid_fraction double, depth array<double>, late boolean", outputMode="Append", timeMode="None"
    )


class DetectCuts(StatefulProcessor):
    """The cut detector over a stream of packed frames: the state is a thumbnail, a histogram and the last cut.

    A frame at or before the last one seen comes too late to be compared: it is given out with
    ``late`` and without a decision, so nothing is lost unseen.
    """

    KIND = "h int, w int, bins array<double>, gray array<double>, fade boolean, last_cut long, index long, shot long, frame long"

    def __init__(self, cfg: SceneConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", self.KIND)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, shot, last = Seen(), 0, -1
        shape = (self.cfg.thumb_height, self.cfg.thumb_width)
        if self.state.exists():
            h, w, bins, gray, fade, last_cut, index, shot, last = self.state.get()
            seen = Seen(h, w, np.array(bins) if bins else None, np.reshape(gray, shape) if gray else None, fade, last_cut, index)
        detector, out = CutDetector(self.cfg, seen), []
        for r in pd.concat(list(rows)).sort_values("frame").itertuples(index=False):
            if r.frame <= last:
                out.append((key[0], r.frame, None, None, None, None, None, None, None, None, True))
                continue
            d = detector.step(image(r.px, r.h, r.w))
            last, shot = int(r.frame), shot + d["is_cut"]
            out.append((key[0], last, d["score"], d["is_fade"], d["is_cut"], shot, *d["box"], False))
        s = detector.seen
        small = lambda a: [] if a is None else np.asarray(a, float).ravel().tolist()
        self.state.update((s.h, s.w, small(s.bins), small(s.gray), s.fade, s.last_cut, s.index, shot, last))
        kinds = {"score": "float64", "is_fade": "boolean", "is_cut": "boolean", "shot": "Int64", **dict.fromkeys(("ymin", "ymax", "xmin", "xmax"), "Int32")}
        yield pd.DataFrame(out, columns=[*DECISION_COLUMNS, "late"]).astype(kinds)

    def close(self) -> None:
        pass


def cut_stream(frames: DataFrame, cfg: SceneConfig, value: str = "rgb") -> DataFrame:
    """Decisions on a stream (or table) of packed frames ``video, frame, h, w`` and pixels, and ``late``."""
    _ = frames.sparkSession.streams.active
    rows = frames.select(frames["video"].cast("long").alias("video"), frames["frame"].cast("long").alias("frame"), "h", "w", frames[value].alias("px"))
    return rows.groupBy("video").transformWithStateInPandas(statefulProcessor=DetectCuts(cfg), outputStructType=DECISION + ", late boolean", outputMode="Append", timeMode="None")


def spaced_cuts(scores: DataFrame, threshold: float, least_frames: int) -> DataFrame:
    """Cuts at least ``least_frames`` after the last: ``video, frame, is_cut`` from ``video, frame, score``.

    The rule depends on its own decisions, so a video's frames are folded in order; what is
    held is the last cut's place.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, last = None, 0
        for rows in batches:
            out = []
            for v, frame, score in zip(rows["video"], rows["frame"], rows["score"], strict=True):
                first = v != video
                cut = bool(first or (score >= threshold and frame - last >= least_frames))
                video, last = v, frame if cut else last
                out.append(cut)
            yield rows[["video", "frame"]].assign(is_cut=out)

    ordered = scores.select("video", "frame", "score").repartition("video").sortWithinPartitions("video", "frame")
    return ordered.mapInPandas(fold, "video long, frame long, is_cut boolean")
