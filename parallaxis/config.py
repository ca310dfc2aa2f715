"""Settings of the operators, checked when they are made, that is before any plan is built."""

from __future__ import annotations

import math
from dataclasses import dataclass


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class DisparityConfig:
    """Signed disparity: strength and limits as shares of the width, the zero plane, the percentiles."""

    strength: float = 0.03
    q_screen: float = 0.6
    percentile_min: float = 1.0
    percentile_max: float = 99.0
    max_fraction: float = 0.05
    min_fraction: float | None = None
    bounds: tuple[float, float] | None = None

    def __post_init__(self):
        _check(math.isfinite(self.strength) and self.strength >= 0, "strength is negative or not finite")
        _check(0 <= self.q_screen <= 1, "q_screen is not within 0 and 1")
        _check(0 <= self.percentile_min < self.percentile_max <= 100, "percentiles are not in order")
        _check(self.max_fraction > 0, "max_fraction is not positive")
        _check(self.min_fraction is None or self.min_fraction <= 0, "min_fraction is positive")
        _check(self.bounds is None or (all(map(math.isfinite, self.bounds)) and self.bounds[0] < self.bounds[1]), "bounds are not in order")


@dataclass(frozen=True)
class SplatConfig:
    relative_tolerance: float = 0.05
    absolute_tolerance: float = 1e-4
    least_weight: float = 1e-4

    def __post_init__(self):
        _check(min(self.relative_tolerance, self.absolute_tolerance) >= 0, "a tolerance is negative")
        _check(self.least_weight > 0, "least_weight is not positive")


@dataclass(frozen=True)
class FillConfig:
    max_hole_width: int = 16
    depth_tolerance: float = 0.05
    fill_large: bool = True

    def __post_init__(self):
        _check(self.max_hole_width >= 1, "max_hole_width is below 1")
        _check(self.depth_tolerance >= 0, "depth_tolerance is negative")


@dataclass(frozen=True)
class SceneConfig:
    cut_threshold: float = 0.35
    fade_threshold: float = 8.0
    letterbox_threshold: float = 12.0
    detect_letterbox: bool = True
    min_scene_frames: int = 1
    bins: int = 16
    thumb_height: int = 72
    thumb_width: int = 128

    def __post_init__(self):
        _check(0 < self.cut_threshold <= 1, "cut_threshold is not within 0 and 1")
        _check(self.fade_threshold >= 0 and self.letterbox_threshold >= 0, "a luminance threshold is negative")
        _check(self.min_scene_frames >= 1, "min_scene_frames is below 1")
        _check(self.thumb_height >= 1 and self.thumb_width >= 1, "a thumbnail has no pixels")


@dataclass(frozen=True)
class TemporalConfig:
    """The stabiliser.  Motion is estimated on a copy of ``flow_scale``, of at most ``max_estimator`` and at least ``min_estimator`` pixels a side.

    ``subpixel`` weighs all fine shifts by how well they match (``temperature``) instead of taking the best.
    """

    alpha: float = 0.7
    flow_scale: float = 0.5
    max_estimator: int = 240
    min_estimator: int = 48
    subpixel: bool = False
    temperature: float = 0.005
    align_scale: bool = True
    lower_median: bool = True
    smooth_edges: bool = True
    find_cuts: bool = True
    consistency: float = 1.5
    photometric: float = 30.0
    depth_difference: float = 0.25
    edge: float = 0.20
    max_scale: float = 0.15
    min_shared: int = 500
    eta: float = 0.1
    radius_coarse: int = 4
    radius_fine: int = 2
    patch: int = 5
    fade_threshold: float = 8.0
    cut_threshold: float = 0.25
    percentile_min: float = 1.0
    percentile_max: float = 99.0
    enabled: bool = True

    def __post_init__(self):
        _check(0 <= self.alpha < 1, "alpha is not from 0 to below 1")
        _check(0 < self.eta <= 1, "eta is not within 0 and 1")
        _check(min(self.consistency, self.photometric, self.depth_difference, self.edge) > 0, "a threshold is not positive")
        _check(0 <= self.max_scale < 1, "max_scale is not within 0 and 1")
        _check(self.patch % 2 == 1 and self.patch >= 3, "patch is even or below 3")
        _check(0.05 <= self.flow_scale <= 1, "flow_scale is not within 0.05 and 1")
        _check(self.max_estimator >= 32, "max_estimator is below 32")
        _check(min(self.radius_coarse, self.radius_fine) >= 1, "a search radius is below 1")
        _check(self.min_shared >= 10, "min_shared is below 10")
        _check(0 <= self.percentile_min < self.percentile_max <= 100, "percentiles are not in order")
        _check(0 < self.cut_threshold <= 1, "cut_threshold is not within 0 and 1")

    @classmethod
    def compatible(cls, **settings) -> TemporalConfig:
        """The variant of the other route: edges of the raw depth from 0.15 on, the averaged median, motion at half size without a cap, and no cuts of its own."""
        return cls(**{"edge": 0.15, "smooth_edges": False, "lower_median": False, "max_estimator": 1 << 30, "min_estimator": 32, "find_cuts": False} | settings)


@dataclass(frozen=True)
class HeuristicConfig:
    """Depth from luma, edges and height: the weights are divided by their sum."""

    strength: float = 0.55
    max_pixels: int = 6
    luma: float = 0.45
    edge: float = 0.25
    vertical: float = 0.30
    half_up: bool = False

    def __post_init__(self):
        _check(0 <= self.strength <= 1, "strength is not within 0 and 1")
        _check(0 <= self.max_pixels <= 16, "max_pixels is not within 0 and 16")
        _check(min(self.luma, self.edge, self.vertical) >= 0, "a weight is negative")

    @property
    def weights(self) -> tuple[float, float, float]:
        total = self.luma + self.edge + self.vertical
        return (self.luma / total, self.edge / total, self.vertical / total) if total > 0 else (0.45, 0.25, 0.30)


@dataclass(frozen=True)
class ConversionConfig:
    """Settings of a whole conversion that no operator reads by itself."""

    video_encoder: str = "auto"
    video_bitrate_mbps: float | None = None
    buffer_slots: int = 6
    audio_codec: str = "copy"
    watchdog_timeout_s: float = 10.0

    def __post_init__(self):
        _check(self.buffer_slots >= 2, "buffer_slots is below 2")
        _check(self.video_bitrate_mbps is None or self.video_bitrate_mbps > 0, "video_bitrate_mbps is not positive")
        _check(bool(self.video_encoder.strip()), "video_encoder is empty")
        _check(self.audio_codec.strip().lower() in ("copy", "aac"), "audio_codec is neither copy nor aac")
        _check(self.watchdog_timeout_s > 0, "watchdog_timeout_s is not positive")


def batch_size(value: object) -> int:
    """A batch of 1 to 20 frames; truth values are not numbers here."""
    _check(isinstance(value, int) and not isinstance(value, bool) and 1 <= value <= 20, "the batch size is not an integer from 1 to 20")
    return value


def depth_scale(value: str | float) -> float:
    """``1/4``, ``1/2`` or ``1/1``, as text or number."""
    number = {"1/4": 0.25, "1/2": 0.5, "1/1": 1.0}.get(value) if isinstance(value, str) else value
    for allowed in (0.25, 0.5, 1.0):
        if isinstance(number, int | float) and abs(number - allowed) <= 1e-4:
            return allowed
    raise ValueError(f"no such depth scale: {value!r}")


# The three ready-made profiles, the names of a profile file's settings and of
# those below its ``depth``.
PROFILES = {
    "safe_low": HeuristicConfig(strength=0.55, max_pixels=6, edge=0.25, luma=0.45, vertical=0.30),
    "offline_quality": HeuristicConfig(strength=0.65, max_pixels=8, edge=0.30, luma=0.40, vertical=0.30),
    "realtime_lowlatency": HeuristicConfig(strength=0.50, max_pixels=5, edge=0.25, luma=0.45, vertical=0.30),
}
PROFILE_SETTINGS = ("codec", "video_encoder", "video_bitrate_mbps", "fps_mode", "sbs_mode", "overflow_policy", "buffer_slots", "audio_passthrough", "audio_codec", "preserve_color_metadata", "backend_preference")
DEPTH_SETTINGS = {"max_disparity_px": "max_pixels", "depth_strength": "strength", "edge_weight": "edge", "luma_weight": "luma", "vertical_weight": "vertical"}


def load_profile(path: str, base: HeuristicConfig | None = None) -> HeuristicConfig:
    """The heuristic's settings from a profile file, over ``base``; unknown names are errors.

    Such a file has lines of ``name: value``: settings of the whole conversion, and, indented
    below ``depth:``, those of the heuristic.  Own names of the heuristic's settings are taken
    at either place.
    """
    from dataclasses import fields, replace

    values: dict[str, object] = {}
    kinds = {f.name: type(getattr(HeuristicConfig(), f.name)) for f in fields(HeuristicConfig)}
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.split("#")[0].strip()
            if not line or line == "depth:":
                continue
            name, colon, value = (part.strip() for part in line.partition(":"))
            name = DEPTH_SETTINGS.get(name, name)
            _check(bool(colon) and (name in kinds or name in PROFILE_SETTINGS), f"not a setting: {line}")
            if name in kinds:
                values[name] = value.lower() == "true" if kinds[name] is bool else kinds[name](value)
    return replace(base or HeuristicConfig(), **values)
