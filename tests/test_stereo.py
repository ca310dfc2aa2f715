"""Depth, splat, fill and render on small frames with results worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.config import PROFILES, DisparityConfig, FillConfig, HeuristicConfig, SceneConfig, SplatConfig, TemporalConfig, batch_size, depth_scale, load_profile
from parallaxis.operators import depth, fill, geometry, heuristic, render, splat
from parallaxis.sources import frames as V

KEYS = ["f"]


def px(spark, z, colors=None, shift=None):
    w = len(z)
    colors = colors or [i / max(1, w - 1) for i in range(w)]
    shift = shift or [0.0] * w
    rows = [(0, 0, x, float(z[x]), float(colors[x]), float(shift[x]), float(w)) for x in range(w)]
    return spark.createDataFrame(rows, "f int, y int, x int, z double, g double, shift double, width double")


def by_x(df, *cols):
    return {r.x: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def disparities(spark, z, cfg):
    frame = px(spark, z).drop("width")
    return by_x(depth.disparity(frame, KEYS, cfg), "disparity", "q")


def test_near_is_positive_and_far_negative(spark):
    got = disparities(spark, [4, 1], DisparityConfig(strength=0.05, q_screen=0.5, percentile_min=0, percentile_max=100))
    assert got[0][0] == pytest.approx(-0.05) and got[1][0] == pytest.approx(0.05)


def test_zero_plane(spark):
    got = disparities(spark, [4, 1.6, 1], DisparityConfig(q_screen=0.5, percentile_min=0, percentile_max=100))
    assert got[1] == (pytest.approx(0.0), pytest.approx(0.5))


def test_limits_and_flat_frames(spark):
    got = disparities(spark, [100, 0.01], DisparityConfig(strength=1.0, percentile_min=0, percentile_max=100))
    assert max(abs(d) for d, _ in got.values()) <= 0.05 * 2 + 1e-12
    assert {q for _, q in disparities(spark, [2, 2, 2], DisparityConfig()).values()} == {0.6}
    assert {d for d, _ in disparities(spark, [1, 2, 3], DisparityConfig(strength=0.0)).values()} == {0.0}


def test_invalid_depth(spark):
    df = spark.createDataFrame([(0, v) for v in (1.0, float("nan"), float("inf"), -0.5, 0.0, None)] + [(1, 1.0)], "f int, z double")
    got = {r.f: (r.n, r.bad, r.valid) for r in depth.validate_depth(df, KEYS).collect()}
    assert got == {0: (6, 5, False), 1: (1, 0, True)}


def drawn(spark, z, colors, shift):
    return by_x(splat.forward_splat(px(spark, z, colors, shift), KEYS, "shift", ["g"], SplatConfig()), "covered", "depth", "g", "weight")


def test_near_wins(spark):
    got = drawn(spark, [3, 1, 2, 2], [0.1, 0.9, 0.5, 0.6], [2, 1, 10, 0])
    assert got[2] == (True, pytest.approx(1.0), pytest.approx(0.9), pytest.approx(1.0))
    assert not got[0][0] and got[3][0]


def test_subpixel_weights(spark):
    landed = splat.contributions(px(spark, [2, 2], shift=[0.25, 10]), KEYS, "shift", SplatConfig()).collect()
    assert sorted((r.xt, r.w) for r in landed) == [(0, 0.75), (1, 0.25)]


def test_black_is_covered_and_no_shift_is_identity(spark):
    assert all(v[0] and v[2] == 0 for v in drawn(spark, [1.5] * 3, [0.0] * 3, [0.0] * 3).values())
    assert {x: v[2] for x, v in drawn(spark, [1, 2, 3], [0.2, 0.4, 0.6], [0.0] * 3).items()} == {0: 0.2, 1: 0.4, 2: 0.6}


def holes(spark, z, colors=None):
    w = len(z)
    colors = colors or [None if v is None else x / max(1, w - 1) for x, v in enumerate(z)]
    rows = [(0, 0, x, z[x], colors[x], z[x] is not None, float(w)) for x in range(w)]
    return spark.createDataFrame(rows, "f int, y int, x int, depth double, g double, covered boolean, width double")


def test_background_fills_holes(spark):
    got = by_x(fill.fill_holes(holes(spark, [3.0, 3.0, None, None, 1.0, 1.0], [0.1, 0.2, None, None, 0.8, 0.9]), KEYS, ["g"], FillConfig()), "depth", "g", "filled")
    assert got[2] == got[3] == (3.0, 0.2, True)
    got = by_x(fill.fill_holes(holes(spark, [1.0, 1.0, None, None, 4.0, 4.0], [0.1, 0.2, None, None, 0.8, 0.9]), KEYS, ["g"], FillConfig()), "depth", "g")
    assert got[2] == (4.0, 0.8)


def test_like_depths_are_interpolated_and_borders_extended(spark):
    got = by_x(fill.fill_holes(holes(spark, [2.0, None, None, 2.0], [0.0, None, None, 1.0]), KEYS, ["g"], FillConfig()), "g")
    assert got[1] == pytest.approx(1 / 3) and got[2] == pytest.approx(2 / 3)
    got = by_x(fill.fill_holes(holes(spark, [None, None, 2.5, 2.5], [None, None, 0.4, 0.5]), KEYS, ["g"], FillConfig()), "g", "depth")
    assert got[0] == got[1] == (0.4, 2.5)


def test_large_holes_are_counted_and_gated(spark):
    z = [1.0 if x < 2 or x > 19 else None for x in range(25)]
    cfg = FillConfig(max_hole_width=10, fill_large=False)
    f = fill.fill_holes(holes(spark, z), KEYS, ["g"], cfg)
    assert f.where("unfilled").count() == 18
    (d,) = fill.diagnostics(f, KEYS, cfg).collect()
    assert (d.holes, d.max_hole_width, d.large_holes) == (18, 18, 1) and d.hole_fraction == pytest.approx(18 / 25) and d.warning
    assert fill.fill_holes(holes(spark, [None, None]), KEYS, ["g"], FillConfig()).where("unfilled").count() == 2


def test_render_invariants(spark):
    rows = [(0, y, x, 0.8 if 15 <= x < 25 else 3.0, x / 39) for y in range(4) for x in range(40)]
    frame = spark.createDataFrame(rows, "f int, y int, x int, z double, g double")
    eyes = render.render(frame, KEYS, ["g"], DisparityConfig(strength=0.20), SplatConfig(), FillConfig()).cache()
    assert eyes.count() == 2 * 4 * 40
    assert eyes.where("NOT covered AND filled = unfilled").count() == 0 and eyes.where("covered AND (filled OR unfilled)").count() == 0
    assert eyes.where("NOT covered").count() > 0
    sbs = render.side_by_side(eyes, KEYS, ["g"])
    assert sbs.agg(F.max("x")).first()[0] == 79
    assert render.eye_difference(sbs, KEYS, "g", 40).first().is_stereo
    still = render.side_by_side(render.render(frame, KEYS, ["g"], DisparityConfig(strength=0.0), SplatConfig(), FillConfig()), KEYS, ["g"])
    assert render.eye_difference(still, KEYS, "g", 40).first().max_diff == 0


def test_heuristic_rounding_and_warp(spark):
    rows = [(0, y, x, 240 if 2 <= x < 6 else 16) for y in range(4) for x in range(8)]
    frame = spark.createDataFrame(rows, "f int, y int, x int, luma int")
    d = heuristic.heuristic_disparity(frame, KEYS, 4, HeuristicConfig()).cache()
    assert d.where("d < 0 OR d > 8").count() == 0
    warped = heuristic.backward_warp(d, KEYS, 8)
    assert warped.count() == 64
    zero = heuristic.backward_warp(heuristic.heuristic_disparity(frame, KEYS, 4, HeuristicConfig(strength=0.0)), KEYS, 8)
    assert sorted((r.y, r.x, r.luma) for r in zero.where("eye = 1").collect()) == sorted((y, x, v) for _, y, x, v in rows)


def test_heuristic_of_a_known_frame(spark):
    """Edges weigh .25, luma .45, height .30."""
    rows = [(0, y, x, 250 if x >= 4 else 10) for y in range(4) for x in range(8)]
    got = {(r.y, r.x): r.d for r in heuristic.heuristic_disparity(spark.createDataFrame(rows, "f int, y int, x int, luma int"), KEYS, 4, HeuristicConfig(strength=1.0, max_pixels=16)).collect()}
    for y in range(4):
        for x in range(8):
            edge = 240 / 510 if x == 4 else 0.0
            assert got[y, x] == round(16 * (0.25 * edge + 0.45 * (250 if x >= 4 else 10) / 255 + 0.30 * y / 3))
    with pytest.raises(ValueError):
        heuristic.side_by_side(None, None, KEYS, 5, 8, HeuristicConfig())


def test_frames_with_unusable_depth_are_rejected_whole(spark):
    bad = {1: 0.0, 2: math.nan, 3: -1.0, 4: math.inf, 5: None}
    rows = [(f, 0, x, bad.get(f, 1.0 + x) if x == 2 else 1.0 + x, 0.5) for f in range(6) for x in range(8)]
    px = spark.createDataFrame(rows, "f int, y int, x int, z double, g double")
    for cfg in (DisparityConfig(), DisparityConfig(strength=0.0), DisparityConfig(bounds=(0.1, 0.9))):
        assert {r.f for r in depth.disparity(px, KEYS, cfg).collect()} == {0}
    assert {r.f: r.reason for r in depth.rejections(px, KEYS).collect()} == {0: None, 1: "non-positive", 2: "non-finite", 3: "non-positive", 4: "non-finite", 5: "non-finite"}


def test_fractions_have_bounded_denominators(spark):
    from fractions import Fraction

    from parallaxis.functions.numeric import fraction

    texts = ["29.97002997", "23.976", "59.94", "0.333333333", "0.1", "30", "30000/1001", "-29.97", "60/2", "0/0", "N/A", "", "3.141592653", "1e-9", "12345.678901"]
    got = {r.t: r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", fraction(F.col("t")).alias("f")).collect()}
    for t in texts:
        want = None if t in ("0/0", "N/A", "") else Fraction(t) if "/" in t else Fraction(float(t)).limit_denominator(10000)
        assert (None if got[t] is None else Fraction(got[t].num, got[t].den)) == want, t


def test_area_resize_is_the_mean_below_a_pixel(spark):
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (9, 14))
    rows = [(0, y, x, int(image[y, x]), 1, 8, 2, 13) for y in range(1, 8) for x in range(2, 13)]
    px = spark.createDataFrame(rows, "f int, y int, x int, v int, ymin int, ymax int, xmin int, xmax int")
    part = image[1:8, 2:13]
    for h, w in ((3, 4), (7, 11), (10, 20)):
        rows_of = lambda size, to: np.array([[max(0, min((s + 1) * to, (t + 1) * size) - max(s * to, t * size)) / size for s in range(size)] for t in range(to)])
        want = rows_of(7, h) @ part @ rows_of(11, w).T
        got = geometry.area_resize(px, KEYS, h, w, ("v",)).collect()
        assert len(got) == h * w and all(abs(r.v - want[r.y, r.x]) <= 0.5 + 1e-9 for r in got)


def test_images_become_rgb(spark, tmp_path):
    import struct
    import zlib

    rgb = np.random.default_rng(1).integers(0, 256, (5, 7, 3), np.uint8)
    (tmp_path / "a.ppm").write_bytes(b"P6\n# made here\n7 5\n255\n" + rgb.tobytes())
    (tmp_path / "b.pgm").write_bytes(b"P5 7 5 255\n" + rgb[:, :, 0].tobytes())
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def png(px, filters):
        n = px.shape[2]
        above, lines = np.zeros((7, n), int), b""
        for line, f in zip(px.astype(int), filters, strict=True):
            left = np.vstack([np.zeros((1, n), int), line[:-1]])
            corner = np.vstack([np.zeros((1, n), int), above[:-1]])
            p = left + above - corner
            d = np.abs(np.stack([p - left, p - above, p - corner]))
            paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above, corner))
            guess = (np.zeros_like(line), left, above, (left + above) // 2, paeth)[f]
            lines += bytes([f]) + ((line - guess) & 255).astype(np.uint8).tobytes()
            above = line
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, {3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")

    (tmp_path / "c.png").write_bytes(png(rgb, [0, 1, 2, 3, 4]))
    (tmp_path / "d.png").write_bytes(png(np.dstack([rgb, rgb[:, :, 0]]), [4, 3, 2, 1, 0]))
    (tmp_path / "e.txt").write_bytes(b"no image")
    (tmp_path / "f.png").write_bytes(png(rgb, [0] * 5)[:60])
    got = {r.path.rsplit("/", 1)[1]: r for r in V.images(spark, str(tmp_path)).collect()}
    gray = np.repeat(rgb[:, :, :1], 3, axis=2)
    for name, want in (("a.ppm", rgb), ("b.pgm", gray), ("c.png", rgb), ("d.png", rgb)):
        assert (got[name].height, got[name].width, bytes(got[name].data)) == (5, 7, want.tobytes()), name
    assert got["e.txt"].problem == "unknown format" and got["f.png"].problem and got["f.png"].data is None


def test_settings_are_checked(tmp_path):
    for bad in (lambda: DisparityConfig(strength=math.nan), lambda: DisparityConfig(bounds=(2.0, 1.0)), lambda: FillConfig(max_hole_width=0), lambda: SceneConfig(min_scene_frames=0), lambda: TemporalConfig(alpha=2), lambda: HeuristicConfig(max_pixels=17), lambda: batch_size(True), lambda: batch_size(21), lambda: depth_scale("1/3")):
        with pytest.raises(ValueError):
            bad()
    assert batch_size(20) == 20 and depth_scale("1/4") == depth_scale(0.25) == 0.25
    with pytest.raises(ValueError):
        DisparityConfig(min_fraction=0.01)
    assert HeuristicConfig(luma=0, edge=0, vertical=0).weights == (0.45, 0.25, 0.30)
    plain = HeuristicConfig()
    assert (plain.strength, plain.max_pixels, plain.edge, plain.luma, plain.vertical) == (0.55, 6, 0.25, 0.45, 0.30)
    assert PROFILES["offline_quality"] == HeuristicConfig(strength=0.65, max_pixels=8, edge=0.30, luma=0.40, vertical=0.30)
    (tmp_path / "o.yaml").write_text("# quality\ncodec: h265\nbuffer_slots: 8\ndepth:\n  max_disparity_px: 8\n  depth_strength: 0.65\n  edge_weight: 0.30\n  luma_weight: 0.40\n  vertical_weight: 0.30\n")
    assert load_profile(str(tmp_path / "o.yaml")) == PROFILES["offline_quality"]
    (tmp_path / "p.yaml").write_text("strength: 0.5 # half\nhalf_up: true\n")
    assert load_profile(str(tmp_path / "p.yaml")) == HeuristicConfig(strength=0.5, half_up=True)
    (tmp_path / "q.yaml").write_text("speed: 3\n")
    with pytest.raises(ValueError):
        load_profile(str(tmp_path / "q.yaml"))


def test_modules_are_allowed_by_the_exact_list_at_any_depth(spark):
    from parallaxis.operators.catalog import modules_allowed

    cases = [
        ('{"net": {"__object__": {"args": {"k": 1}, "path": "depth.core"}}}', True),
        ('{"__object__": {"args": {"k": 1}, "path": "os.evil"}}', False),
        ('[{"__object__": {"path": "depth.core", "args": {"__object__": {"path": "os"}}}}]', False),
        ('{"__object__": {"path": "depth.core.other"}}', False),
        ('{"__object__": {"name": "A"}}', False),
        ('{"__object__": {"path": ["depth.core"]}}', False),
        ('{"__object__": "depth.core"}', False),
        ('{"plain": [1, null]}', True),
        ("{", False),
        (None, False),
        ('"text"', True),
        ("null", True),
        ('{"__object__": null}', False),
        ('{"__object__": {"path": 5}}', False),
        ("[" * 150 + '{"__object__": {"path": "os"}}' + "]" * 150, False),
        ("[" * 150 + '{"__object__": {"path": "depth"}}' + "]" * 150, True),
    ]
    df = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(cases)], "n int, text string")
    judged = modules_allowed(df, "n", "text", ("depth", "depth.core"))
    assert {r.n: r.allowed for r in judged.collect()} == {n: ok for n, (_, ok) in enumerate(cases)}
    assert "Python" not in judged._jdf.queryExecution().toString()


def test_settings_of_a_conversion_are_checked():
    from parallaxis.config import ConversionConfig, SceneConfig, TemporalConfig

    ConversionConfig(audio_codec=" AAC ")
    for wrong in ({"buffer_slots": 1}, {"video_bitrate_mbps": 0.0}, {"video_encoder": "  "}, {"audio_codec": "mp3"}, {"watchdog_timeout_s": 0.0}):
        with pytest.raises(ValueError):
            ConversionConfig(**wrong)
    for wrong in ({"cut_threshold": 0.0}, {"cut_threshold": 1.5}, {"fade_threshold": -1.0}, {"min_scene_frames": 0}, {"letterbox_threshold": -0.1}):
        with pytest.raises(ValueError):
            SceneConfig(**wrong)
    for wrong in ({"alpha": -0.1}, {"patch": 4}, {"patch": 1}, {"radius_fine": 0}, {"min_shared": 9}, {"eta": 0.0}, {"flow_scale": 0.01}, {"percentile_min": 99.0}, {"cut_threshold": 0.0}, {"max_scale": 1.0}, {"edge": 0.0}):
        with pytest.raises(ValueError):
            TemporalConfig(**wrong)


def test_all_is_active_without_letterbox(spark):
    from parallaxis.config import SceneConfig
    from parallaxis.operators import scenes
    from parallaxis.operators.cuts import CutDetector

    bars = np.zeros((8, 8), np.uint8)
    bars[2:6] = 200
    px = spark.createDataFrame([(0, 0, y, x, int(bars[y, x])) for y in range(8) for x in range(8)], "video int, frame int, y int, x int, luma int")
    for detect, box in ((True, (2, 6, 0, 8)), (False, (0, 8, 0, 8))):
        r = scenes.letterbox(px, ["video", "frame"], SceneConfig(detect_letterbox=detect)).first()
        assert (r.ymin, r.ymax, r.xmin, r.xmax) == box == CutDetector(SceneConfig(detect_letterbox=detect)).step(bars[:, :, None])["box"]


def test_tasks_of_splatted_pixels_follow_the_table(spark, sf, monkeypatch):
    """As many tasks as the pixels ask for, kept by Spark, with the same rows."""
    from parallaxis.plans.queries import QUERIES
    from parallaxis.sources import frames

    for name in ("hole_fill", "eye_difference"):
        monkeypatch.setattr(frames, "TASK_PIXELS", 1 << 30)
        want = sorted(map(str, QUERIES[name](spark, sf).collect()))
        monkeypatch.setattr(frames, "TASK_PIXELS", 1 << 9)
        pixels = frames.pixel_rows(spark, sf).count()
        got = QUERIES[name](spark, sf)
        assert f"{-(-pixels // (1 << 9))}), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, got.collect())) == want


#: Queries on pixels, by how many times their plans deal frames or landings.
DEALT = {"splat_zbuffer": 2, "disparity_map": 2, "disparity_zero_strength": 2, "disparity_summary": 2, "disparity_of_usable_frames": 2, "disparity_fixed_bounds": 2, "render_sbs": 3, "hole_fill_gated": 3, "hole_diagnostics": 3, "hole_spans": 3, "hole_boundaries": 3}


@pytest.mark.parametrize("name", DEALT)
def test_no_pixel_goes_to_a_task_that_spark_sizes(spark, sf, monkeypatch, name):
    """Pixels are dealt only into as many tasks as they ask for, and the rows do not depend on how many."""
    from parallaxis.plans.queries import QUERIES
    from parallaxis.sources import frames

    monkeypatch.setattr(frames, "TASK_PIXELS", 1 << 30)
    want = sorted(map(str, QUERIES[name](spark, sf).collect()))
    monkeypatch.setattr(frames, "TASK_PIXELS", 1 << 9)
    n = -(-frames.pixel_rows(spark, sf).count() // (1 << 9))
    got = QUERIES[name](spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{n}), REPARTITION_BY_NUM") == DEALT[name] and "REPARTITION_BY_COL" not in plan
    assert sorted(map(str, got.collect())) == want


def most_rows_of_a_task(df):
    return df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]


def test_filled_rows_are_shared_out_evenly(spark, sf, monkeypatch):
    """No task that fills holes holds much more than both eyes of the pixels that it was meant to."""
    from parallaxis.plans.queries import QUERIES

    monkeypatch.setattr(V, "TASK_PIXELS", 1 << 12, raising=False)
    assert most_rows_of_a_task(QUERIES["hole_fill_gated"](spark, sf)) <= 1.5 * 2 * (1 << 12)


def test_widths_of_holes_are_shared_out_evenly(spark, sf, monkeypatch):
    """The same for the widths that diagnostics and spans sum up."""
    from parallaxis.plans import queries as Q

    monkeypatch.setattr(V, "TASK_PIXELS", 1 << 12, raising=False)
    keys = ["frame", "eye"]
    widths = fill.hole_widths(fill.boundaries(Q._splatted(spark, sf), keys, ["g"]), keys, Q.FILL)
    assert most_rows_of_a_task(widths) <= 1.5 * 2 * (1 << 12)


def test_positive_fractions_are_told_without_reducing_them(spark):
    from parallaxis.functions.numeric import fraction, is_positive_fraction

    texts = ["24/1", "0/1", "-3/4", "3/-4", "-3/-4", "0/0", "1/0", "", "abc", "1/2/3", "25", "0", "-1", "0.00005", "0.000050001", "0.000049999", "1e9", "nan", "inf", " 30000/1001 ", "3/9223372036854775807", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", (fraction(F.col("t"))["num"] > 0).alias("want"), is_positive_fraction(F.col("t")).alias("got")).collect()
    assert all(r.got == r.want for r in rows) and {r.got for r in rows} == {True, False, None}


def test_one_file_of_probes_is_read_by_many_tasks(spark, sf):
    from parallaxis.plans.queries import QUERIES

    for name in ("probe_json", "fraction_parse", "fraction_limit"):
        assert QUERIES[name](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1, name
