"""Scenes, smoothing, flow, the stabiliser, streams and the commit protocol."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.config import SceneConfig, TemporalConfig
from parallaxis.operators import scenes, temporal
from parallaxis.operators.providers import FromLuma, Ramp, predict_depth
from parallaxis.plans.commit import CommitError, commit, exact_rows, frames_complete
from parallaxis.sources import files
from parallaxis.sources import frames as V
from parallaxis.streaming.processors import smooth_stream, spaced_cuts


def video(spark, images):
    rows = [(0, f, y, x, int(v)) for f, im in enumerate(images) for y, line in enumerate(im) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "video int, frame int, y int, x int, luma int")


def test_letterbox(spark):
    bars = np.zeros((30, 40), int)
    bars[5:25] = 120
    thin = np.zeros((30, 40), int)
    thin[14:15] = 200
    got = {r.frame: (r.ymin, r.ymax, r.xmin, r.xmax) for r in scenes.letterbox(video(spark, [bars, thin]), ["video", "frame"], SceneConfig()).collect()}
    assert got == {0: (5, 25, 0, 40), 1: (0, 30, 0, 40)}


def test_fades_and_cuts(spark):
    flat = lambda v: np.full((6, 8), v)
    got = [r.is_cut for r in scenes.scene_cuts(video(spark, [flat(150), flat(150), flat(2), flat(2), flat(180), flat(10)]), "video", SceneConfig()).orderBy("frame").collect()]
    assert got == [True, False, True, False, True, True]
    with pytest.raises(ValueError):
        scenes.scene_cuts(video(spark, [flat(1)]), "video", SceneConfig(min_scene_frames=2))


def test_smoothing_keeps_its_floor(spark):
    b = spark.createDataFrame([(0, f, 1.0, 1.0 if f < 2 else 2.0) for f in range(4)], "video long, frame int, q_low double, q_high double")
    got = [r.high for r in temporal.ema_bounds(b, "video", TemporalConfig()).orderBy("frame").collect()]
    want, high = [], None
    for q in (1.0, 1.0, 2.0, 2.0):
        high = q if high is None else 0.9 * high + 0.1 * q
        high = max(high, 1.0 + 1e-6)
        want.append(high)
    assert got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize(("ratio", "want"), [(1.08, 1.08), (2.0, 1.15), (0.5, 0.85)])
def test_scale_alignment(spark, ratio, want):
    rows = [(0, (1 + k / 300) * ratio, 1 + k / 300) for k in range(900)]
    got = temporal.scale_alignment(spark.createDataFrame(rows, "f int, inv double, inv_before double"), ["f"], TemporalConfig()).first().scale
    assert got == pytest.approx(want, abs=0.01)
    flat = spark.createDataFrame([(0, 2.2, 2.0)] * 900, "f int, inv double, inv_before double")
    assert temporal.scale_alignment(flat, ["f"], TemporalConfig()).first().scale == 1.0


def texture(h, w, dx=0, dy=0):
    cy, cx = np.mgrid[0:h, 0:w].astype(float)
    cx, cy = cx + dx, cy + dy
    return np.clip(128 + 50 * np.sin(cx / 4) * np.cos(cy / 4) + 40 * np.sin(cx / 10 + cy / 8) + 25 * np.cos(cx / 2.5), 0, 255)


def test_flow_finds_known_motion():
    flow = temporal.block_flow(texture(60, 80, 2, 1) / 255, texture(60, 80) / 255, TemporalConfig())
    inner = flow[:, 10:-10, 10:-10]
    assert np.abs(np.median(inner[0]) - 2) <= 0.75 and np.abs(np.median(inner[1]) - 1) <= 0.75


def moving(sigma, seed=42, n=8, h=60, w=80):
    rng = np.random.default_rng(seed)
    out = []
    for f in range(n):
        cy, cx = np.mgrid[0:h, 0:w].astype(float)
        cx = cx + 2 * f
        z = 2 + 0.6 * np.sin(cx / 16) * np.cos(cy / 14) + 0.3 * np.sin(cx / 25)
        out.append((texture(h, w, 2 * f), z, z + sigma * rng.standard_normal(z.shape)))
    return out


def jitter_of(frames, cfg):
    s = temporal.Stabilizer(cfg)
    out = [s.step(luma, noisy)["depth"] for luma, _, noisy in frames]
    inner = (slice(10, -10), slice(10, -10))
    return np.mean([np.abs(1 / d - 1 / z)[inner].mean() for d, (_, z, _) in zip(out[2:], frames[2:], strict=True)])


def test_stabiliser_reduces_jitter_and_only_when_enabled():
    frames = moving(0.08)
    raw = np.mean([np.abs(1 / n - 1 / z)[10:-10, 10:-10].mean() for _, z, n in frames[2:]])
    assert jitter_of(frames, TemporalConfig()) < 0.75 * raw
    assert jitter_of(frames, TemporalConfig(enabled=False)) == pytest.approx(raw, rel=0.01)


def test_cut_and_resize_reset_the_stabiliser():
    s = temporal.Stabilizer(TemporalConfig())
    s.step(np.full((8, 8), 50.0), np.full((8, 8), 1.0))
    out = s.step(np.full((8, 8), 220.0), np.full((8, 8), 8.0))
    assert (out["depth"] == 8.0).all() and out["in_shot"] == 0
    assert s.step(np.full((6, 6), 220.0), np.full((6, 6), 2.0))["in_shot"] == 0


def test_packed_fold_equals_plain_loop(spark):
    px = V.generated_video(spark, "/root/testdata/sf0.001").where("video < 2")
    frames = temporal.packed(px, ["video", "frame"]).withColumn("shot", F.lit(1)).withColumn("video", F.col("video").cast("long"))
    got = {(r.video, r.frame): r.depth for r in temporal.stabilize(frames, TemporalConfig(min_shared=50)).collect()}
    for v in (0, 1):
        s = temporal.Stabilizer(TemporalConfig(min_shared=50))
        for r in frames.where(F.col("video") == v).orderBy("frame").collect():
            want = s.step(np.array(r.luma).reshape(r.h, r.w), np.array(r.z).reshape(r.h, r.w))["depth"].ravel()
            assert np.allclose(got[v, r.frame], want)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(v, f, float((v * 31 + f * 17) % 23)) for v in range(5) for f in range(40)]
    table = spark.createDataFrame(rows, "video long, frame long, value double")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for part in range(4):
        table.where(F.floor(F.col("frame") / 10) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = smooth_stream(stream, 0.1).writeStream.format("memory").queryName("smooth").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r.video, r.frame): r.smoothed for r in spark.table("smooth").collect()}
    want = {(r.video, r.frame): r.smoothed for r in smooth_stream(table, 0.1).collect()}
    assert len(want) == 200 and got == pytest.approx(want)


def test_late_frames_are_given_out(spark, tmp_path):
    from parallaxis.streaming.processors import stabilize_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    values = spark.createDataFrame([(0, f, 1.0) for f in (0, 1, 2)], "video long, frame long, value double")
    images = spark.createDataFrame([(0, f, 2, 2, [90.0] * 4, [1.0 + f] * 4) for f in (0, 1)], "video long, frame long, h int, w int, luma array<double>, z array<double>")
    for name, table, make in (("values", values, lambda s: smooth_stream(s, 0.5)), ("images", images, lambda s: stabilize_stream(s, TemporalConfig()))):
        for frames in ("frame < 9", "frame = 1"):
            table.where(frames).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
        q = make(stream).writeStream.format("memory").queryName(f"late_{name}").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck_{name}").trigger(availableNow=True).start()
        q.awaitTermination(180)
        rows = spark.table(f"late_{name}").collect()
        assert sorted((r.frame, r.late) for r in rows) == sorted([(r.frame, False) for r in table.collect()] + [(1, True)])
        assert all((r.late and r[2] is None) or (not r.late and r[2] is not None) for r in rows)


def test_cuts_keep_their_distance(spark):
    scores = spark.createDataFrame([(0, f, 0.9) for f in range(7)], "video long, frame long, score double")
    assert [r.is_cut for r in spaced_cuts(scores, 0.35, 3).orderBy("frame").collect()] == [True, False, False, True, False, False, True]


def test_commit_is_all_or_nothing(spark, tmp_path):
    df, path = spark.range(10), f"{tmp_path}/table"
    with pytest.raises(CommitError):
        commit(df, path, {"rows": exact_rows(11)})
    assert list(tmp_path.iterdir()) == []
    commit(df, path, {"rows": exact_rows(10), "frames": frames_complete(["id"], 10)})
    with pytest.raises(CommitError):
        commit(spark.range(5), path, {})
    with pytest.raises(CommitError):
        commit(spark.range(5), path, {"rows": exact_rows(6)}, overwrite=True)
    assert spark.read.parquet(path).count() == 10
    commit(spark.range(5), path, {"rows": exact_rows(5)}, overwrite=True)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["table"]


def test_raw_frames_and_providers(spark, tmp_path):
    raw = np.arange(3 * 4 * 6 * 3, dtype=np.uint8)
    (tmp_path / "clip.rgb").write_bytes(raw.tobytes())
    packed = files.raw_frames(spark, f"{tmp_path}/clip.rgb", 6, 4)
    assert packed.count() == 3
    px = {(r.frame, r.y, r.x): (r.r, r.g, r.b) for r in V.explode_rgb(packed, 6).collect()}
    want = raw.reshape(3, 4, 6, 3)
    assert all(px[f, y, x] == tuple(want[f, y, x]) for f in range(3) for y in range(4) for x in range(6))
    frames = packed.select(F.lit(0).cast("long").alias("video"), "frame", F.lit(4).alias("h"), F.lit(6).alias("w"), F.col("data").alias("rgb"))
    for provider in (Ramp(), FromLuma()):
        assert all(len(r.depth) == 24 and min(r.depth) > 0 for r in predict_depth(frames, provider).collect())


def test_messages_and_catalog_files(spark, tmp_path):
    lines = [json.dumps({"type": "progress", "job_id": "j", "current_frame": 3}), "not a message", "{}", json.dumps({"type": "completed", "job_id": "j"})]
    got = V.job_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.type for r in got.collect()] == ["progress", "completed"]
    (tmp_path / "c.json").write_text(json.dumps({"models": [{"id": "a", "files": {"w": {"bytes": 5, "sha256": "x"}, "c": {"bytes": 2, "sha256": "y"}}}]}, indent=1))
    total = V.json_catalog(spark, f"{tmp_path}/c.json").select(F.aggregate(F.map_values("files"), F.lit(0).cast("long"), lambda s, v: s + v["bytes"]).alias("n"))
    assert total.first().n == 7


def test_stabiliser_stream_equals_batch(spark, tmp_path):
    from parallaxis.streaming.processors import stabilize_stream

    cfg = TemporalConfig(min_shared=50)
    px = V.generated_video(spark, "/root/testdata/sf0.001").where("video < 2 AND frame < 4")
    frames = temporal.packed(px, ["video", "frame"]).select(F.col("video").cast("long").alias("video"), F.col("frame").cast("long").alias("frame"), "h", "w", "luma", "z")
    for part in range(2):
        frames.where(F.floor(F.col("frame") / 2) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stabilize_stream(stream, cfg).writeStream.format("memory").queryName("stable").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r.video, r.frame): r.depth for r in spark.table("stable").collect()}
    want = {(r.video, r.frame): r.depth for r in temporal.stabilize(frames.withColumn("shot", F.lit(1)), cfg).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_report_files(spark, tmp_path):
    from parallaxis.operators import metrics as M

    kinds = ", ".join(f"{c} {'int' if c in ('frame_index', 'queue_depth') else 'double'}" for c in M.REPORT)
    rows = spark.createDataFrame([(0, 1.5, 2.25, 0.5, 0.25, 0.1, 2.0, 0.1, 3, 0.0), (1, 1.5, 1.75, 1.5, 1.25, 0.1, 1.5, 0.1, 3, 0.0)], kinds)
    M.write_report(rows.coalesce(1), f"{tmp_path}/csv")
    (part,) = tmp_path.joinpath("csv").glob("part-*.csv")
    assert part.read_text().split()[:2] == [",".join(M.REPORT), "0,1.5000,2.2500,0.5000,0.2500,0.1000,2.0000,0.1000,3,0.0000"]
    M.write_report_json(rows.coalesce(1), f"{tmp_path}/json")
    (part,) = tmp_path.joinpath("json").glob("part-*.json")
    assert json.loads(part.read_text().splitlines()[0])["kernel_ms"] == 2.25
    means = M.stage_averages(rows.withColumn("job", F.lit(1)), ["job"]).first()
    assert means.avg_kernel_ms == 2.0 and means.avg_decode_wait_ms == 1.0 and not means.io_bound
    jobs = spark.createDataFrame([("cpu", "a.mp4", 2, 2, 0.5, 4.0, 2.25, ["slow disk"]), ("cpu", "b.mp4", 2, 2, 0.5, 4.0, 2.25, [])], "backend string, output string, frames_in int, frames_out int, elapsed_s double, avg_fps double, p95_kernel_ms double, warnings array<string>")
    first, second = (r.report for r in M.benchmark_markdown(jobs).orderBy("output").collect())
    assert first.splitlines() == ["# Benchmark Report", "", "- Backend: `cpu`", "- Output: `a.mp4`", "- Frames in: `2`", "- Frames out: `2`", "- Elapsed s: `0.5000`", "- Avg FPS: `4.0000`", "- p95 kernel ms: `2.2500`", "", "## Warnings", "- slow disk"]
    assert second.splitlines()[-1] == "- none" and second.endswith("\n")


def test_a_change_of_size_cuts_twice(spark):
    small, large = np.full((6, 8), 90), np.full((8, 8), 90)
    small[:, ::2], large[:, ::2] = 150, 150
    cuts = scenes.scene_cuts(video(spark, [small, small, large, large, large]), "video", SceneConfig(thumb_height=4, thumb_width=4)).orderBy("frame").collect()
    assert [r.is_cut for r in cuts] == [True, False, True, True, False]


def test_flow_of_a_large_pair_is_small_in_memory():
    import tracemalloc

    wide = lambda dx, dy: np.clip(128 + 50 * np.sin((np.arange(1920) + dx) / 40) * np.cos((np.arange(1080)[:, None] + dy) / 30) + 40 * np.sin((np.arange(1920) + dx) / 70 + (np.arange(1080)[:, None] + dy) / 50), 0, 255) / 255
    now, was = wide(16, 9), wide(0, 0)
    tracemalloc.start()
    back, ahead = temporal.both_flows(now, was, TemporalConfig())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6
    inner = (slice(None), slice(100, -100), slice(100, -100))
    for flow, sign in ((back, 1), (ahead, -1)):
        assert np.abs(np.median(flow[inner][0]) - 16 * sign) <= 1 and np.abs(np.median(flow[inner][1]) - 9 * sign) <= 1
    assert temporal.estimator_size(1080, 1920, TemporalConfig()) == (240, 240) and temporal.estimator_size(61, 81, TemporalConfig()) == (60, 80)
    assert temporal.estimator_size(1080, 1920, TemporalConfig.compatible()) == (540, 960) and temporal.estimator_size(40, 50, TemporalConfig.compatible()) == (32, 32)


def test_areas_touched():
    a = np.random.default_rng(1).random((7, 10))
    got = temporal.shrunk(a, 3, 4)
    want = [[a[y * 7 // 3 : -(-(y + 1) * 7 // 3), x * 10 // 4 : -(-(x + 1) * 10 // 4)].mean() for x in range(4)] for y in range(3)]
    assert np.allclose(got, want) and np.array_equal(temporal.shrunk(a, 7, 10), a)


def test_search_takes_the_first_of_equals_and_averages_when_asked():
    flat = np.full((8, 9), 0.5)
    dx, dy = temporal.search(flat, flat, 2, 3)
    assert (dx == -2).all() and (dy == -2).all()
    dx, dy = temporal.search(flat, flat, 2, 3, 0.005)
    assert np.allclose(dx, 0) and np.allclose(dy, 0)
    now, was = texture(60, 80, 0.5) / 255, texture(60, 80) / 255
    flow = temporal.block_flow(now, was, TemporalConfig(subpixel=True))
    assert abs(np.median(flow[0][10:-10, 10:-10]) - 0.5) < 0.4


def test_kernel_and_relation_find_the_same_flow(spark):
    from parallaxis.operators import flow as relation

    h, w = 12, 16
    images = [np.floor(texture(h, w, 2 * k, k)) for k in range(2)]
    table = lambda im: spark.createDataFrame([(0, y, x, float(im[y, x])) for y in range(h) for x in range(w)], "f int, y int, x int, luma double")
    got = {(r.y, r.x): (r.dx, r.dy) for r in relation.block_flow(table(images[1]), table(images[0]), ["f"], h, w, TemporalConfig()).collect()}
    want = temporal.block_flow(images[1], images[0], TemporalConfig())
    assert got == {(y, x): (want[0, y, x], want[1, y, x]) for y in range(h) for x in range(w)}


@pytest.mark.parametrize("smooth", [True, False])
def test_edges_of_kernel_and_relation(spark, smooth):
    from parallaxis.operators.geometry import depth_edges

    z = 1 + np.random.default_rng(6).random((5, 6))
    table = spark.createDataFrame([(0, y, x, float(z[y, x])) for y in range(5) for x in range(6)], "f int, y int, x int, z double")
    got = {(r.y, r.x): r.edge for r in depth_edges(table, ["f"], 5, 6, 0.6, smooth).collect()}
    want = temporal.depth_edges(z, 0.6, smooth)
    assert got == {(y, x): bool(want[y, x]) for y in range(5) for x in range(6)} and 0 < want.sum() < 30


def test_variants_of_the_stabiliser():
    luma, _, noisy = zip(*moving(0.08, n=3), strict=True)
    run = lambda cfg: [held.step(y, z) for held in [temporal.Stabilizer(cfg)] for y, z in zip(luma, noisy, strict=True)]
    first, plain, _ = run(TemporalConfig())
    assert (first["confidence"] == 1).all() and first["valid_fraction"] == 0 and first["is_cut"] and not plain["is_cut"]
    assert plain["confidence"].min() >= 0 and 0 < plain["confidence"].mean() < 1 and plain["scale"] != 1
    assert run(TemporalConfig(align_scale=False))[1]["scale"] == 1
    assert run(TemporalConfig(enabled=False))[1]["valid_fraction"] == 1
    other = run(TemporalConfig.compatible())[1]
    assert other["confidence"].mean() < plain["confidence"].mean()  # raw edges from a lower limit on
    step = np.where(np.arange(20) < 10, 1.0, 3.0) * np.ones((20, 1))
    assert temporal.depth_edges(step, 0.15, smooth=False)[0, 9:11].all() and not temporal.depth_edges(step, 0.15, smooth=False)[:, :8].any()
    assert temporal.depth_edges(np.ones((5, 5)), 0.2).any() and not temporal.depth_edges(np.ones((5, 5)), 0.2, smooth=False).any()
    s = temporal.Stabilizer(TemporalConfig.compatible())
    for value in (50.0, 220.0, 1.0):  # neither cuts nor fades of its own
        assert s.step(np.full((40, 40), value), np.ones((40, 40)))["in_shot"] == (50.0, 220.0, 1.0).index(value)
    box = temporal.Stabilizer(TemporalConfig()).step(np.full((4, 4), 90.0), np.arange(1.0, 17.0).reshape(4, 4), box=(0, 1, 0, 4))
    assert box["high"] <= 1.0 and box["low"] >= 0.25
    with pytest.raises(ValueError):
        TemporalConfig(max_estimator=16)


def test_cut_stream_equals_batch_and_reports_late_frames(spark, tmp_path):
    from parallaxis.operators.cuts import detect_cuts
    from parallaxis.streaming.processors import cut_stream

    rng = np.random.default_rng(4)
    rows = []
    for v in range(3):
        scene = rng.integers(0, 255, (9, 12, 3))
        for f in range(24):
            h = 10 if v == 1 and 8 <= f < 14 else 9
            if f % 5 == 0:
                scene = rng.integers(0, 255, (9, 12, 3))
            px = np.zeros((h, 12, 3), np.uint8)
            px[2:8] = scene[2:8] if f not in (11, 12) else 1
            rows.append((v, f, h, 12, bytearray(px.tobytes())))
    table = spark.createDataFrame(rows, "video long, frame long, h int, w int, rgb binary")
    cfg = SceneConfig(thumb_height=4, thumb_width=6, cut_threshold=0.05, min_scene_frames=7)
    key = lambda r: (r.video, r.frame, round(r.score, 9), r.is_fade, r.is_cut, r.shot, r.ymin, r.ymax, r.xmin, r.xmax)
    want = sorted(key(r) for r in detect_cuts(table, cfg).collect())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for part in range(3):
        table.where(F.floor(F.col("frame") / 8) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table.where("video = 2 and frame = 3").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = cut_stream(stream, cfg).writeStream.format("memory").queryName("cuts").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = spark.table("cuts").collect()
    assert sorted(key(r) for r in got if not r.late) == want
    assert [(r.video, r.frame, r.score, r.is_cut) for r in got if r.late] == [(2, 3, None, None)]
    cuts = [r[1] for r in want if r[0] == 0 and r[4]]
    assert cuts[:2] == [0, 10] and {11, 13} <= set(cuts)  # spaced by content, forced by fades
