"""Data sources and sinks in Python, and tables that are replaced by a pointer."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.sources import files


def names(folder):
    return sorted(os.path.join(r, f) for r, _, fs in os.walk(folder) for f in fs)


def test_raw_frames_are_read_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(2)
    clips = {name: rng.integers(0, 256, (n, 6 * 4 * 3 // 2), np.uint8) for name, n in (("a.raw", 7), ("b.raw", 1), ("empty.raw", 0))}
    for name, px in clips.items():
        (tmp_path / name).write_bytes(px.tobytes())
    (tmp_path / "_ignored").write_bytes(b"x")
    reader = files.register(spark).read.format("raw_frames").options(width=6, height=4, layout="nv12", partitionBytes=100)
    df = reader.load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4 + 1  # two frames of 36 bytes in a range
    got = {(os.path.basename(r.path), r.frame, r.plane): (r.height, r.width, bytes(r.data)) for r in df.collect()}
    want = {}
    for name, px in clips.items():
        for k, raw in enumerate(px):
            want[name, k, "y"] = (4, 6, raw[:24].tobytes())
            want[name, k, "uv"] = (2, 3, raw[24:].tobytes())
    assert got == want
    px = {(os.path.basename(r.path), r.frame, r.y, r.x): (r.luma, r.u, r.v) for r in files.nv12_pixels(df).collect()}
    assert len(px) == 8 * 24
    for (name, k, y, x), value in px.items():
        raw = clips[name][k]
        uv = raw[24:].reshape(2, 3, 2)[y // 2, x // 2]
        assert value == (raw[y * 6 + x], uv[0], uv[1])


def test_raw_frames_have_typed_options_and_whole_frames(spark, tmp_path):
    (tmp_path / "cut.raw").write_bytes(bytes(50))
    load = lambda **o: files.register(spark).read.format("raw_frames").options(**o).load(str(tmp_path)).collect()
    for options, said in (({"width": 4, "height": 4}, "ends within a frame"), ({"width": "four", "height": 4}, "positive integer"), ({"height": 4}, "width"), ({"width": 4, "height": 4, "layout": "yuv9"}, "layout"), ({"width": 5, "height": 4, "layout": "nv12"}, "even")):
        with pytest.raises(Exception, match=said):
            load(**options)


def test_raw_frames_round_trip(spark, tmp_path):
    frames = spark.createDataFrame([(k, bytearray([k] * 12)) for k in range(5)], "frame long, data binary").repartition(3)
    write = lambda df: files.register(spark) and df.write.format("raw_frames").options(path=str(tmp_path), width=2, height=2).mode("append").save()
    write(frames)
    write(frames.where("frame < 2"))
    got = sorted(bytes(r.data)[0] for r in files.raw_frames(spark, str(tmp_path), 2, 2).collect())
    assert got == [0, 0, 1, 1, 2, 3, 4]
    before = names(tmp_path)
    with pytest.raises(Exception, match="12 bytes"):
        write(spark.createDataFrame([(0, bytearray(12)), (1, bytearray(11))], "frame long, data binary").coalesce(1))
    with pytest.raises(Exception, match="append"):
        frames.write.format("raw_frames").options(path=str(tmp_path), width=2, height=2).mode("overwrite").save()
    assert names(tmp_path) == before and not [d for d in os.listdir(tmp_path) if d.startswith(".")]


DEPTH = "video long, frame long, h int, w int, depth array<double>"


def test_depth_files_round_trip(spark, tmp_path):
    from parallaxis.sources.frames import images

    rng = np.random.default_rng(3)
    maps = {(v, f): 1 + rng.random((3, 4)) for v in range(2) for f in range(3)}
    maps[5, 0] = np.full((2, 2), 7.5)
    rows = [(v, f, *z.shape, z.ravel().tolist()) for (v, f), z in maps.items()]
    files.register(spark)
    spark.createDataFrame(rows, DEPTH).repartition(3).write.format("depth_files").option("path", str(tmp_path)).mode("append").save()
    got = {(r.video, r.frame): r for r in spark.read.format("depth_files").load(str(tmp_path)).collect()}
    assert set(got) == set(maps)
    for key, z in maps.items():
        r = got[key]
        assert np.array_equal(np.reshape(r.depth, (r.h, r.w)), z) and (r.min_depth, r.max_depth) == (z.min(), z.max())
    (color,) = [p for p in names(tmp_path) if p.endswith("depth_5_0_color.png")]
    (read,) = images(spark, color).collect()
    assert (read.height, read.width, read.problem) == (2, 2, None) and bytes(read.data) == bytes(files.ANCHORS[0]) * 4
    assert len(names(tmp_path)) == 4 * len(maps)
    (facts,) = [p for p in names(tmp_path) if p.endswith("depth_1_2_metrics.json")]
    assert json.load(open(facts))["shape"] == [3, 4]
    assert files.stretched(np.array([[1.0, 2.0, 3.0]]), 65535).tolist() == [[0, 32767, 65535]]
    near = files.coloured(np.array([[1.0, 2.0]]))
    assert near[0, 1].tolist() == list(files.ANCHORS[-1])


def test_a_failed_job_leaves_no_depth_file(spark, tmp_path):
    files.register(spark)
    good, bad = (0, 0, 1, 2, [1.0, 2.0]), (0, 1, 1, 2, [1.0, float("nan")])
    with pytest.raises(Exception, match="positive, finite"):
        spark.createDataFrame([good, bad], DEPTH).repartition(2, "frame").write.format("depth_files").option("path", f"{tmp_path}/out").mode("append").save()
    assert names(tmp_path) == [] and not os.listdir(f"{tmp_path}/out")


def test_planes_become_pixels(spark, tmp_path):
    px = np.random.default_rng(5).integers(0, 256, (2, 40, 700, 3), np.uint8)
    (tmp_path / "clip").write_bytes(px.tobytes())
    planes = files.raw_frames(spark, f"{tmp_path}/clip", 700, 40)
    rows = files.plane_pixels(planes).where("frame = 1 and c = 2").groupBy("y").agg(F.sum(F.col("value") * F.col("x")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert {(r.y, r.s, r.n) for r in rows} == {(y, int((px[1, y, :, 2].astype(int) * np.arange(700)).sum()), 700) for y in range(40)}


def test_of_two_writers_one_wins(spark, tmp_path):
    from parallaxis.plans.commit import CommitError, exact_rows
    from parallaxis.plans.versions import VersionedTable

    table = VersionedTable(spark, f"{tmp_path}/t")
    assert table.version() is None
    with pytest.raises(CommitError):
        table.read()
    with pytest.raises(CommitError, match="rows"):
        table.replace(spark.range(3), {"rows": exact_rows(4)})
    assert table.version() is None and not [n for n in os.listdir(f"{tmp_path}/t") if n.startswith("data")]
    assert table.replace(spark.range(3), {"rows": exact_rows(3)}) == 0
    with pytest.raises(CommitError):
        table.replace(spark.range(1))  # there is a first version already
    reader = table.read()
    other = VersionedTable(spark, f"{tmp_path}/t")

    class Late:  # the other writer commits while this one's table is being checked
        def __call__(self, written):
            assert other.replace(spark.range(7), snapshot=0) == 1
            return True

    with pytest.raises(CommitError, match="another writer"):
        table.replace(spark.range(5), {"late": Late()}, snapshot=0)
    assert table.version() == 1 and table.read().count() == 7 and reader.count() == 3 and table.read(0).count() == 3
    assert len([n for n in os.listdir(f"{tmp_path}/t") if n.startswith("data")]) == 2
    assert table.replace(spark.range(9).select((F.col("id") * 2).alias("twice")), snapshot=1) == 2 and table.read().columns == ["twice"]
    table.expire(keep=1)
    assert table.versions() == [2] and table.read().count() == 9 and len([n for n in os.listdir(f"{tmp_path}/t") if n.startswith("data")]) == 1
    with pytest.raises(ValueError):
        table.expire(0)


class Counting:
    """Depth from luma that notes the size of each call."""

    normalized = False

    def __init__(self, folder):
        self.folder = folder

    def predict_batch(self, images):
        with open(f"{self.folder}/calls", "a") as f:
            f.write(f"{len(images)}x{images.shape[1]}x{images.shape[2]} ")
        return 5.0 - images.mean(axis=-1) / 100.0


def test_providers_get_batches_of_one_size(spark, tmp_path):
    from parallaxis.operators.providers import Ramp, model_sizes, padded, predict_depth

    rng = np.random.default_rng(7)
    rows = [(0, f, h, w, bytearray(rng.integers(0, 256, h * w * 3, np.uint8).tobytes())) for f, (h, w) in enumerate([(8, 10)] * 12 + [(6, 6)] * 3)]
    frames = spark.createDataFrame(rows, "video long, frame long, h int, w int, rgb binary").coalesce(1)
    folder = str(tmp_path)
    run = lambda **o: {r.frame: (r.h, r.w, r.processed_h, r.processed_w, tuple(round(z, 9) for z in r.depth)) for r in predict_depth(frames, lambda: Counting(folder), **o).collect()}
    calls = lambda: sorted(open(f"{folder}/calls").read().split())
    one = run(batch=1, scale="1/2")
    assert calls() == ["1x14x14"] * 15
    os.remove(f"{folder}/calls")
    five = run(batch=5, scale="1/2")
    assert five == one and all(v[:4] == ((8, 10, 14, 14) if f < 12 else (6, 6, 14, 14)) for f, v in five.items())
    assert sorted(calls()) == ["2x14x14", "3x14x14", "5x14x14", "5x14x14"]
    small = run(batch=20, scale=0.5, original_size=False)
    assert {v[:2] for v in small.values()} == {(4, 5), (3, 3)}
    plain = run(batch=4)
    want = 5.0 - np.frombuffer(bytes(rows[0][4]), np.uint8).reshape(8, 10, 3).mean(axis=-1) / 100
    assert np.allclose(np.reshape(plain[0][4], (8, 10)), want)
    assert model_sizes(1080, 1920, 504, None)[0] == (280, 504) and model_sizes(10, 2000, 504, None)[0] == (14, 504) and model_sizes(1080, 1920, None, 0.5) == ((540, 960), (546, 966))
    assert padded(np.arange(6.0).reshape(2, 3), 3, 8).tolist() == [[0, 1, 2, 2, 2, 2, 2, 2], [3, 4, 5, 5, 5, 5, 5, 5], [0, 1, 2, 2, 2, 2, 2, 2]]
    for wrong in (0, 21, True):
        with pytest.raises(ValueError):
            predict_depth(frames, Ramp(), batch=wrong)

    class Bad:
        normalized = True

        def predict_batch(self, images):
            assert images.min() < 0
            return -np.ones(images.shape[:3])

    with pytest.raises(Exception, match="positive and finite"):
        predict_depth(frames, Bad).collect()
    assert {r.max_depth for r in predict_depth(frames, Bad, positive=True).collect()} == {1e-6}


def test_unusable_images_are_set_aside(spark):
    from parallaxis.operators.images import usable_images

    rows = [
        (0, [3, 2, 2], "float32", [float(k) for k in range(12)]), (1, [2, 2, 3], "uint8", [float(k) for k in range(12)]), (2, [2, 2, 3], "float32", [1.0] * 11 + [float("inf")]), (3, [2, 2, 3], "float32", None),
        (4, None, "float32", [1.0]), (5, [2, 6], "uint8", [0.0] * 12), (6, [2, 2, 4], "uint8", [0.0] * 16), (7, [2, 2, 3], None, [0.0] * 12), (8, [2, 2, 3], "float32", [1.0] * 11 + [None]), (9, [3, 3, 3], "float64", [float(k) for k in range(27)]),
    ]
    good, bad = usable_images(spark.createDataFrame(rows, "frame int, shape array<int>, type string, values array<double>"))
    planes = {r.frame: (r.h, r.w, r.planes) for r in good.collect()}
    assert planes[0] == (2, 2, [float(k) for k in range(12)]) and planes[9][2] == [float(k) for k in range(27)]
    assert planes[1] == (2, 2, [k / 255 for k in (0, 3, 6, 9, 1, 4, 7, 10, 2, 5, 8, 11)])
    assert {r.frame: r.problem for r in bad.collect()} == {2: "not finite", 3: "not of its size", 4: "not three axes", 5: "not three axes", 6: "not three channels", 7: "unknown type", 8: "not finite"}
    assert len(planes) + bad.count() == len(rows)
