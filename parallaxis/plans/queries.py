"""The registered queries: an operator applied to a view of the test tables, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallaxis.config import DisparityConfig, FillConfig, HeuristicConfig, SceneConfig, SplatConfig, TemporalConfig
from parallaxis.functions import numeric
from parallaxis.operators import cuts, depth, fill, flow, geometry, heuristic, images, media, metrics, providers, render, scenes, splat, temporal
from parallaxis.plans import catalog_queries, report_queries  # noqa: F401  (they register their queries)
from parallaxis.plans import sql as S
from parallaxis.plans.registry import ORACLES, QUERIES, query, real, whole  # noqa: F401
from parallaxis.sources import files
from parallaxis.sources import frames as V

#: Settings under which frames of one row of 64 pixels show occlusion and holes.
D = DisparityConfig(strength=0.30)
S_CFG, FILL = SplatConfig(), FillConfig(max_hole_width=2)
GATED = FillConfig(max_hole_width=2, fill_large=False)
HALF_EVEN, HALF_UP = HeuristicConfig(strength=0.6, max_pixels=4), HeuristicConfig(strength=0.6, max_pixels=4, half_up=True)
SCENE = SceneConfig(fade_threshold=20.0, thumb_height=6, thumb_width=8)
TEMPORAL = TemporalConfig(min_shared=50)


# -- depth, splat, fill, render ---------------------------------------------------------------


def _frames(spark, sf):
    """Rows of pixels, dealt into as many tasks as they ask for."""
    return V.pixel_rows(spark, sf, V.pixel_partitions(spark, sf))


@query(S.with_(S.PX, "SELECT frame, count(*) AS n, CAST(sum(CASE WHEN z > 0 AND NOT isnan(z) AND z < 'inf'::DOUBLE THEN 0 ELSE 1 END) AS BIGINT) AS bad, bool_and(z > 0 AND NOT isnan(z) AND z < 'inf'::DOUBLE) AS valid FROM px GROUP BY frame"))
def depth_validation(spark, sf):
    return depth.validate_depth(V.pixel_rows(spark, sf), ["frame"]).select("frame", *whole("n", "bad"), "valid")


@query("SELECT user_id AS video, count(*) AS n, CAST(sum(CASE WHEN value > 0 AND NOT isnan(value) THEN 0 ELSE 1 END) AS BIGINT) AS bad, bool_and(value > 0 AND NOT isnan(value)) AS valid FROM events GROUP BY user_id")
def signal_validation(spark, sf):
    rows = V.table(spark, sf, "events").withColumnRenamed("user_id", "video")
    return depth.validate_depth(rows, ["video"], "value").select("video", *whole("n", "bad"), "valid")


#: Depths that cannot be used, planted by frame.
_BAD = "bad AS (SELECT frame, x, CASE WHEN frame % 5 = 1 AND x = 3 THEN 0.0::DOUBLE WHEN frame % 5 = 2 AND x = 7 THEN 'nan'::DOUBLE WHEN frame % 5 = 3 AND x IN (0, 9) THEN CASE WHEN x = 0 THEN -1.0::DOUBLE ELSE 'inf'::DOUBLE END ELSE z END AS z FROM px)"


def _bad(spark, sf, partitions=None):
    k, x = F.col("frame") % 5, F.col("x")
    z = F.when((k == 1) & (x == 3), 0.0).when((k == 2) & (x == 7), float("nan")).when((k == 3) & (x == 0), -1.0).when((k == 3) & (x == 9), float("inf")).otherwise(F.col("z"))
    return V.pixel_rows(spark, sf, partitions).withColumn("z", z)


@query(S.with_(S.PX, _BAD, "SELECT frame, count(*) AS n, CASE WHEN NOT bool_and(NOT isnan(z) AND NOT isinf(z)) THEN 'non-finite' WHEN NOT bool_and(z > 0) THEN 'non-positive' END AS reason FROM bad GROUP BY frame"))
def frame_rejections(spark, sf):
    return depth.rejections(_bad(spark, sf), ["frame"]).select("frame", *whole("n"), "reason")


@query(S.with_(S.PX, _BAD, "ok AS (SELECT frame FROM bad GROUP BY frame HAVING bool_and(NOT isnan(z) AND NOT isinf(z) AND z > 0)), px_ AS (SELECT px.* FROM px JOIN ok USING (frame))", S.BOUNDS.replace("FROM px ", "FROM px_ "), S.DISPARITY.replace("FROM px ", "FROM px_ px "), "SELECT frame, count(*) AS n, round(min(disparity), 6) AS low, round(max(disparity), 6) AS high FROM d GROUP BY frame"))
def disparity_of_usable_frames(spark, sf):
    """Frames with any depth that cannot be used have no disparity at all."""
    d = depth.disparity(_bad(spark, sf, V.pixel_partitions(spark, sf)), ["frame"], D)
    return d.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.min("disparity").alias("low"), F.max("disparity").alias("high")).select("frame", *whole("n"), *real("low", "high"))


@query(S.with_(S.PX, S.BOUNDS, "SELECT frame, round(q_low, 6) AS q_low, round(q_high, 6) AS q_high FROM b"))
def disparity_bounds(spark, sf):
    return depth.robust_bounds(V.pixel_rows(spark, sf), ["frame"], D).select("frame", *real("q_low", "q_high"))


@query(S.with_(S.PX, S.BOUNDS, S.DISPARITY, "SELECT frame, CAST(x AS BIGINT) AS x, round(q, 6) AS q, round(disparity, 6) AS disparity, round(disparity / 2, 6) AS shift_left, round(-disparity / 2, 6) AS shift_right FROM d"))
def disparity_map(spark, sf):
    return depth.disparity(_frames(spark, sf), ["frame"], D).select("frame", *whole("x"), *real("q", "disparity", "shift_left", "shift_right"))


@query(S.with_(S.PX, "b AS (SELECT frame, min(1.0 / z) AS lo, max(1.0 / z) AS hi FROM px GROUP BY frame) SELECT frame, CAST(x AS BIGINT) AS x, round(CASE WHEN hi - lo <= 1e-7 THEN 0.6 ELSE greatest(0.0, least(1.0, (1.0 / z - lo) / (hi - lo))) END, 6) AS q, 0.0::DOUBLE AS disparity FROM px JOIN b USING (frame)", raw=True))
def disparity_zero_strength(spark, sf):
    return depth.disparity(_frames(spark, sf), ["frame"], DisparityConfig(strength=0.0)).select("frame", *whole("x"), *real("q", "disparity"))


@query(S.with_(S.PX, "SELECT frame, CAST(x AS BIGINT) AS x, round(greatest(-3.2, least(3.2, 0.3 * 64 * (greatest(0.0, least(1.0, (1.0 / z - 0.4) / 0.25)) - 0.6))), 6) AS disparity FROM px"))
def disparity_fixed_bounds(spark, sf):
    return depth.disparity(_frames(spark, sf), ["frame"], DisparityConfig(strength=0.30, bounds=(0.4, 0.65))).select("frame", *whole("x"), *real("disparity"))


@query(S.with_(S.PX, S.BOUNDS, S.DISPARITY, "SELECT frame, round(min(disparity), 6) AS low, round(max(disparity), 6) AS high, round(avg(disparity), 6) AS mean FROM d GROUP BY frame"))
def disparity_summary(spark, sf):
    return depth.summary(depth.disparity(_frames(spark, sf), ["frame"], D), ["frame"], "disparity").select("frame", *real("low", "high", "mean"))


def _eyes(spark, sf, partitions):
    moved = depth.disparity(V.pixel_rows(spark, sf, partitions), ["frame"], D).withColumn("eye", F.explode(F.array(F.lit(0), F.lit(1))))
    return moved.withColumn("shift", F.when(F.col("eye") == 0, F.col("shift_left")).otherwise(F.col("shift_right")))


@query(S.with_(S.PX, S.BOUNDS, S.DISPARITY, S.LANDED, "SELECT frame, CAST(eye AS BIGINT) AS eye, CAST(xt AS BIGINT) AS xt, round(min(z), 6) AS z_near FROM landed GROUP BY frame, eye, xt"))
def splat_zbuffer(spark, sf):
    eyes = _eyes(spark, sf, V.pixel_partitions(spark, sf))
    return splat.z_buffer(splat.contributions(eyes, ["frame", "eye"], "shift", S_CFG), ["frame", "eye"]).select("frame", *whole("eye", "xt"), *real("z_near"))


@query(S.with_(S.PX, S.BOUNDS, S.DISPARITY, S.LANDED, S.BLEND, "SELECT frame, CAST(eye AS BIGINT) AS eye, CAST(xt AS BIGINT) AS xt, round(weight, 6) AS weight, round(depth, 6) AS depth, round(g, 6) AS g FROM blend"))
def splat_blend(spark, sf):
    keys, n = ["frame", "eye"], V.pixel_partitions(spark, sf)
    return splat.blend(splat.contributions(_eyes(spark, sf, n), keys, "shift", S_CFG), keys, ["g"], S_CFG, n).select("frame", *whole("eye", "xt"), *real("weight", "depth", "g"))


def stereo_row_splat(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: rows of pixels moved for the left eye, with depth, weight and colour."""
    keys, n = ["frame"], V.pixel_partitions(spark, sf)
    moved = depth.disparity(V.pixel_rows(spark, sf, n), keys, D)
    return splat.blend(splat.contributions(moved, keys, "shift_left", S_CFG), keys, ["g"], S_CFG, n).select("frame", *whole("xt"), *real("weight", "depth", "g"))


query(S.with_(S.PX, S.BOUNDS, S.DISPARITY, S.LANDED, S.BLEND, "SELECT frame, CAST(xt AS BIGINT) AS xt, round(weight, 6) AS weight, round(depth, 6) AS depth, round(g, 6) AS g FROM blend WHERE eye = 0"))(stereo_row_splat)


def _splatted(spark, sf):
    n = V.pixel_partitions(spark, sf)
    return splat.forward_splat(_eyes(spark, sf, n), ["frame", "eye"], "shift", ["g"], S_CFG, n)


@query(S.with_(S.PX, S.BOUNDS, S.DISPARITY, S.LANDED, S.BLEND, S.GRID, "SELECT frame, CAST(eye AS BIGINT) AS eye, CAST(sum(CASE WHEN covered THEN 1 ELSE 0 END) AS BIGINT) AS covered, CAST(sum(CASE WHEN covered THEN 0 ELSE 1 END) AS BIGINT) AS holes FROM grid GROUP BY frame, eye"))
def splat_coverage(spark, sf):
    return _splatted(spark, sf).groupBy("frame", "eye").agg(F.count_if("covered").alias("covered"), F.count_if(~F.col("covered")).alias("holes")).select("frame", *whole("eye", "covered", "holes"))


@query(S.with_(S.PX, S.BOUNDS, S.DISPARITY, S.LANDED, S.BLEND, S.GRID, S.EDGES, "SELECT frame, CAST(eye AS BIGINT) AS eye, CAST(x AS BIGINT) AS x, CAST(lx AS BIGINT) AS left_x, CAST(rx AS BIGINT) AS right_x, round(lz, 6) AS left_z, round(rz, 6) AS right_z FROM edges WHERE NOT covered"))
def hole_boundaries(spark, sf):
    b = fill.boundaries(_splatted(spark, sf), ["frame", "eye"], ["g"]).where(~F.col("covered"))
    b = b.select("frame", "eye", "x", F.col("left.x").alias("left_x"), F.col("right.x").alias("right_x"), F.col("left.z").alias("left_z"), F.col("right.z").alias("right_z"))
    return b.select("frame", *whole("eye", "x", "left_x", "right_x"), *real("left_z", "right_z"))


def _fill(cfg: FillConfig) -> Query:
    def run(spark, sf):
        f = fill.fill_holes(_splatted(spark, sf), ["frame", "eye"], ["g"], cfg)
        return f.select("frame", *whole("eye", "x"), "filled", "unfilled", *real("depth", "g"))

    return run


def hole_fill(spark, sf):
    return _fill(FILL)(spark, sf)


def hole_fill_gated(spark, sf):
    return _fill(GATED)(spark, sf)


for _q, _gate in ((hole_fill, "TRUE"), (hole_fill_gated, "NOT large")):
    query(S.with_(S.PX, S.BOUNDS, S.DISPARITY, S.LANDED, S.BLEND, S.GRID, S.EDGES, S.WIDTHS, S.filled(_gate), "SELECT frame, CAST(eye AS BIGINT) AS eye, CAST(x AS BIGINT) AS x, filled, NOT covered AND NOT filled AS unfilled, round(CASE WHEN filled THEN fz ELSE depth END, 6) AS depth, round(CASE WHEN filled THEN fg ELSE g END, 6) AS g FROM filled"))(_q)


@query(S.with_(S.PX, S.BOUNDS, S.DISPARITY, S.LANDED, S.BLEND, S.GRID, S.EDGES, S.WIDTHS, "st AS (SELECT *, large AND NOT lag(large, 1, FALSE) OVER (PARTITION BY frame, eye ORDER BY x) AS starts FROM widths) SELECT frame, CAST(eye AS BIGINT) AS eye, CAST(sum(CASE WHEN covered THEN 0 ELSE 1 END) AS BIGINT) AS holes, round(avg(CASE WHEN covered THEN 0.0 ELSE 1.0 END), 6) AS hole_fraction, CAST(max(hole_width) AS BIGINT) AS max_hole_width, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) AS BIGINT) AS large_holes, sum(CASE WHEN starts THEN 1 ELSE 0 END) > 0 AS warns FROM st GROUP BY frame, eye", raw=True))
def hole_diagnostics(spark, sf):
    keys = ["frame", "eye"]
    d = fill.diagnostics(fill.hole_widths(fill.boundaries(_splatted(spark, sf), keys, ["g"]), keys, FILL), keys, FILL)
    return d.select("frame", *whole("eye", "holes"), *real("hole_fraction"), *whole("max_hole_width", "large_holes"), F.col("warning").isNotNull().alias("warns"))


@query(S.with_(S.PX, S.BOUNDS, S.DISPARITY, S.LANDED, S.BLEND, S.GRID, S.EDGES, S.WIDTHS, "SELECT frame, CAST(eye AS BIGINT) AS eye, CAST(min(x) AS BIGINT) AS start_x, CAST(hole_width AS BIGINT) AS hole_width FROM widths WHERE NOT covered GROUP BY frame, eye, coalesce(lx, -1), hole_width"))
def hole_spans(spark, sf):
    keys = ["frame", "eye"]
    w = fill.hole_widths(fill.boundaries(_splatted(spark, sf), keys, ["g"]), keys, FILL).where(~F.col("covered"))
    spans = w.groupBy(*keys, F.coalesce("left.x", F.lit(-1)).alias("after"), "hole_width").agg(F.min("x").alias("start_x"))
    return spans.select("frame", *whole("eye", "start_x", "hole_width"))


_RENDER = (S.PX, S.BOUNDS, S.DISPARITY, S.LANDED, S.BLEND, S.GRID, S.EDGES, S.WIDTHS, S.filled("TRUE"), S.SBS)


def _sbs(spark, sf, partitions):
    eyes = render.render(V.pixel_rows(spark, sf, partitions).withColumn("g", F.col("g") + 0.5), ["frame"], ["g"], D, S_CFG, FILL, partitions)
    return render.side_by_side(eyes, ["frame"], ["g"])


@query(S.with_(*_RENDER, "SELECT frame, CAST(x AS BIGINT) AS x, CAST(g AS BIGINT) AS g FROM sbs"))
def render_sbs(spark, sf):
    return _sbs(spark, sf, V.pixel_partitions(spark, sf)).select("frame", *whole("x", "g"))


@query(S.with_(*_RENDER, "p AS (SELECT l.frame, abs(l.g - r.g) AS e FROM sbs l JOIN sbs r ON l.frame = r.frame AND l.x < 64 AND r.x = l.x + 64) SELECT frame, round(avg(e), 6) AS mean_diff, CAST(max(e) AS BIGINT) AS max_diff, round(avg(CASE WHEN e > 1 THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN e > 1 THEN 1.0 ELSE 0.0 END) > 0.01 AS is_stereo FROM p GROUP BY frame", raw=True))
def eye_difference(spark, sf):
    n = V.pixel_partitions(spark, sf)
    return render.eye_difference(_sbs(spark, sf, n), ["frame"], "g", 64, n).select("frame", *real("mean_diff"), *whole("max_diff"), *real("share"), "is_stereo")


# -- heuristic path, geometry ------------------------------------------------------------------


@query(S.with_(S.PX8, S.heuristic("round_even(s, 0)"), "SELECT frame, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(d AS BIGINT) AS d FROM h"))
def heuristic_disparity(spark, sf):
    return heuristic.heuristic_disparity(V.square_frames(spark, sf), ["frame"], 8, HALF_EVEN).select("frame", *whole("y", "x", "d"))


@query(S.with_(S.PX8, S.heuristic("floor(s + 0.5)"), "SELECT frame, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(d AS BIGINT) AS d FROM h"))
def heuristic_disparity_halfup(spark, sf):
    return heuristic.heuristic_disparity(V.square_frames(spark, sf), ["frame"], 8, HALF_UP).select("frame", *whole("y", "x", "d"))


@query(S.with_(S.PX8, S.heuristic("round_even(s, 0)"), "SELECT h.frame, CAST(h.y AS BIGINT) AS y, CAST(h.x AS BIGINT) AS x, CAST(e.eye AS BIGINT) AS eye, CAST(o.luma AS BIGINT) AS luma FROM h, (VALUES (0), (1)) e(eye), px8 o WHERE o.frame = h.frame AND o.y = h.y AND o.x = CASE WHEN e.eye = 0 THEN greatest(0, h.x - h.d) ELSE least(7, h.x + h.d) END"))
def backward_warp(spark, sf):
    moved = heuristic.heuristic_disparity(V.square_frames(spark, sf), ["frame"], 8, HALF_EVEN)
    return heuristic.backward_warp(moved, ["frame"], 8).select("frame", *whole("y", "x", "eye", "luma"))


@query(S.with_(S.PX8, S.heuristic("round_even(s, 0)"), "c AS (SELECT frame, y // 2 AS y, x // 2 AS x, luma AS u, d // 2 AS d FROM h WHERE y % 2 = 0 AND x % 2 = 0) SELECT c.frame, CAST(c.y AS BIGINT) AS y, CAST(c.x AS BIGINT) AS x, CAST(e.eye AS BIGINT) AS eye, CAST(o.u AS BIGINT) AS u FROM c, (VALUES (0), (1)) e(eye), c o WHERE o.frame = c.frame AND o.y = c.y AND o.x = CASE WHEN e.eye = 0 THEN greatest(0, c.x - c.d) ELSE least(3, c.x + c.d) END", raw=True))
def nv12_chroma_warp(spark, sf):
    moved = heuristic.heuristic_disparity(V.square_frames(spark, sf), ["frame"], 8, HALF_EVEN)
    half = (F.col("y") % 2 == 0) & (F.col("x") % 2 == 0)
    chroma = moved.where(half).select("frame", (F.col("y") / 2).cast("int").alias("y"), (F.col("x") / 2).cast("int").alias("x"), F.col("luma").alias("u"))
    return heuristic.warp_chroma(chroma, moved, ["frame"], 8).select("frame", *whole("y", "x", "eye", "u"))


@query(S.with_(S.PX8, S.heuristic("round_even(s, 0)"), "c AS (SELECT frame, y // 2 AS y, x // 2 AS x, luma AS u, d // 2 AS d FROM h WHERE y % 2 = 0 AND x % 2 = 0) SELECT h.frame, 'luma' AS plane, CAST(h.y AS BIGINT) AS y, CAST(h.x + 8 * e.eye AS BIGINT) AS x, CAST(o.luma AS BIGINT) AS value FROM h, (VALUES (0), (1)) e(eye), px8 o WHERE o.frame = h.frame AND o.y = h.y AND o.x = CASE WHEN e.eye = 0 THEN greatest(0, h.x - h.d) ELSE least(7, h.x + h.d) END UNION ALL SELECT c.frame, 'chroma', CAST(c.y AS BIGINT), CAST(c.x + 4 * e.eye AS BIGINT), CAST(o.u AS BIGINT) FROM c, (VALUES (0), (1)) e(eye), c o WHERE o.frame = c.frame AND o.y = c.y AND o.x = CASE WHEN e.eye = 0 THEN greatest(0, c.x - c.d) ELSE least(3, c.x + c.d) END", raw=True))
def heuristic_sbs(spark, sf):
    """The whole operator of the heuristic path: both planes of the stereo frame."""
    px = V.square_frames(spark, sf)
    half = (F.col("y") % 2 == 0) & (F.col("x") % 2 == 0)
    chroma = px.where(half).select("frame", (F.col("y") / 2).cast("int").alias("y"), (F.col("x") / 2).cast("int").alias("x"), F.col("luma").alias("u"))
    luma, u = heuristic.side_by_side(px, chroma, ["frame"], 8, 8, HALF_EVEN)
    both = luma.select("frame", F.lit("luma").alias("plane"), "y", "x", F.col("luma").alias("value")).unionByName(u.select("frame", F.lit("chroma").alias("plane"), "y", "x", F.col("u").alias("value")))
    return both.select("frame", "plane", *whole("y", "x", "value"))


@query(S.with_(S.PX8, S.bilinear(8, 12), "r AS (SELECT p.frame, v.t AS y, h.t AS x, sum(p.luma * v.w * h.w) AS l FROM px8 p JOIN weights v ON v.s = p.y JOIN weights h ON h.s = p.x GROUP BY p.frame, v.t, h.t) SELECT frame, ty AS y, tx AS x, round((l / 255.0 - 0.485) / 0.229, 6) AS r, round(((255 - l) / 255.0 - 0.456) / 0.224, 6) AS g, round((l / 255.0 - 0.406) / 0.225, 6) AS b FROM r, range(14) a(ty), range(14) c(tx) WHERE r.y = CASE WHEN ty < 12 THEN ty ELSE 22 - ty END AND r.x = CASE WHEN tx < 12 THEN tx ELSE 22 - tx END", raw=True))
def preprocess_frame(spark, sf):
    """What a depth model reads: resized, normalised and mirrored to a multiple of 14."""
    rgb = V.square_frames(spark, sf).withColumns({"r": F.col("luma"), "g": 255 - F.col("luma"), "b": F.col("luma")})
    return geometry.preprocess(rgb, ["frame"], 8, 8, 1.5).select("frame", *whole("y", "x"), *real("r", "g", "b"))


@query("SELECT f AS frame, y, x, (x + 3 * f) % 256 AS luma, CAST(128 AS BIGINT) AS u, CAST(128 AS BIGINT) AS v FROM range(24) a(f), range(18) b(y), range(32) c(x)")
def mock_frames(spark, sf):
    return V.ramp_frames(spark, 24, 32, 18).select(*whole("frame", "y", "x", "luma", "u", "v"))


@query("SELECT p_partkey AS media, CAST(greatest(1, floor(p_size * 16 * 0.5 + 0.5)) AS BIGINT) AS req_w, CAST(greatest(1, floor(p_size * 9 * 0.5 + 0.5)) AS BIGINT) AS req_h, CAST(ceil(greatest(1, floor(p_size * 16 * 0.5 + 0.5)) / 14) * 14 AS BIGINT) AS pad_w, CAST(ceil(greatest(1, floor(p_size * 9 * 0.5 + 0.5)) / 14) * 14 AS BIGINT) AS pad_h, CAST(ceil(greatest(1, floor(p_size * 16 * 0.5 + 0.5)) / 14) * 14 - greatest(1, floor(p_size * 16 * 0.5 + 0.5)) AS BIGINT) AS \"right\", CAST(ceil(greatest(1, floor(p_size * 9 * 0.5 + 0.5)) / 14) * 14 - greatest(1, floor(p_size * 9 * 0.5 + 0.5)) AS BIGINT) AS bottom FROM part")
def depth_geometry(spark, sf):
    return geometry.depth_geometry(V.media_facts(spark, sf), 0.5).select("media", *whole("req_w", "req_h", "pad_w", "pad_h", "right", "bottom"))


@query("SELECT p_partkey AS media, CAST(greatest(14, floor(round_even(p_size * 16 * (504.0::DOUBLE / (p_size * 16)), 0) / 14 + 0.5) * 14) AS BIGINT) AS fit_w, CAST(greatest(14, floor(round_even(p_size * 9 * (504.0::DOUBLE / (p_size * 16)), 0) / 14 + 0.5) * 14) AS BIGINT) AS fit_h FROM part")
def legacy_resize_dims(spark, sf):
    return geometry.fitted_size(V.media_facts(spark, sf)).select("media", *whole("fit_w", "fit_h"))


@query(S.with_(S.PX8, "SELECT p.frame, ty AS y, tx AS x, CAST(p.luma AS BIGINT) AS luma FROM range(10) a(ty), range(11) b(tx), px8 p WHERE p.y = CASE WHEN ty < 8 THEN ty ELSE 14 - ty END AND p.x = CASE WHEN tx < 8 THEN tx ELSE 14 - tx END"))
def pad_reflect(spark, sf):
    return geometry.pad(V.square_frames(spark, sf), ["frame"], 8, 8, 2, 3).select("frame", *whole("y", "x", "luma"))


@query(S.with_(S.PX8, "SELECT p.frame, ty AS y, tx AS x, CAST(p.luma AS BIGINT) AS luma FROM range(10) a(ty), range(11) b(tx), px8 p WHERE p.y = least(ty, 7) AND p.x = least(tx, 7)"))
def pad_replicate(spark, sf):
    return geometry.pad(V.square_frames(spark, sf), ["frame"], 8, 8, 2, 3, reflect=False).select("frame", *whole("y", "x", "luma"))


@query(S.with_(S.PX8, "SELECT frame, CAST(y // 2 AS BIGINT) AS y, CAST(x // 2 AS BIGINT) AS x, round(avg(luma), 6) AS luma FROM px8 GROUP BY frame, y // 2, x // 2"))
def area_downscale(spark, sf):
    return geometry.area_downscale(V.square_frames(spark, sf), ["frame"], 2, "luma").select("frame", *whole("y", "x"), *real("luma"))


@query(S.with_(S.PX8, S.bilinear(8, 12), "SELECT p.frame, v.t AS y, h.t AS x, round(sum(p.luma * v.w * h.w), 6) AS luma FROM px8 p JOIN weights v ON v.s = p.y JOIN weights h ON h.s = p.x GROUP BY p.frame, v.t, h.t"))
def bilinear_resize(spark, sf):
    return geometry.bilinear_resize(V.square_frames(spark, sf), ["frame"], 8, 8, 12, 12, "luma").select("frame", *whole("y", "x"), *real("luma"))


@query(S.with_(S.PX8, "SELECT frame, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round((luma / 255.0 - 0.485) / 0.229, 6) AS r, round((luma / 255.0 - 0.456) / 0.224, 6) AS g, round((luma / 255.0 - 0.406) / 0.225, 6) AS b FROM px8"))
def imagenet_normalize(spark, sf):
    rgb = V.square_frames(spark, sf).withColumns({c: F.col("luma") for c in "rgb"})
    return geometry.normalize(rgb).select("frame", *whole("y", "x"), *real("r", "g", "b"))


@query(S.with_(S.PX8, "e AS (SELECT frame, min(luma) AS lo, max(luma) AS hi FROM px8 GROUP BY frame) SELECT frame, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(CASE WHEN hi = lo THEN 0 ELSE floor((luma - lo)::DOUBLE / (hi - lo) * 65535) END AS BIGINT) AS level FROM px8 JOIN e USING (frame)", raw=True))
def minmax_u16(spark, sf):
    return geometry.stretch(V.square_frames(spark, sf), ["frame"], "luma", 65535).select("frame", *whole("y", "x", "level"))


@query("WITH r AS (SELECT vec_id // 3 AS frame, CAST(vec_id % 3 * 4 + i // 16 AS BIGINT) AS y, CAST(i % 16 AS BIGINT) AS x, CAST(round_even(least(greatest(128.0::DOUBLE + 220.0::DOUBLE * CAST(embedding[i + 1] AS DOUBLE), 0.0), 255.0), 0) AS BIGINT) AS v FROM embeddings, range(64) q(i)), n AS (SELECT frame, count(*) AS n, max(y) + 1 AS rows_ FROM r GROUP BY frame) SELECT frame, CASE WHEN n <> 192 THEN 'rows: ' || rows_ END AS problem, CASE WHEN n = 192 THEN CAST(sum(CASE WHEN y < 8 THEN v * (y * 16 + x + 1) ELSE 0 END) AS BIGINT) END AS luma, CASE WHEN n = 192 THEN CAST(sum(CASE WHEN y >= 8 THEN v * ((y - 8) * 16 + x + 1) ELSE 0 END) AS BIGINT) END AS chroma FROM r JOIN n USING (frame) GROUP BY frame, n, rows_")
def planar_split(spark, sf):
    """Three embeddings as a planar frame of 8 by 16: luma, chroma, and the frame that lacks rows aside."""
    rows = V.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    level = F.rint(F.least(F.greatest(128.0 + 220.0 * F.col("v").cast("double"), F.lit(0.0)), F.lit(255.0))).cast("long")
    raw = rows.select(F.floor(F.col("vec_id") / 3).alias("frame"), (F.col("vec_id") % 3 * 4 + F.floor(F.col("i") / 16)).cast("int").alias("y"), (F.col("i") % 16).alias("x"), level.alias("v"))
    luma, chroma, wrong = heuristic.split_planes(raw, ["frame"], 8, 16)
    mark = lambda px, name: px.groupBy("frame").agg(F.sum(F.col("v") * (F.col("y") * 16 + F.col("x") + 1)).cast("long").alias(name))
    good = mark(luma, "luma").join(mark(chroma, "chroma"), "frame").select("frame", F.lit(None).cast("string").alias("problem"), "luma", "chroma")
    return good.unionByName(wrong.select("frame", F.concat(F.lit("rows: "), F.col("rows").cast("string")).alias("problem")), allowMissingColumns=True)


# -- files ---------------------------------------------------------------------------------------


@query("WITH v AS (SELECT vec_id, i, CAST(round_even(least(greatest(128.0::DOUBLE + 220.0::DOUBLE * CAST(embedding[i + 1] AS DOUBLE), 0.0), 255.0), 0) AS BIGINT) AS y, (CAST(round_even(least(greatest(128.0::DOUBLE + 220.0::DOUBLE * CAST(embedding[i // 16 * 8 + i % 8 // 2 * 2 + 1] AS DOUBLE), 0.0), 255.0), 0) AS BIGINT) + vec_id) % 256 AS u, (CAST(round_even(least(greatest(128.0::DOUBLE + 220.0::DOUBLE * CAST(embedding[i // 16 * 8 + i % 8 // 2 * 2 + 2] AS DOUBLE), 0.0), 255.0), 0) AS BIGINT) + vec_id) % 256 AS v FROM embeddings, range(64) r(i)) SELECT CAST(sum(y * (i + 1)) AS BIGINT) AS luma, CAST(sum(u * (i + 1)) AS BIGINT) AS u, CAST(sum(v * (i + 1)) AS BIGINT) AS v, count(*) AS pixels FROM v GROUP BY vec_id")
def raw_planes(spark, sf):
    """Each embedding as an NV12 frame of 8 by 8, written as raw files and read as planes."""
    byte = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    level = F.transform("embedding", lambda v: F.rint(F.least(F.greatest(128.0 + 220.0 * v.cast("double"), F.lit(0.0)), F.lit(255.0))).cast("long"))
    rows = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), level.alias("y"))
    text = F.concat(F.transform("y", byte), F.transform(F.slice("y", 1, 32), lambda v: byte((v + F.col("frame")) % 256)))
    path = files.shared_dir(spark)
    packed = files.register(spark) and rows.select("frame", F.unhex(F.array_join(text, "")).alias("data"))
    packed.write.format("raw_frames").options(path=path, width=8, height=8, layout="nv12").mode("append").save()
    px = files.nv12_pixels(files.raw_frames(spark, path, 8, 8, "nv12"))
    total = lambda c: F.sum(F.col(c) * (F.col("y") * 8 + F.col("x") + 1)).cast("long").alias(c)
    return px.groupBy("path", "frame").agg(total("luma"), total("u"), total("v"), F.count(F.lit(1)).alias("pixels")).drop("path", "frame")


@query("SELECT vec_id // 50 AS frame, count(*) AS h, CAST(64 AS BIGINT) AS w, round(min(list_min(embedding)::DOUBLE + 2), 6) AS min_depth, round(max(list_max(embedding)::DOUBLE + 2), 6) AS max_depth, round(avg(list_avg(embedding::DOUBLE[]) + 2), 6) AS mean_depth, round(sum(list_sum(embedding::DOUBLE[]) + 128), 4) AS total FROM embeddings GROUP BY vec_id // 50")
def depth_files(spark, sf):
    """Fifty embeddings as a depth map each, written as files for other tools and read again."""
    line = F.struct("vec_id", F.transform("embedding", lambda v: v.cast("double") + 2.0).alias("z"))
    maps = V.table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 50).alias("frame")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    maps = maps.select(F.lit(0).cast("long").alias("video"), "frame", F.size("lines").alias("h"), F.lit(64).alias("w"), F.flatten("lines.z").alias("depth"))
    path = files.shared_dir(spark)
    files.register(spark)
    maps.write.format("depth_files").option("path", path).mode("append").save()
    read = spark.read.format("depth_files").load(path)
    total = F.round(F.aggregate("depth", F.lit(0.0), lambda s, v: s + v), 4)
    return read.select("frame", *whole("h", "w"), *real("min_depth", "max_depth", "mean_depth"), total.alias("total"))


#: Faults planted in images, by a number: shapes, types and values.
_FAULTY = {0: "[4, 12]", 1: "[4, 4, 4]", 2: "[3, 4, 4]", 3: "[4, 4, 3]", 4: "[3, 4, 4]", 5: "[3, 4, 5]", 6: "[4, 4, 3]", 7: "[3, 4, 4]"}


@query("WITH v AS (SELECT vec_id, vec_id % 8 AS k, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(48) r(i)), g AS (SELECT vec_id, k, v / CASE WHEN k = 3 THEN 255.0::DOUBLE ELSE 1.0 END AS v, CASE WHEN k IN (3, 6) THEN i % 3 * 16 + i // 3 ELSE i END AS pos FROM v WHERE k IN (2, 3, 6)) SELECT vec_id AS frame, NULL AS problem, CAST(4 AS BIGINT) AS h, CAST(4 AS BIGINT) AS w, round(sum(v * (pos + 1)), 6) AS mark FROM g GROUP BY vec_id UNION ALL SELECT vec_id, CASE vec_id % 8 WHEN 0 THEN 'not three axes' WHEN 1 THEN 'not three channels' WHEN 4 THEN 'unknown type' WHEN 5 THEN 'not of its size' ELSE 'not finite' END, NULL, NULL, NULL FROM embeddings WHERE vec_id % 8 NOT IN (2, 3, 6)")
def image_quarantine(spark, sf):
    """Images with planted faults: the good ones go on as planes of fractions, the others aside with the reason."""
    k = F.col("vec_id") % 8
    shape = F.element_at(F.array(*[F.expr(f"array({text[1:-1]})") for text in _FAULTY.values()]), (k + 1).cast("int"))
    kind = F.when(k == 3, "uint8").when(k == 4, "int16").otherwise("float32")
    values = F.transform(F.slice("embedding", 1, 48), lambda v, i: F.when((k == 7) & (i == 5), F.lit(float("nan"))).otherwise(v.cast("double")))
    good, bad = images.usable_images(V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), shape.alias("shape"), kind.alias("type"), values.alias("values")))
    mark = F.round(F.aggregate(F.transform("planes", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v), 6)
    return good.select("frame", F.lit(None).cast("string").alias("problem"), *whole("h", "w"), mark.alias("mark")).unionByName(bad.select("frame", "problem"), allowMissingColumns=True)


@query(S.with_(S.PX8, "half AS (SELECT frame, y // 2 AS y, x // 2 AS x, 5 - 4 * avg(luma) / 255.0 AS z FROM px8 GROUP BY frame, y // 2, x // 2), at_ AS (SELECT t, s, 1 - abs(greatest(0, least(3, (t + 0.5::DOUBLE) / 2 - 0.5::DOUBLE)) - s) AS w FROM range(8) a(t), range(4) b(s)) SELECT frame, CAST(v.t AS BIGINT) AS y, CAST(h.t AS BIGINT) AS x, round(sum(z * v.w * h.w), 6) AS z FROM half JOIN at_ v ON v.s = y JOIN at_ h ON h.s = x WHERE v.w > 0 AND h.w > 0 GROUP BY frame, v.t, h.t", raw=True))
def provider_depth(spark, sf):
    """Depth from a provider that sees frames at half size, padded, five at a time, brought back to full size."""
    px = V.square_frames(spark, sf)
    cell = F.struct("y", "x", F.lpad(F.hex(F.col("luma").cast("long")), 2, "0").alias("byte"))
    packed = px.groupBy("frame").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    rgb = F.unhex(F.array_join(F.transform("c.byte", lambda b: F.concat(b, b, b)), ""))
    rows = packed.select(F.lit(0).cast("long").alias("video"), "frame", F.lit(8).alias("h"), F.lit(8).alias("w"), rgb.alias("rgb"))
    depth_ = providers.predict_depth(rows, providers.FromLuma, batch=5, scale="1/2")
    at = depth_.select("frame", F.posexplode("depth").alias("i", "z"))
    return at.select("frame", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("long").alias("x"), *real("z"))


@query("SELECT o_custkey AS customer, count(*) AS orders, round(sum(o_totalprice), 2) AS total, CAST(1 AS BIGINT) AS version FROM orders GROUP BY o_custkey")
def versioned_replace(spark, sf):
    """A table replaced by its next version; a writer that began from an older one is refused."""
    from parallaxis.plans.commit import CommitError, exact_rows
    from parallaxis.plans.versions import VersionedTable

    table = VersionedTable(spark, files.shared_dir(spark))
    per = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    first = table.replace(per.where("orders > 1"))
    table.replace(per, {"rows": exact_rows(per.count())}, snapshot=first)
    try:
        table.replace(per.limit(1), snapshot=first)
    except CommitError:
        pass
    return table.read().withColumn("version", F.lit(table.version()).cast("long"))


# -- scenes and time ---------------------------------------------------------------------------


@query(S.with_(S.GEN, S.BOX, "SELECT CAST(video AS BIGINT) AS video, CAST(frame AS BIGINT) AS frame, CAST(ymin AS BIGINT) AS ymin, CAST(ymax AS BIGINT) AS ymax, CAST(xmin AS BIGINT) AS xmin, CAST(xmax AS BIGINT) AS xmax FROM box"))
def letterbox(spark, sf):
    return scenes.letterbox(V.generated_video(spark, sf), ["video", "frame"], SCENE).select(*whole("video", "frame", "ymin", "ymax", "xmin", "xmax"))


@query(S.with_(S.GEN, S.BOX, S.CROP, "m AS (SELECT video, frame, avg(luma) AS m FROM crop GROUP BY video, frame), f AS (SELECT video, frame, m, m < 20 AS is_fade, lag(m < 20) OVER (PARTITION BY video ORDER BY frame) AS was FROM m) SELECT CAST(video AS BIGINT) AS video, CAST(frame AS BIGINT) AS frame, round(m, 6) AS mean_luma, is_fade, coalesce(is_fade <> was, FALSE) AS transition FROM f", raw=True))
def fade_transitions(spark, sf):
    keys, px = ["video", "frame"], V.generated_video(spark, sf)
    b = scenes.brightness(scenes.active(px, scenes.letterbox(px, keys, SCENE), keys), keys, SCENE)
    was = F.lag("is_fade").over(W.partitionBy("video").orderBy("frame"))
    return b.withColumn("transition", F.coalesce(F.col("is_fade") != was, F.lit(False))).select(*whole("video", "frame"), *real("mean_luma"), "is_fade", "transition")


@query(S.with_(S.GEN, S.BOX, S.CROP, S.THUMB, "SELECT CAST(video AS BIGINT) AS video, CAST(frame AS BIGINT) AS frame, CAST(k AS BIGINT) AS bin, round(avg(CASE WHEN luma // 16 = k THEN 1.0 ELSE 0.0 END), 6) AS share FROM thumb, range(16) r(k) GROUP BY video, frame, k"))
def scene_histogram(spark, sf):
    keys, px = ["video", "frame"], V.generated_video(spark, sf)
    h = scenes.histograms(scenes.thumbnails(scenes.active(px, scenes.letterbox(px, keys, SCENE), keys), keys, SCENE), keys, SCENE)
    return h.select(*whole(*keys), F.posexplode("bins").alias("bin", "share")).select(*whole("video", "frame", "bin"), *real("share"))


@query(S.with_(S.GEN, S.BOX, S.CROP, S.CUTS, "SELECT CAST(video AS BIGINT) AS video, CAST(frame AS BIGINT) AS frame, round(score, 6) AS score, is_fade, is_cut FROM cuts"))
def scene_cut(spark, sf):
    return scenes.scene_cuts(V.generated_video(spark, sf), "video", SCENE).select(*whole("video", "frame"), *real("score"), "is_fade", "is_cut")


@query(S.with_(S.GEN, S.BOX, S.CROP, S.CUTS, "s AS (SELECT video, frame, sum(CASE WHEN is_cut THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY frame) AS shot FROM cuts) SELECT CAST(video AS BIGINT) AS video, CAST(frame AS BIGINT) AS frame, CAST(shot AS BIGINT) AS shot, row_number() OVER (PARTITION BY video, shot ORDER BY frame) - 1 AS in_shot FROM s", raw=True))
def shot_ids(spark, sf):
    return scenes.shots(scenes.scene_cuts(V.generated_video(spark, sf), "video", SCENE), "video").select(*whole("video", "frame", "shot", "in_shot"))


#: Cuts by content come often, and at least three frames apart.
SPACED = SceneConfig(fade_threshold=20.0, thumb_height=6, thumb_width=8, cut_threshold=0.12, min_scene_frames=3)
_SPACED = "WITH RECURSIVE " + ", ".join([S.GEN, S.BOX, S.CROP, S.CUTS]) + ", c AS (SELECT video, frame, score, is_fade, TRUE AS is_cut, frame AS latest, 1 AS shot FROM cuts WHERE frame = 0 UNION ALL SELECT s.video, s.frame, s.score, s.is_fade, s.score = 1.0 OR (s.score >= 0.12 AND s.frame - c.latest >= 3), CASE WHEN s.score = 1.0 OR (s.score >= 0.12 AND s.frame - c.latest >= 3) THEN s.frame ELSE c.latest END, c.shot + CASE WHEN s.score = 1.0 OR (s.score >= 0.12 AND s.frame - c.latest >= 3) THEN 1 ELSE 0 END FROM c JOIN cuts s ON s.video = c.video AND s.frame = c.frame + 1) SELECT CAST(video AS BIGINT) AS video, CAST(frame AS BIGINT) AS frame, round(score, 6) AS score, is_fade, is_cut, CAST(shot AS BIGINT) AS shot, CAST(ymin AS BIGINT) AS ymin, CAST(ymax AS BIGINT) AS ymax, CAST(xmin AS BIGINT) AS xmin, CAST(xmax AS BIGINT) AS xmax FROM c JOIN box USING (video, frame)"


@query(_SPACED)
def scene_cut_spaced(spark, sf):
    """The detector over packed frames: scores from the pixels, each cut three frames after the last or forced."""
    frames = temporal.packed(V.generated_video(spark, sf), ["video", "frame"])
    found = cuts.detect_cuts(frames, SPACED, "luma")
    return found.select("video", "frame", *real("score"), "is_fade", "is_cut", *whole("shot", "ymin", "ymax", "xmin", "xmax"))


@query(_SPACED)
def scene_cut_stream(spark, sf):
    """The same rows from the stateful operator, run over the table as one batch."""
    from parallaxis.streaming.processors import cut_stream

    frames = temporal.packed(V.generated_video(spark, sf), ["video", "frame"])
    found = cut_stream(frames, SPACED, "luma").where("not late")
    return found.select("video", "frame", *real("score"), "is_fade", "is_cut", *whole("shot", "ymin", "ymax", "xmin", "xmax"))


@query(S.with_(S.GEN, S.BOX, S.CROP, "c3 AS (SELECT c.*, k, CASE k WHEN 0 THEN luma WHEN 1 THEN luma * 2 % 256 ELSE 255 - luma END AS v FROM crop c, range(3) r(k)), parts AS (SELECT c.video, c.frame, k, ty AS y, tx AS x, v, (ymax - ymin) * (xmax - xmin) AS area, least((c.y - ymin + 1) * 6, (ty + 1) * (ymax - ymin)) - greatest((c.y - ymin) * 6, ty * (ymax - ymin)) AS py, least((c.x - xmin + 1) * 8, (tx + 1) * (xmax - xmin)) - greatest((c.x - xmin) * 8, tx * (xmax - xmin)) AS px FROM c3 c JOIN box USING (video, frame), range(6) r(ty), range(8) s(tx)), thumb AS (SELECT video, frame, k, y, x, CAST(round_even(sum(v * greatest(py, 0) * greatest(px, 0)) / max(area)::DOUBLE, 0) AS INTEGER) AS v FROM parts GROUP BY video, frame, k, y, x) SELECT CAST(video AS BIGINT) AS video, CAST(frame AS BIGINT) AS frame, CAST(k * 16 + b AS BIGINT) AS bin, round(avg(CASE WHEN v // 16 = b THEN 1.0 ELSE 0.0 END), 6) AS share FROM thumb, range(16) q(b) GROUP BY video, frame, k, b", raw=True))
def scene_histogram_rgb(spark, sf):
    """Shares of 16 bins for each of three channels of the thumbnail: 48 numbers a frame."""
    keys, rgb = ["video", "frame"], ("r", "g", "b")
    px = V.generated_video(spark, sf).select(*keys, "y", "x", "luma", F.col("luma").alias("r"), (F.col("luma") * 2 % 256).alias("g"), (255 - F.col("luma")).alias("b"))
    thumbs = scenes.thumbnails(scenes.active(px, scenes.letterbox(px, keys, SCENE), keys), keys, SCENE, rgb)
    h = scenes.histograms(thumbs, keys, SCENE, rgb)
    return h.select(*whole(*keys), F.posexplode("bins").alias("bin", "share")).select(*whole("video", "frame", "bin"), *real("share"))


def _signal_bounds(spark, sf):
    v = F.log(2.0 + F.greatest("value", F.lit(0.0)))
    return V.signal(spark, sf).select("video", "frame", v.alias("q_low"), (v * 2).alias("q_high"))


@query(S.with_(S.SIGNAL, "w AS (SELECT a.video, a.frame, sum(ln(2.0 + greatest(b.value, 0)) * CASE WHEN b.frame = 0 THEN power(0.9::DOUBLE, a.frame) ELSE 0.1 * power(0.9::DOUBLE, a.frame - b.frame) END) AS low FROM sig a JOIN sig b ON a.video = b.video AND b.frame <= a.frame GROUP BY a.video, a.frame) SELECT video, CAST(frame AS BIGINT) AS frame, round(low, 6) AS low, round(2 * low, 6) AS high FROM w", raw=True))
def ema_bounds(spark, sf):
    """The closed form of the oracle holds because the span here is the value itself, over the least span."""
    return temporal.ema_bounds(_signal_bounds(spark, sf), "video", TEMPORAL).select("video", *whole("frame"), *real("low", "high"))


@query(S.with_(S.GEN, "p AS (SELECT a.video, a.frame, 1.0 / a.z AS inv, 1.0 / b.z AS before FROM gen a JOIN gen b ON a.video = b.video AND a.frame = b.frame + 1 AND a.y = b.y AND a.x = b.x), s AS (SELECT video, frame, count(*) AS n, quantile_cont(inv, 0.75) - quantile_cont(inv, 0.25) AS iqr, median(inv / greatest(before, 1e-6)) AS r FROM p GROUP BY video, frame) SELECT CAST(video AS BIGINT) AS video, CAST(frame AS BIGINT) AS frame, n AS shared, round(CASE WHEN n >= 50 AND iqr > 1e-4 THEN greatest(0.85, least(1.15, r)) ELSE 1.0 END, 6) AS scale FROM s", raw=True))
def scale_alignment(spark, sf):
    px = V.generated_video(spark, sf)
    before = px.select("video", (F.col("frame") + 1).alias("frame"), "y", "x", (1.0 / F.col("z")).alias("inv_before"))
    pairs = px.withColumn("inv", 1.0 / F.col("z")).join(before, ["video", "frame", "y", "x"])
    return temporal.scale_alignment(pairs, ["video", "frame"], TEMPORAL).select(*whole("video", "frame", "shared"), *real("scale"))


@query(S.with_(S.GEN, "p AS (SELECT a.video, a.frame, 1.0 / a.z AS inv, 1.0 / b.z AS before FROM gen a JOIN gen b ON a.video = b.video AND a.frame = b.frame + 1 AND a.y = b.y AND a.x = b.x), s AS (SELECT video, frame, count(*) AS n, quantile_cont(inv, 0.75) - quantile_cont(inv, 0.25) AS iqr, quantile_disc(inv / greatest(before, 1e-6), 0.5) AS r FROM p GROUP BY video, frame) SELECT CAST(video AS BIGINT) AS video, CAST(frame AS BIGINT) AS frame, n AS shared, round(CASE WHEN n >= 50 AND iqr > 1e-4 THEN greatest(0.85, least(1.15, r)) ELSE 1.0 END, 6) AS scale FROM s", raw=True))
def scale_alignment_lower(spark, sf):
    px = V.generated_video(spark, sf)
    before = px.select("video", (F.col("frame") + 1).alias("frame"), "y", "x", (1.0 / F.col("z")).alias("inv_before"))
    pairs = px.withColumn("inv", 1.0 / F.col("z")).join(before, ["video", "frame", "y", "x"])
    return temporal.scale_alignment(pairs, ["video", "frame"], TEMPORAL, lower_median=True).select(*whole("video", "frame", "shared"), *real("scale"))


@query(S.with_(S.GEN, "p AS (SELECT a.video, a.frame, abs(a.luma - b.luma) <= 30 AND abs(a.z - b.z) / greatest(a.z, 1e-6) <= 0.25 AS ok FROM gen a JOIN gen b ON a.video = b.video AND a.frame = b.frame + 1 AND a.y = b.y AND a.x = b.x) SELECT CAST(video AS BIGINT) AS video, CAST(frame AS BIGINT) AS frame, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS valid_fraction FROM p GROUP BY video, frame", raw=True))
def valid_fraction(spark, sf):
    """The share of pixels whose luma and depth hold from frame to frame."""
    now, was = _with_frame_before(V.generated_video(spark, sf))
    pairs = now.join(was.select("video", "frame", "y", "x", F.col("luma").alias("luma_before"), F.col("z").alias("z_before")), ["video", "frame", "y", "x"])
    return temporal.valid_share(pairs, ["video", "frame"], TEMPORAL).select(*whole("video", "frame"), *real("valid_fraction"))



@query(S.with_(S.SIGNAL, "SELECT video, CAST(frame AS BIGINT) AS frame, round(coalesce(last_value(CASE WHEN kind <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY video ORDER BY frame ROWS UNBOUNDED PRECEDING), -1.0), 6) AS \"out\" FROM sig"))
def fallback_last_good(spark, sf):
    return temporal.last_good(V.signal(spark, sf), "video", F.col("kind") != "error", "value", -1.0).select("video", *whole("frame"), *real("out"))


@query(S.with_(S.GEN, "e AS (SELECT a.video, a.frame, abs(1.0 / a.z - 1.0 / b.z) AS e FROM gen a JOIN gen b ON a.video = b.video AND a.frame = b.frame + 1 AND a.y = b.y AND a.x = b.x - (1 + a.video % 3)) SELECT CAST(video AS BIGINT) AS video, CAST(frame AS BIGINT) AS frame, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS mae FROM e GROUP BY video, frame", raw=True))
def temporal_jitter(spark, sf):
    px = V.generated_video(spark, sf).withColumn("dx", (1 + F.col("video") % 3).cast("int"))
    return temporal.jitter(px, "video", "dx").select(*whole("video", "frame"), *real("rmse", "mae"))


@query(S.with_(S.GEN, S.FLOW, "SELECT CAST(video AS BIGINT) AS video, CAST(frame AS BIGINT) AS frame, median(u.fx + m2.dx) AS dx, median(u.fy + m2.dy) AS dy FROM u JOIN m2 USING (video, frame, y, x) GROUP BY video, frame"))
def block_flow(spark, sf):
    """Mean flow of each frame to the one before, searched at two scales; luma are whole numbers and weights powers of two, so costs are exact."""
    now, was = _with_frame_before(V.generated_video(spark, sf))
    found = flow.block_flow(now, was, ["video", "frame"], V.GEN_H, V.GEN_W, TEMPORAL)
    median = lambda c: F.percentile(c, F.lit(0.5)).alias(c)
    return found.groupBy("video", "frame").agg(median("dx"), median("dy")).select(*whole("video", "frame"), "dx", "dy")


def _with_frame_before(px):
    """Pixels of all frames but the first, and of their predecessors under the same frame number."""
    px = px.select("video", "frame", "y", "x", F.col("luma").cast("double").alias("luma"), "z")
    return px.where("frame > 0"), px.select("video", (F.col("frame") + 1).alias("frame"), "y", "x", "luma", "z").where(f"frame < {V.GEN_FRAMES}")


@query(S.with_(S.GEN, "f AS (SELECT video, frame, y, x, y + ((y + video) % 3 - 1) * 0.5::DOUBLE AS ty, x + ((x + frame) % 5 - 2) * 0.75::DOUBLE AS tx FROM gen WHERE frame > 0), c AS (SELECT *, greatest(0, least(11, ty)) AS cy, greatest(0, least(15, tx)) AS cx FROM f) SELECT CAST(c.video AS BIGINT) AS video, CAST(c.frame AS BIGINT) AS frame, CAST(c.y AS BIGINT) AS y, CAST(c.x AS BIGINT) AS x, round(sum(g.z * (1 - abs(cy - g.y)) * (1 - abs(cx - g.x))), 6) AS z, min(ty) BETWEEN 0 AND 11 AND min(tx) BETWEEN 0 AND 15 AS inside FROM c JOIN gen g ON g.video = c.video AND g.frame = c.frame - 1 AND abs(cy - g.y) < 1 AND abs(cx - g.x) < 1 GROUP BY c.video, c.frame, c.y, c.x", raw=True))
def flow_warp(spark, sf):
    """The depth of the frame before, moved along a made-up flow of fractions."""
    now, was = _with_frame_before(V.generated_video(spark, sf))
    moves = now.select("video", "frame", "y", "x", (((F.col("x") + F.col("frame")) % 5 - 2) * 0.75).alias("dx"), (((F.col("y") + F.col("video")) % 3 - 1) * 0.5).alias("dy"))
    return flow.warp(was, moves, ["video", "frame"], V.GEN_H, V.GEN_W, ("z",)).select(*whole("video", "frame", "y", "x"), *real("z"), "inside")


@query(S.with_(S.GEN, "c AS (SELECT video, frame, 1.0 / z AS inv, y, y + 0.25::DOUBLE * (video % 2) AS ty, x + (0.5::DOUBLE + video % 3) AS tx FROM gen WHERE frame NOT IN (0, 6)), w AS (SELECT c.video, c.frame, c.y, c.tx, any_value(inv) AS inv, sum((1 - abs(ty - g.y)) * (1 - abs(tx - g.x)) / g.z) AS was FROM c JOIN gen g ON g.video = c.video AND g.frame = c.frame - 1 AND abs(ty - g.y) < 1 AND abs(tx - g.x) < 1 WHERE ty >= 0 AND ty <= 11 AND tx >= 0 AND tx <= 15 GROUP BY c.video, c.frame, c.y, c.tx) SELECT CAST(video AS BIGINT) AS video, CAST(frame AS BIGINT) AS frame, round(sqrt(avg((inv - was) * (inv - was))), 6) AS rmse, round(avg(abs(inv - was)), 6) AS mae FROM w GROUP BY video, frame", raw=True))
def temporal_jitter_fractional(spark, sf):
    """Jitter along motion of half and quarter pixels; the frame of the cut has no past."""
    px = V.generated_video(spark, sf).withColumn("dx", 0.5 + F.col("video") % 3).withColumn("dy", 0.25 * (F.col("video") % 2)).withColumn("cut", F.col("frame").isin(0, V.GEN_CUT))
    return temporal.jitter(px, "video", "dx", "dy", "cut").select(*whole("video", "frame"), *real("rmse", "mae"))


@query()
def temporal_stabilize(spark, sf):
    """Stabilised depth of each shot: a recursion through its own output, so rows only."""
    px = V.generated_video(spark, sf)
    shot = scenes.shots(scenes.scene_cuts(px, "video", SCENE), "video").select("video", "frame", "shot")
    frames = temporal.packed(px, ["video", "frame"]).join(shot, ["video", "frame"])
    out = temporal.stabilize(frames.withColumn("video", F.col("video").cast("long")), TEMPORAL)
    mean = F.aggregate("depth", F.lit(0.0), lambda s, v: s + v) / F.size("depth")
    return out.withColumn("mean_depth", mean).select(*whole("video", "frame", "shot", "in_shot"), *real("low", "high", "valid_fraction", "scale", "mean_depth"))


@query(S.with_(S.SIGNAL, "w AS (SELECT a.video, a.frame, sum(ln(2.0 + greatest(b.value, 0)) * CASE WHEN b.frame = 0 THEN power(0.9::DOUBLE, a.frame) ELSE 0.1 * power(0.9::DOUBLE, a.frame - b.frame) END) AS s FROM sig a JOIN sig b ON a.video = b.video AND b.frame <= a.frame GROUP BY a.video, a.frame) SELECT video, CAST(frame AS BIGINT) AS frame, round(s, 6) AS smoothed FROM w", raw=True))
def stream_ema(spark, sf):
    """The stateful operator of the streaming form, run over the table as one batch."""
    from parallaxis.streaming.processors import smooth_stream

    return smooth_stream(V.signal(spark, sf).select("video", F.col("frame").cast("long").alias("frame"), F.log(2.0 + F.greatest("value", F.lit(0.0))).alias("value")), TEMPORAL.eta).where("not late").select("video", "frame", *real("smoothed"))


@query("WITH RECURSIVE " + S.SIGNAL + ", c AS (SELECT video, frame, TRUE AS is_cut, frame AS latest FROM sig WHERE frame = 0 UNION ALL SELECT s.video, s.frame, coalesce(s.value / 100.0 >= 0.35, FALSE) AND s.frame - c.latest >= 3, CASE WHEN coalesce(s.value / 100.0 >= 0.35, FALSE) AND s.frame - c.latest >= 3 THEN s.frame ELSE c.latest END FROM c JOIN sig s ON s.video = c.video AND s.frame = c.frame + 1) SELECT video, CAST(frame AS BIGINT) AS frame, is_cut FROM c")
def spaced_scene_cuts(spark, sf):
    """Cuts at least three frames apart: each decision depends on the last."""
    from parallaxis.streaming.processors import spaced_cuts

    scores = V.signal(spark, sf).select("video", F.col("frame").cast("long").alias("frame"), (F.col("value") / 100.0).alias("score"))
    return spaced_cuts(scores, 0.35, 3)


@query(S.with_(S.PX, "SELECT CAST(floor(frame / 5) AS BIGINT) AS batch, count(DISTINCT frame) AS frames, count(*) AS pixels FROM px GROUP BY floor(frame / 5)"))
def batch_groups(spark, sf):
    per_frame = V.pixel_rows(spark, sf).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    return per_frame.groupBy(F.floor(F.col("frame") / 5).alias("batch")).agg(F.count(F.lit(1)).alias("frames"), F.sum("n").alias("pixels")).select(*whole("batch", "frames", "pixels"))


# -- media -------------------------------------------------------------------------------------


@query(S.with_(S.MEDIA, "v AS (SELECT media, CASE WHEN contains(rate, '/') THEN TRY_CAST(split_part(rate, '/', 1) AS BIGINT) ELSE TRY_CAST(rate AS BIGINT) END AS n, CASE WHEN contains(rate, '/') THEN TRY_CAST(split_part(rate, '/', 2) AS BIGINT) ELSE 1 END AS d FROM media) SELECT media, CASE WHEN d <> 0 THEN n // greatest(1, gcd(n, d)) END AS num, CASE WHEN n IS NOT NULL AND d <> 0 THEN d // greatest(1, gcd(n, d)) END AS den FROM v", raw=True))
def fraction_parse(spark, sf):
    facts = V.dealt(V.media_facts(spark, sf), ["media"], V.row_partitions(spark, sf, "part"))
    return facts.withColumn("f", numeric.fraction(F.col("rate"))).select("media", F.col("f.num").alias("num"), F.col("f.den").alias("den"))


_DECIMALS = ("29.97002997", "23.976", "23.976023976", "59.94005994", "0.333333333", "14.985014985", "3.14159265", "25.0", "0.00004", "119.88011988")


@query("WITH v AS (SELECT DISTINCT text, CAST(text AS DOUBLE) AS x FROM (SELECT " + repr(list(_DECIMALS)) + "[1 + p_partkey % 10] AS text FROM part)), f AS (SELECT text, x, q, CAST(round(x * q) AS BIGINT) AS p FROM v, range(1, 10001) r(q)), b AS (SELECT text, p, q, row_number() OVER (PARTITION BY text ORDER BY abs(p / q::DOUBLE - x), q) AS n FROM f) SELECT p_partkey AS media, p AS num, q AS den FROM part JOIN b ON text = " + repr(list(_DECIMALS)) + "[1 + p_partkey % 10] WHERE n = 1")
def fraction_limit(spark, sf):
    """Decimals as the nearest fraction with a denominator of 10,000 at most."""
    text = F.element_at(F.array(*map(F.lit, _DECIMALS)), (1 + F.col("p_partkey") % 10).cast("int"))
    parts = V.dealt(V.table(spark, sf, "part").select("p_partkey"), ["p_partkey"], V.row_partitions(spark, sf, "part"))
    f = parts.select(F.col("p_partkey").alias("media"), numeric.fraction(text).alias("f"))
    return f.select("media", F.col("f.num").alias("num"), F.col("f.den").alias("den"))


@query(S.with_(S.MEDIA, "SELECT media, CAST(CASE WHEN TRY_CAST(raw_bits AS INT) > 0 THEN TRY_CAST(raw_bits AS INT) WHEN pix_fmt IN ('nv12','yuv420p','yuvj420p') THEN 8 WHEN pix_fmt IN ('p010','p010le','yuv420p10le','yuv420p10be') THEN 10 ELSE coalesce(nullif(TRY_CAST(regexp_extract(pix_fmt, '(\\d+)(?:le|be)?$', 1) AS INT), 0), 8) END AS BIGINT) AS by_format, CAST(CASE WHEN raw_bits IS NOT NULL THEN CAST(raw_bits AS INT) WHEN contains(pix_fmt, '10') THEN 10 WHEN contains(pix_fmt, '12') THEN 12 WHEN contains(pix_fmt, '16') THEN 16 ELSE 8 END AS BIGINT) AS by_name FROM media"))
def bit_depth(spark, sf):
    m = V.media_facts(spark, sf)
    return m.withColumn("by_format", media.bit_depth_by_format(F.col("raw_bits"), F.col("pix_fmt"))).withColumn("by_name", media.bit_depth_by_name(F.col("raw_bits"), F.col("pix_fmt"))).select("media", *whole("by_format", "by_name"))


@query(S.with_(S.MEDIA, "SELECT media, CAST(((coalesce(TRY_CAST(rotate_side AS INT), TRY_CAST(rotate_tag AS INT), 0) % 360) + 360) % 360 AS BIGINT) AS rotation, CASE WHEN lower(trim(transfer)) NOT IN ('', 'unknown', 'unspecified', 'reserved', 'n/a') THEN lower(trim(transfer)) END AS transfer FROM media"))
def rotation(spark, sf):
    m = V.media_facts(spark, sf)
    return m.withColumn("rotation", media.rotation(F.col("rotate_tag"), F.col("rotate_side"))).select("media", *whole("rotation"), media.clean_color(F.col("transfer")).alias("transfer"))


@query(S.with_(S.MEDIA, S.RATES, "SELECT media, CAST(CASE WHEN regexp_full_match(nb_frames, '\\d+') THEN CAST(nb_frames AS BIGINT) WHEN duration > 0 AND fps > 0 THEN greatest(1, round_even(duration * fps, 0)) ELSE 0 END AS BIGINT) AS frame_count FROM rates"))
def frame_count_estimate(spark, sf):
    m = V.media_facts(spark, sf).withColumn("fps", numeric.rate_or(F.col("rate")))
    return m.withColumn("frame_count", media.frame_count(F.col("nb_frames"), F.col("duration"), F.col("fps"))).select("media", *whole("frame_count"))


@query(S.with_(S.MEDIA, S.RATES, f"SELECT media, {S.HDR} AS hdr FROM rates"))
def hdr_predicate(spark, sf):
    return media.admit(V.media_facts(spark, sf)).select("media", "hdr")


@query(S.with_(S.MEDIA, S.RATES, "SELECT media, round(fps, 6) AS fps, abs(fps - avg_fps) > 0.005 AS vfr FROM rates"))
def vfr_predicate(spark, sf):
    return media.admit(V.media_facts(spark, sf)).select("media", *real("fps"), "vfr")


@query(S.with_(S.MEDIA, S.RATES, S.ADMIT, "SELECT media, reason, reason IS NULL AS admitted FROM admit"))
def strict_admission(spark, sf):
    return media.admit(V.media_facts(spark, sf)).select("media", "reason", F.col("reason").isNull().alias("admitted"))


@query(S.with_(S.MEDIA, "SELECT media, len(list_filter(string_split(codecs, ','), lambda c: c <> '' AND c NOT IN ('aac', 'mp3', 'ac3', 'eac3'))) = 0 AS admitted FROM media"))
def audio_admission(spark, sf):
    return V.media_facts(spark, sf).select("media", media.audio_admitted(F.col("codecs")).alias("admitted"))


@query("WITH r AS (SELECT p_partkey AS media, CAST(CASE p_partkey % 5 WHEN 0 THEN 24 WHEN 1 THEN 12 WHEN 2 THEN 30000 WHEN 3 THEN 7777777 ELSE 60 + p_size END AS BIGINT) AS num, CAST(CASE p_partkey % 5 WHEN 2 THEN 1001 WHEN 3 THEN 100000003 ELSE 1 END AS BIGINT) AS den FROM part), b AS (SELECT *, CASE WHEN 90000 * den % num = 0 THEN 90000 WHEN 180000 * den % num = 0 THEN 180000 WHEN 360000 * den % num = 0 THEN 360000 WHEN 720000 * den % num = 0 THEN 720000 WHEN 1000000 * den % num = 0 THEN 1000000 WHEN 90000 * (num // gcd(90000, num)) <= 10000000 THEN 90000 * (num // gcd(90000, num)) END AS base FROM r) SELECT media, base, base * den // num AS increment FROM b")
def pts_ticks(spark, sf):
    k = F.col("p_partkey") % 5
    r = V.table(spark, sf, "part").select(F.col("p_partkey").alias("media"), F.when(k == 0, 24).when(k == 1, 12).when(k == 2, 30000).when(k == 3, 7777777).otherwise(60 + F.col("p_size")).cast("long").alias("num"), F.when(k == 2, 1001).when(k == 3, 100000003).otherwise(1).cast("long").alias("den"))
    return r.select("media", media.pts_base(F.col("num"), F.col("den")).alias("base"), media.pts_increment(F.col("num"), F.col("den")).alias("increment"))


@query("WITH r AS (SELECT p_partkey AS media, p_size * 160 AS width, CASE p_partkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'h264_nvenc' WHEN 2 THEN 'auto' ELSE 'libx264' END AS ask, CASE WHEN p_partkey % 3 = 0 THEN ['libx264'] ELSE ['h264_nvenc', 'libx264'] END AS have FROM part) SELECT media, CASE WHEN ask IN ('auto', 'hevc_nvenc') AND list_contains(have, 'hevc_nvenc') THEN 'hevc_nvenc' WHEN ask IN ('auto', 'h264_nvenc') AND width <= 4096 AND list_contains(have, 'h264_nvenc') THEN 'h264_nvenc' WHEN ask IN ('auto', 'libx264') AND list_contains(have, 'libx264') THEN 'libx264' END AS encoder FROM r")
def encoder_choice(spark, sf):
    """An encoder for a width: by rank if none is named, and never another than the named one."""
    k = F.col("p_partkey")
    r = V.table(spark, sf, "part").select(k.alias("media"), (F.col("p_size") * 160).alias("width"), F.when(k % 4 == 1, "h264_nvenc").when(k % 4 == 3, "libx264").otherwise("auto").alias("ask"), F.when(k % 3 == 0, F.array(F.lit("libx264"))).otherwise(F.array(F.lit("h264_nvenc"), F.lit("libx264"))).alias("have"))
    return r.select("media", media.encoder_choice(F.col("ask"), F.col("width"), F.col("have")).alias("encoder"))


@query("WITH r AS (SELECT p_partkey AS media, CASE WHEN p_partkey % 2 = 0 THEN 'h264' ELSE 'h265' END AS codec, [NULL, 'auto', ' Auto ', 'h264_nvenc', 'libx264', 'libx265', 'hevc_nvenc'][1 + p_partkey % 7] AS ask, CASE p_partkey % 3 WHEN 0 THEN ['libx264', 'libx265'] WHEN 1 THEN ['h264_nvenc', 'libx264'] ELSE ['hevc_nvenc', 'h264_nvenc', 'libx265'] END AS have, p_partkey % 60 - 4 AS crf, p_size AS cq FROM part), n AS (SELECT *, lower(trim(coalesce(ask, ''))) AS name, CASE codec WHEN 'h264' THEN 'h264_nvenc' ELSE 'hevc_nvenc' END AS hard, CASE codec WHEN 'h264' THEN 'libx264' ELSE 'libx265' END AS soft FROM r) SELECT media, codec, CASE WHEN name IN ('', 'auto') THEN CASE WHEN list_contains(have, hard) THEN hard ELSE soft END WHEN name IN (hard, soft) AND list_contains(have, name) THEN name END AS encoder, CASE WHEN name IN ('', 'auto') THEN NULL WHEN name NOT IN (hard, soft) THEN 'incompatible' WHEN NOT list_contains(have, name) THEN 'unavailable' END AS problem, crf BETWEEN 0 AND 51 AND cq BETWEEN 0 AND 51 AS quality FROM n")
def codec_encoder(spark, sf):
    """An encoder for a codec, or why the named one will not do; and the range of both quality settings."""
    k = F.col("p_partkey")
    lits = lambda *v: F.array(*[F.lit(x) for x in v])
    have = F.when(k % 3 == 0, lits("libx264", "libx265")).when(k % 3 == 1, lits("h264_nvenc", "libx264")).otherwise(lits("hevc_nvenc", "h264_nvenc", "libx265"))
    ask = F.element_at(lits(None, "auto", " Auto ", "h264_nvenc", "libx264", "libx265", "hevc_nvenc"), (1 + k % 7).cast("int"))
    r = V.table(spark, sf, "part").select(k.alias("media"), F.when(k % 2 == 0, "h264").otherwise("h265").alias("codec"), ask.alias("ask"), have.alias("have"), (k % 60 - 4).alias("crf"), F.col("p_size").alias("cq"))
    r = r.withColumn("e", media.codec_encoder(F.col("codec"), F.col("ask"), F.col("have")))
    return r.select("media", "codec", F.col("e.encoder").alias("encoder"), F.col("e.problem").alias("problem"), media.quality_allowed(F.col("crf"), F.col("cq")).alias("quality"))


@query(S.with_(S.MEDIA, "m AS (SELECT * REPLACE (CASE WHEN rate IN ('0/0', 'N/A') THEN average ELSE rate END AS rate) FROM media)", S.RATES.replace("FROM media", "FROM m"), S.ADMIT, "SELECT media, CASE WHEN media % 13 = 0 THEN 'no video stream' WHEN media % 17 = 0 THEN 'no size' END AS unusable, CASE WHEN media % 13 <> 0 THEN CAST(CASE WHEN media % 17 = 0 THEN 0 ELSE width END AS BIGINT) END AS width, CASE WHEN media % 13 <> 0 THEN rate END AS rate, coalesce(codecs, '') AS codecs, CASE WHEN media % 13 <> 0 AND media % 17 <> 0 THEN reason END AS reason FROM admit"))
def probe_json(spark, sf):
    """Facts and admission from a probe's JSON documents: first video stream, all audio streams, tags and side data."""
    m, k = V.dealt(V.media_facts(spark, sf), ["media"], V.row_partitions(spark, sf, "part")), F.col("media")
    text = lambda c: F.col(c).cast("string").alias(c)
    audio = F.transform(media.codec_list(F.col("codecs")), lambda c: F.struct(F.lit("audio").alias("codec_type"), F.upper(c).alias("codec_name")))
    size = F.when(k % 17 == 0, 0).otherwise(F.col("width"))
    video = F.struct(
        F.lit("video").alias("codec_type"), size.alias("width"), F.col("height"), F.col("rate").alias("r_frame_rate"), F.col("average").alias("avg_frame_rate"), F.col("nb_frames"), F.upper("pix_fmt").alias("pix_fmt"),
        F.col("raw_bits").alias("bits_per_raw_sample"), F.col("transfer").alias("color_transfer"), F.col("space").alias("color_space"), F.col("primaries").alias("color_primaries"), F.col("sar").alias("sample_aspect_ratio"),
        F.when(F.col("rotate_tag").isNotNull(), F.create_map(F.lit("Rotate"), F.col("rotate_tag"))).alias("tags"), F.when(F.col("rotate_side").isNotNull(), F.array(F.create_map(F.lit("rotation"), F.col("rotate_side")))).alias("side_data_list"),
    )
    other = F.to_json(F.struct(F.lit("video").alias("codec_type"), F.lit(64).alias("width")))
    streams = F.concat_ws(",", F.transform(audio, lambda a: F.to_json(a)), F.when(k % 13 != 0, F.concat_ws(",", F.to_json(video), other)))
    document = F.concat(F.lit('{"streams": ['), streams, F.lit('], "format": {"duration": "'), text("duration"), F.lit('"}}'))
    facts = media.admit(media.probe_facts(m.select("media", document.alias("document")), "document"))
    reason = F.when(F.col("unusable").isNull(), F.col("reason"))
    return facts.select("media", "unusable", *whole("width"), "rate", "codecs", reason.alias("reason"))


@query("WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^https://([^/:?#]+)', 1)) AS host FROM pages) SELECT page_id, host, coalesce(host <> '' AND (host IN ('example.com', 'example.org') OR suffix(host, '.com') OR suffix(host, '.example.net')), FALSE) AS allowed FROM u")
def url_allowlist(spark, sf):
    host = F.lower(F.regexp_extract("url", r"^https://([^/:?#]+)", 1))
    return V.table(spark, sf, "pages").select("page_id", host.alias("host"), media.url_allowed(F.col("url"), ("example.com", "example.org"), ("com", "example.net")).alias("allowed"))


@query("SELECT p_partkey AS media, regexp_replace(printf('%.3f', p_retailprice * 1234.567::DOUBLE / 1e6), '\\.?0+$', '') || 'M' AS bitrate, 'bytes ' || p_partkey || '-' || (p_partkey + p_size) || '/' || CASE WHEN p_partkey % 3 = 0 THEN '*' ELSE '99999' END AS header, p_partkey AS \"start\", p_partkey + p_size AS \"end\", CASE WHEN p_partkey % 3 <> 0 THEN CAST(99999 AS BIGINT) END AS total, 'clip_FullSBS_LR.mp4' AS name FROM part")
def text_formats(spark, sf):
    k = F.col("p_partkey")
    header = F.concat(F.lit("bytes "), k, F.lit("-"), k + F.col("p_size"), F.lit("/"), F.when(k % 3 == 0, "*").otherwise("99999"))
    r = V.table(spark, sf, "part").select(k.alias("media"), media.bitrate_text(F.col("p_retailprice") * 1234.567).alias("bitrate"), header.alias("header"), media.content_range(header).alias("r"), media.output_name(F.lit("clip.mp4"), "_FullSBS_LR").alias("name"))
    return r.select("media", "bitrate", "header", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.col("r.total").alias("total"), "name")


# -- metrics, catalog, jobs --------------------------------------------------------------------


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 9) AS mean FROM events GROUP BY user_id, event_type")
def stage_metrics(spark, sf):
    return metrics.stage_means(V.table(spark, sf, "events"), ["user_id"], "event_type", "value").select("user_id", "event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 9).alias("mean"))


@query("WITH s AS (SELECT user_id, count(*) AS frames, quantile_cont(value, 0.95) AS p95, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY user_id) SELECT user_id, frames, round(p95, 6) AS p95, round(CASE WHEN seconds > 0 THEN frames / seconds ELSE 0.0 END, 6) AS fps FROM s")
def p95_kernel(spark, sf):
    return metrics.job_summary(V.table(spark, sf, "events"), ["user_id"], "value", "ts").select("user_id", "frames", *real("p95", "fps"))


@query("WITH m AS (SELECT user_id, coalesce(avg(CASE WHEN event_type = 'click' THEN value END), 0) + coalesce(avg(CASE WHEN event_type = 'view' THEN value END), 0) AS o, coalesce(avg(CASE WHEN event_type = 'purchase' THEN value END), 0) AS k FROM events GROUP BY user_id) SELECT user_id, round(o, 9) AS outer_ms, round(k, 9) AS middle_ms, o > 1.2 * k AS io_bound FROM m")
def bottleneck_flag(spark, sf):
    return metrics.bottlenecks(V.table(spark, sf, "events"), ["user_id"], "event_type", "value", ("click", "view"), "purchase").select("user_id", F.round("outer_ms", 9).alias("outer_ms"), F.round("middle_ms", 9).alias("middle_ms"), "io_bound")


@query("WITH e AS (SELECT user_id AS job, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, count(*) OVER (PARTITION BY user_id) + 5 AS total FROM events), p AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY job ORDER BY frame)) / 1e6 AS s FROM e) SELECT job, frame, round(100.0 * frame / total, 6) AS percent, round(CASE WHEN s > 0.05 THEN 1 / s END, 6) AS fps, round(CASE WHEN s > 0.05 THEN (total - frame) / (1 / s) END, 7) AS eta FROM p")
def progress_eta(spark, sf):
    job = W.partitionBy("user_id")
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("job"), "ts", F.row_number().over(job.orderBy("ts", "event_id")).alias("frame"), (F.count(F.lit(1)).over(job) + 5).alias("total"))
    return metrics.progress(e, "job", "frame", "ts", "total").select("job", *whole("frame"), *real("percent", "fps"), F.round("eta", 7).alias("eta"))


@query("WITH s AS (SELECT f.o_custkey AS input, count(*) AS jobs, sum(CASE WHEN f.o_orderstatus = 'F' THEN 1 ELSE 0 END) AS ok, sum(f.o_totalprice) AS total FROM orders f GROUP BY f.o_custkey) SELECT input, jobs, CAST(ok AS BIGINT) AS ok, jobs - CAST(ok AS BIGINT) AS failed, round(total, 2) AS total FROM s")
def batch_summary(spark, sf):
    s = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("input")).agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("o_orderstatus") == "F").alias("ok"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return s.select("input", "jobs", "ok", (F.col("jobs") - F.col("ok")).alias("failed"), "total")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def event_props(spark, sf):
    parsed = F.from_json("props", "k long")
    return V.table(spark, sf, "events").select("event_id", parsed["k"].alias("k")).where("k is not null")


@query("SELECT page_id, sha256(html) AS sha256 FROM pages")
def page_checksums(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


@query(S.with_(S.PX8, "z AS (SELECT frame, y, x, 1.0::DOUBLE + luma / 64.0::DOUBLE AS z FROM px8), s AS (SELECT a.frame, a.y, a.x, sum(b.z) / 9 AS z FROM z a JOIN z b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.frame, a.y, a.x), g AS (SELECT a.frame, a.y, a.x, max(a.z) AS z, sum(b.z * (b.x - a.x) * (2 - abs(b.y - a.y))) AS gx, sum(b.z * (b.y - a.y) * (2 - abs(b.x - a.x))) AS gy FROM s a JOIN s b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.frame, a.y, a.x) SELECT frame, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(sqrt(gx * gx + gy * gy) / greatest(z, 1e-6), 6) AS gradient, sqrt(gx * gx + gy * gy) / greatest(z, 1e-6) > 0.7 AS edge FROM g", raw=True))
def depth_edges(spark, sf):
    px = V.square_frames(spark, sf).select("frame", "y", "x", (1.0 + F.col("luma") / 64.0).alias("z"))
    return geometry.depth_edges(px, ["frame"], 8, 8, 0.7).select("frame", *whole("y", "x"), *real("gradient"), "edge")


@query(S.with_(S.PX8, "z AS (SELECT frame, y, x, 1.0::DOUBLE + luma / 64.0::DOUBLE AS z FROM px8), n AS (SELECT a.frame, a.y, a.x, a.z, dy - 1 AS dy, dx - 1 AS dx, 7 - abs(7 - abs(a.y + dy - 1)) AS ty, 7 - abs(7 - abs(a.x + dx - 1)) AS tx FROM z a, range(3) r(dy), range(3) q(dx)), g AS (SELECT n.frame, n.y, n.x, max(n.z) AS z, sum(b.z * dx * (2 - abs(dy))) AS gx, sum(b.z * dy * (2 - abs(dx))) AS gy FROM n JOIN z b ON b.frame = n.frame AND b.y = n.ty AND b.x = n.tx GROUP BY n.frame, n.y, n.x) SELECT frame, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(sqrt(gx * gx + gy * gy) / greatest(z, 1e-6), 6) AS gradient, sqrt(gx * gx + gy * gy) / greatest(z, 1e-6) > 0.7 AS edge FROM g", raw=True))
def depth_edges_raw(spark, sf):
    """Edges of the depth as it is, the border's neighbours mirrored."""
    px = V.square_frames(spark, sf).select("frame", "y", "x", (1.0 + F.col("luma") / 64.0).alias("z"))
    return geometry.depth_edges(px, ["frame"], 8, 8, 0.7, smooth=False).select("frame", *whole("y", "x"), *real("gradient"), "edge")


@query(S.with_(S.GEN, S.BOX, S.CROP, "SELECT CAST(video AS BIGINT) AS video, CAST(frame AS BIGINT) AS frame, round(quantile_cont(1.0::DOUBLE / z, 0.01), 6) AS q_low, round(quantile_cont(1.0::DOUBLE / z, 0.99), 6) AS q_high FROM crop GROUP BY video, frame"))
def active_bounds(spark, sf):
    keys, px = ["video", "frame"], V.generated_video(spark, sf)
    inside = (F.col("y") >= F.col("ymin")) & (F.col("y") < F.col("ymax")) & (F.col("x") >= F.col("xmin")) & (F.col("x") < F.col("xmax"))
    boxed = px.join(scenes.letterbox(px, keys, SCENE), keys)
    return depth.robust_bounds(boxed, keys, D, where=inside).select(*whole(*keys), *real("q_low", "q_high"))


@query(S.with_(S.PX8, "SELECT frame, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(0.299::DOUBLE * luma + 0.587::DOUBLE * (255 - luma) + 0.114::DOUBLE * (luma // 2), 6) AS gray, CAST(round_even(greatest(0.0, least(1.0, luma / 255.0::DOUBLE)) * 255.0::DOUBLE, 0) AS BIGINT) AS byte FROM px8"))
def luma_bytes(spark, sf):
    p = V.square_frames(spark, sf)
    gray = numeric.luma(F.col("luma"), 255 - F.col("luma"), F.floor(F.col("luma") / 2))
    return p.withColumn("gray", gray).withColumn("byte", numeric.to_byte(F.col("luma") / 255.0)).select("frame", *whole("y", "x"), *real("gray"), *whole("byte"))


@query("SELECT n_nationkey AS frame, y, x, CAST(0 AS BIGINT) AS luma, CAST(128 AS BIGINT) AS u, CAST(128 AS BIGINT) AS v FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation), range(4) a(y), range(6) b(x)")
def black_fallback(spark, sf):
    rows = V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("frame"))
    return heuristic.black_frame(rows, 4, 6).select(*whole("frame", "y", "x", "luma", "u", "v"))


@query("WITH p AS (SELECT l_orderkey AS job, l_linenumber AS frame, l_quantity AS kernel_ms FROM lineitem) SELECT CAST(job % 50 AS BIGINT) AS job, count(*) AS frames, round(median(kernel_ms), 6) AS median_ms, round(quantile_cont(kernel_ms, 0.95), 6) AS p95_ms FROM p GROUP BY job % 50")
def kernel_quantiles(spark, sf):
    p = V.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("job"), F.col("l_quantity").alias("kernel_ms"))
    q = p.groupBy("job").agg(F.count(F.lit(1)).alias("frames"), F.percentile("kernel_ms", F.array(F.lit(0.5), F.lit(0.95))).alias("q"))
    return q.select(*whole("job"), "frames", F.round(F.col("q")[0], 6).alias("median_ms"), F.round(F.col("q")[1], 6).alias("p95_ms"))
