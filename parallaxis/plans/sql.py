"""Pieces of SQL that say what the views and operators compute, to be joined into whole queries."""

from __future__ import annotations


def with_(*parts: str, raw: bool = False) -> str:
    """Common table expressions and, last, the query; ``raw``: the last part goes on with more of them."""
    *tables, last = parts
    return "WITH " + ", ".join(tables) + (", " if raw else " ") + last


PX = "px AS (SELECT vec_id AS frame, CAST(i AS INTEGER) AS x, CAST(embedding[i + 1] AS DOUBLE) + 2.0::DOUBLE AS z, CAST(embedding[i + 1] AS DOUBLE) AS g FROM embeddings, range(64) r(i))"
PX8 = "px8 AS (SELECT vec_id AS frame, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(round_even(least(greatest(128.0::DOUBLE + 220.0::DOUBLE * CAST(embedding[i + 1] AS DOUBLE), 0.0), 255.0), 0) AS INTEGER) AS luma FROM embeddings, range(64) r(i))"
BOUNDS = "b AS (SELECT frame, quantile_cont(1.0::DOUBLE / z, 0.01) AS q_low, quantile_cont(1.0::DOUBLE / z, 0.99) AS q_high, CAST(max(x) + 1 AS DOUBLE) AS width FROM px GROUP BY frame)"
DISPARITY = (
    "q AS (SELECT px.*, width, CASE WHEN q_high - q_low <= 1e-7 THEN 0.6 ELSE greatest(0.0, least(1.0, (1.0::DOUBLE / z - q_low) / (q_high - q_low))) END AS q FROM px JOIN b USING (frame)), "
    "d AS (SELECT *, greatest(-0.05::DOUBLE * width, least(0.05::DOUBLE * width, 0.3::DOUBLE * width * (q - 0.6::DOUBLE))) AS disparity FROM q)"
)
LANDED = (
    "eyes AS (SELECT *, e.eye, x + CASE WHEN e.eye = 0 THEN disparity / 2 ELSE -disparity / 2 END AS target FROM d, (VALUES (0), (1)) e(eye)), "
    "two AS (SELECT frame, eye, z, g, width, CAST(floor(target) AS INTEGER) AS xt, 1.0::DOUBLE - (target - floor(target)) AS w FROM eyes UNION ALL SELECT frame, eye, z, g, width, CAST(floor(target) AS INTEGER) + 1, target - floor(target) FROM eyes), "
    "landed AS (SELECT * FROM two WHERE xt >= 0 AND xt < width AND w > 1e-4)"
)
BLEND = (
    "zb AS (SELECT frame, eye, xt, min(z) AS z_near FROM landed GROUP BY frame, eye, xt), "
    "blend AS (SELECT frame, eye, xt, sum(w) AS weight, sum(w * z) / sum(w) AS depth, sum(w * g) / sum(w) AS g FROM landed JOIN zb USING (frame, eye, xt) WHERE z <= z_near * 1.05::DOUBLE + 1e-4 GROUP BY frame, eye, xt HAVING sum(w) > 1e-4)"
)
GRID = "grid AS (SELECT eyes.frame, eyes.eye, eyes.x, CAST(eyes.width AS INTEGER) AS width, blend.depth, blend.g, blend.weight IS NOT NULL AS covered FROM eyes LEFT JOIN blend ON blend.frame = eyes.frame AND blend.eye = eyes.eye AND blend.xt = eyes.x)"


def _edge(which: str, value: str, frame: str) -> str:
    return f"{which}_value(CASE WHEN covered THEN {value} END IGNORE NULLS) OVER (PARTITION BY frame, eye ORDER BY x ROWS BETWEEN {frame})"


_BACK, _AHEAD = "UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"
EDGES = (
    f"edges AS (SELECT *, {_edge('last', 'x', _BACK)} AS lx, {_edge('last', 'depth', _BACK)} AS lz, {_edge('last', 'g', _BACK)} AS lg, "
    f"{_edge('first', 'x', _AHEAD)} AS rx, {_edge('first', 'depth', _AHEAD)} AS rz, {_edge('first', 'g', _AHEAD)} AS rg FROM grid)"
)
WIDTHS = (
    "w0 AS (SELECT *, CASE WHEN covered THEN 0 WHEN lx IS NOT NULL AND rx IS NOT NULL THEN rx - lx - 1 WHEN rx IS NOT NULL THEN rx WHEN lx IS NOT NULL THEN width - 1 - lx ELSE width END AS hole_width FROM edges), "
    "widths AS (SELECT *, hole_width > 2 AS large FROM w0)"
)


def filled(gate: str) -> str:
    def value(l: str, r: str) -> str:
        t = "(x - lx)::DOUBLE / greatest(rx - lx, 1)"
        return f"CASE WHEN lx IS NOT NULL AND rx IS NOT NULL THEN CASE WHEN lz > rz * 1.05::DOUBLE THEN {l} WHEN rz > lz * 1.05::DOUBLE THEN {r} ELSE (1.0 - {t}) * {l} + {t} * {r} END WHEN lx IS NOT NULL THEN {l} ELSE {r} END"

    return f"filled AS (SELECT *, NOT covered AND (lx IS NOT NULL OR rx IS NOT NULL) AND {gate} AS filled, {value('lz', 'rz')} AS fz, {value('lg', 'rg')} AS fg FROM widths)"


SBS = "sbs AS (SELECT frame, x + eye * width AS x, CAST(round_even(greatest(0.0, least(1.0, CASE WHEN covered OR filled THEN 0.5::DOUBLE + CASE WHEN filled THEN fg ELSE g END ELSE 0.0 END)) * 255.0::DOUBLE, 0) AS INTEGER) AS g FROM filled)"


def heuristic(rounding: str) -> str:
    """``h``: the disparity of the heuristic, by the given rounding of ``s``."""
    return (
        "grad AS (SELECT *, coalesce(luma - lag(luma) OVER (PARTITION BY frame, y ORDER BY x), 0) AS gx, coalesce(luma - lag(luma) OVER (PARTITION BY frame, x ORDER BY y), 0) AS gy FROM px8), "
        "score AS (SELECT *, greatest(0.0, least(1.0, 0.6::DOUBLE * (0.45::DOUBLE * luma / 255.0::DOUBLE + 0.25::DOUBLE * greatest(0.0, least(1.0, (abs(gx) + abs(gy)) / 510.0::DOUBLE)) + 0.3::DOUBLE * (y / 7.0::DOUBLE)))) * 4.0::DOUBLE AS s FROM grad), "
        f"h AS (SELECT frame, y, x, luma, CAST(least(greatest(CAST({rounding} AS INTEGER), 0), 4) AS INTEGER) AS d FROM score)"
    )


def bilinear(size: int, to: int) -> str:
    """``weights``: what source ``s`` weighs in target ``t``."""
    return (
        f"c AS (SELECT t, least(greatest((t + 0.5::DOUBLE) * {size} / {to} - 0.5::DOUBLE, 0.0), {size - 1}.0) AS c FROM range({to}) r(t)), "
        f"weights AS (SELECT t, CAST(floor(c) AS INTEGER) AS s, 1.0::DOUBLE - (c - floor(c)) AS w FROM c UNION ALL SELECT t, least(CAST(floor(c) AS INTEGER) + 1, {size - 1}), c - floor(c) FROM c)"
    )


GEN = (
    "g0 AS (SELECT n_nationkey AS video, f AS frame, y, x, CAST(x + f * (1 + n_nationkey % 3) AS DOUBLE) AS cx, CAST(y AS DOUBLE) AS cy FROM nation, range(12) a(f), range(12) b(y), range(16) c(x)), "
    "gen AS (SELECT video, frame, y, x, CASE WHEN video % 2 = 0 AND (y < 2 OR y >= 10) THEN 0 ELSE CAST(floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN frame = 9 THEN 0.02::DOUBLE ELSE 1.0::DOUBLE END * (CASE WHEN frame < 6 THEN 128 + 50 * sin(cx / 4) * cos(cy / 4) + 40 * sin(cx / 10 + cy / 8) + 25 * cos(cx / 2.5::DOUBLE) ELSE 128 + 60 * sin(cx / 7) * sin(cy / 5) + 40 * cos(cy / 3) END)))) AS INTEGER) END AS luma, "
    "CASE WHEN frame < 6 THEN 2 + 0.6::DOUBLE * sin(cx / 16) * cos(cy / 14) + 0.3::DOUBLE * sin(cx / 25) ELSE 4.5::DOUBLE + 1.2::DOUBLE * cos(cx / 20 + cy / 15) END AS z FROM g0)"
)
BOX = (
    "rows_ AS (SELECT video, frame, y, avg(luma) AS m FROM gen GROUP BY video, frame, y), cols_ AS (SELECT video, frame, x, avg(luma) AS m FROM gen GROUP BY video, frame, x), "
    "ry AS (SELECT video, frame, min(y) FILTER (WHERE m >= 12) AS y0, max(y) FILTER (WHERE m >= 12) + 1 AS y1 FROM rows_ GROUP BY video, frame), "
    "rx AS (SELECT video, frame, min(x) FILTER (WHERE m >= 12) AS x0, max(x) FILTER (WHERE m >= 12) + 1 AS x1 FROM cols_ GROUP BY video, frame), "
    "ok AS (SELECT *, coalesce(y1 - y0 >= 2 AND x1 - x0 >= 3, FALSE) AS crop FROM ry JOIN rx USING (video, frame)), "
    "box AS (SELECT video, frame, CASE WHEN crop THEN y0 ELSE 0 END AS ymin, CASE WHEN crop THEN y1 ELSE 12 END AS ymax, CASE WHEN crop THEN x0 ELSE 0 END AS xmin, CASE WHEN crop THEN x1 ELSE 16 END AS xmax FROM ok)"
)
CROP = "crop AS (SELECT gen.* FROM gen JOIN box USING (video, frame) WHERE y >= ymin AND y < ymax AND x >= xmin AND x < xmax)"
#: The active part as an image of 6 by 8: areas in whole numbers, means rounded half to even.
THUMB = (
    "parts AS (SELECT c.video, c.frame, ty AS y, tx AS x, c.luma, (ymax - ymin) * (xmax - xmin) AS area, "
    "least((c.y - ymin + 1) * 6, (ty + 1) * (ymax - ymin)) - greatest((c.y - ymin) * 6, ty * (ymax - ymin)) AS py, least((c.x - xmin + 1) * 8, (tx + 1) * (xmax - xmin)) - greatest((c.x - xmin) * 8, tx * (xmax - xmin)) AS px "
    "FROM crop c JOIN box USING (video, frame), range(6) r(ty), range(8) s(tx)), "
    "thumb AS (SELECT video, frame, y, x, CAST(round_even(sum(luma * greatest(py, 0) * greatest(px, 0)) / max(area)::DOUBLE, 0) AS INTEGER) AS luma FROM parts GROUP BY video, frame, y, x)"
)
CUTS = (
    THUMB + ", "
    "mean_ AS (SELECT video, frame, avg(luma) < 20 AS is_fade FROM crop GROUP BY video, frame), "
    "hist AS (SELECT video, frame, k, avg(CASE WHEN luma // 16 = k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS s FROM thumb, range(16) r(k) GROUP BY video, frame, k), "
    "corr_ AS (SELECT a.video, a.frame, sum(a.s * b.s) - 16 * avg(a.s) * avg(b.s) AS cov, sqrt(greatest(0.0, sum(a.s * a.s) - 16 * avg(a.s) * avg(a.s)) * greatest(0.0, sum(b.s * b.s) - 16 * avg(b.s) * avg(b.s))) AS sp FROM hist a JOIN hist b ON a.video = b.video AND a.frame = b.frame + 1 AND a.k = b.k GROUP BY a.video, a.frame), "
    "delta AS (SELECT a.video, a.frame, avg(abs(a.luma - b.luma)) / 255.0::DOUBLE AS d FROM thumb a JOIN thumb b ON a.video = b.video AND a.frame = b.frame + 1 AND a.y = b.y AND a.x = b.x GROUP BY a.video, a.frame), "
    "prev AS (SELECT video, frame, is_fade, lag(is_fade) OVER (PARTITION BY video ORDER BY frame) AS was FROM mean_), "
    "sc AS (SELECT video, frame, is_fade, was, was IS NULL OR was <> is_fade AS forced, 0.6::DOUBLE * greatest(0.0, least(1.0, (1.0 - CASE WHEN sp > 1e-12 THEN cov / sp ELSE 1.0 END) / 2.0)) + 0.4::DOUBLE * d AS content FROM prev LEFT JOIN corr_ USING (video, frame) LEFT JOIN delta USING (video, frame)), "
    "cuts AS (SELECT video, frame, is_fade, CASE WHEN forced THEN 1.0 WHEN is_fade THEN 0.0 ELSE content END AS score, CASE WHEN forced THEN TRUE WHEN is_fade THEN FALSE ELSE content >= 0.35 END AS is_cut FROM sc)"
)
SIGNAL = "sig AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value, event_type AS kind FROM events)"


def _pick(*values: str | None) -> str:
    inside = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"[{inside}][1 + p_partkey % {len(values)}]"


MEDIA = (
    "media AS (SELECT p_partkey AS media, p_size * 16 AS width, p_size * 9 AS height, "
    + ", ".join(
        f"{_pick(*values)} AS {name}"
        for name, values in {
            "rate": ("24/1", "30000/1001", "25", "0/0", "12/1", "N/A", "50/2"),
            "average": ("24/1", "30000/1001", "25", "30/1", "12/1", "25/1", "50/2", "24000/1001"),
            "pix_fmt": ("yuv420p", "yuv420p10le", "p010le", "yuv444p12", "gray16", "yuvj420p"),
            "raw_bits": (None, None, "8", "10"),
            "transfer": ("bt709", "unknown", " SMPTE2084 ", "", "arib-std-b67", "N/A", "bt709"),
            "space": ("bt709", None, "bt2020nc", "bt709", "smpte170m", "unknown", "bt709", "bt709", "bt709", "bt709", "bt709"),
            "primaries": ("bt709", "bt709", None, "bt709", "BT2020", *["bt709"] * 8),
            "rotate_tag": ("0", "90", "-90", None, "180", "0", "0", "0", "360"),
            "rotate_side": (None, None, None, "270"),
            "sar": ("1:1", "1:1", None, "4:3", "1:1"),
            "codecs": ("aac", "aac,ac3", "flac", "", "mp3", "aac,opus"),
            "nb_frames": (None, "120", "x", None),
        }.items()
    )
    + ", p_retailprice AS duration FROM part)"
)


def _rate(c: str) -> str:
    v = f"CASE WHEN contains({c}, '/') THEN TRY_CAST(split_part({c}, '/', 1) AS DOUBLE) / nullif(TRY_CAST(split_part({c}, '/', 2) AS DOUBLE), 0) ELSE TRY_CAST({c} AS DOUBLE) END"
    return f"CASE WHEN {v} > 0 THEN {v} ELSE 30.0 END"


RATES = f"rates AS (SELECT *, {_rate('rate')} AS fps, {_rate('average')} AS avg_fps, CASE WHEN raw_bits IS NOT NULL THEN CAST(raw_bits AS INT) WHEN contains(pix_fmt, '10') THEN 10 WHEN contains(pix_fmt, '12') THEN 12 WHEN contains(pix_fmt, '16') THEN 16 ELSE 8 END AS bits FROM media)"
HDR = "(bits > 8 OR coalesce(lower(transfer) IN ('smpte2084', 'arib-std-b67', 'linear'), FALSE) OR coalesce(lower(space) IN ('bt2020nc', 'bt2020c', 'bt2020'), FALSE) OR coalesce(lower(primaries) IN ('bt2020nc', 'bt2020c', 'bt2020'), FALSE))"
ADMIT = (
    f"admit AS (SELECT *, CASE WHEN {HDR} THEN 'hdr' WHEN abs(fps - avg_fps) > 0.005 THEN 'variable rate' WHEN width % 2 <> 0 OR height % 2 <> 0 THEN 'odd size' "
    "WHEN coalesce(TRY_CAST(rotate_side AS INT), TRY_CAST(rotate_tag AS INT), 0) % 360 <> 0 THEN 'rotated' WHEN coalesce(sar, '1:1') NOT IN ('1:1', '0:1', 'N/A') THEN 'pixel aspect' "
    "WHEN codecs <> '' AND split_part(codecs, ',', 1) NOT IN ('aac', 'mp3', 'ac3', 'eac3') THEN 'audio codec' END AS reason FROM rates)"
)
#: Block matching of each frame with the one before: half size and shifts to 4, then full size and shifts to 2, patches of 5.
_BOX = "sum(d) OVER (PARTITION BY video, frame, k, {0} ORDER BY {1} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
_LEAST = "(SELECT * FROM (SELECT video, frame, y, x, k, " + _BOX.format("x", "y") + " AS d FROM (SELECT video, frame, y, x, k, " + _BOX.format("y", "x") + " AS d FROM {})) QUALIFY row_number() OVER (PARTITION BY video, frame, y, x ORDER BY d, k) = 1)"
FLOW = (
    "half AS (SELECT video, frame, y // 2 AS y, x // 2 AS x, avg(luma) AS v FROM gen GROUP BY video, frame, y // 2, x // 2), "
    "d1 AS (SELECT s.video, s.frame, s.y, s.x, k, abs(s.v - t.v) AS d FROM half s CROSS JOIN range(81) r(k) JOIN half t ON t.video = s.video AND t.frame = s.frame - 1 AND t.y = greatest(0, least(5, s.y + k // 9 - 4)) AND t.x = greatest(0, least(7, s.x + k % 9 - 4))), "
    "m1 AS (SELECT video, frame, y, x, 2.0::DOUBLE * (k % 9 - 4) AS dx, 2.0::DOUBLE * (k // 9 - 4) AS dy FROM " + _LEAST.format("d1") + "), "
    "at_y AS (SELECT ty, y, 1 - abs(greatest(0, least(5, (ty + 0.5::DOUBLE) / 2 - 0.5::DOUBLE)) - y) AS wy FROM range(12) a(ty), range(6) b(y)), at_x AS (SELECT tx, x, 1 - abs(greatest(0, least(7, (tx + 0.5::DOUBLE) / 2 - 0.5::DOUBLE)) - x) AS wx FROM range(16) a(tx), range(8) b(x)), "
    "u AS (SELECT video, frame, ty AS y, tx AS x, sum(dx * wx * wy) AS fx, sum(dy * wx * wy) AS fy FROM m1 JOIN at_y USING (y) JOIN at_x USING (x) WHERE wx > 0 AND wy > 0 GROUP BY video, frame, ty, tx), "
    "c2 AS (SELECT *, greatest(0, least(11, y + fy)) AS cy, greatest(0, least(15, x + fx)) AS cx FROM u), "
    "moved AS (SELECT c2.video, c2.frame, c2.y, c2.x, sum(g.luma * (1 - abs(cy - g.y)) * (1 - abs(cx - g.x))) AS v FROM c2 JOIN gen g ON g.video = c2.video AND g.frame = c2.frame - 1 AND abs(cy - g.y) < 1 AND abs(cx - g.x) < 1 GROUP BY c2.video, c2.frame, c2.y, c2.x), "
    "d2 AS (SELECT s.video, s.frame, s.y, s.x, k, abs(s.luma - t.v) AS d FROM gen s CROSS JOIN range(25) r(k) JOIN moved t ON t.video = s.video AND t.frame = s.frame AND t.y = greatest(0, least(11, s.y + k // 5 - 2)) AND t.x = greatest(0, least(15, s.x + k % 5 - 2))), "
    "m2 AS (SELECT video, frame, y, x, k % 5 - 2 AS dx, k // 5 - 2 AS dy FROM " + _LEAST.format("d2") + ")"
)
