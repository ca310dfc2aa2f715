"""Queries on reports, batches and pictures for people."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallaxis.operators import geometry, metrics
from parallaxis.plans import sql as S
from parallaxis.plans.catalog_queries import text
from parallaxis.plans.registry import query, real, whole
from parallaxis.sources import files
from parallaxis.sources import frames as V

#: The columns of a report from a line item, in quarters and eighths, so that four decimals are exact.
_COLUMNS = {"frame_index": "l_linenumber", "frame_ms": "l_quantity / 4.0D", "kernel_ms": "l_quantity / 8.0D", "decode_wait_ms": "l_quantity * 0.25D", "encode_wait_ms": "l_linenumber / 4.0D", "h2d_ms": "l_linenumber / 8.0D", "kernel_compute_ms": "l_quantity / 16.0D", "d2h_ms": "l_linenumber / 16.0D", "queue_depth": "l_linenumber % 3", "block_wait_ms": "l_linenumber * 0.5D"}
_ROWS = "r AS (SELECT l_orderkey % 50 AS job, l_orderkey, " + ", ".join(f"{e.replace('D', '::DOUBLE')} AS {c}" for c, e in _COLUMNS.items()) + " FROM lineitem)"


def _report_rows(spark, sf):
    made = [F.expr(e).cast("int" if c in ("frame_index", "queue_depth") else "double").alias(c) for c, e in _COLUMNS.items()]
    return V.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("job"), "l_orderkey", *made)


@query(S.with_(_ROWS, "SELECT CAST(job AS BIGINT) AS job, " + ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in metrics.STAGES) + ", avg(decode_wait_ms) + avg(encode_wait_ms) > 1.2 * avg(kernel_ms) AS io_bound FROM r GROUP BY job"))
def stage_report(spark, sf):
    """The seven means of each job, and whether it waits for its ends."""
    return metrics.stage_averages(_report_rows(spark, sf), ["job"]).select(*whole("job"), *real(*[f"avg_{c}" for c in metrics.STAGES]), "io_bound")


@query(S.with_(_ROWS, "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" if c in ("frame_index", "queue_depth") else f"printf('%.4f', {c}) AS {c}" for c in metrics.REPORT) + " FROM r"))
def report_csv(spark, sf):
    """Rows of the metrics file as text, written as CSV and read again."""
    path = files.shared_dir(spark)
    metrics.write_report(_report_rows(spark, sf), path)
    return spark.read.option("header", True).csv(path).select(*metrics.REPORT)


@query("WITH j AS (SELECT o_custkey AS input, o_orderstatus = 'F' AS ok, o_orderkey % 500 AS frames, (o_orderkey % 7) * 0.5::DOUBLE AS seconds, CASE WHEN o_orderkey % 3 = 0 THEN ['slow disk'] WHEN o_orderkey % 3 = 1 THEN ['slow disk', 'no audio'] ELSE [] END AS warnings FROM orders), w AS (SELECT DISTINCT input, unnest(warnings) AS x FROM j), l AS (SELECT input, string_agg(x, '; ' ORDER BY x) AS warnings FROM w GROUP BY input) SELECT j.input, count(*) AS jobs, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS ok, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failed, round(CASE WHEN sum(seconds) > 0 THEN sum(frames) / sum(seconds) ELSE 0 END, 6) AS fps, coalesce(max(l.warnings), '') AS warnings FROM j LEFT JOIN l ON l.input = j.input GROUP BY j.input")
def batch_report(spark, sf):
    """What came of each input: jobs, failures, frames per second, and warnings once each."""
    k = F.col("o_orderkey")
    warnings = F.when(k % 3 == 0, F.array(F.lit("slow disk"))).when(k % 3 == 1, F.array(F.lit("slow disk"), F.lit("no audio"))).otherwise(F.array().cast("array<string>"))
    jobs = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("input"), (F.col("o_orderstatus") == "F").alias("ok"), (k % 500).alias("frames"), ((k % 7) * 0.5).alias("seconds"), warnings.alias("warnings"))
    return metrics.batch_report(jobs).select("input", *whole("jobs", "ok", "failed"), *real("fps"), F.array_join("warnings", "; ").alias("warnings"))


@query("SELECT 'm' || k AS id, CAST(sum(k * 10 + i) AS BIGINT) AS bytes, count(*) AS files FROM (SELECT p_partkey AS k FROM part), range(3) r(i) WHERE i <= k % 3 GROUP BY k")
def catalog_bytes(spark, sf):
    """The size of each entry, over its files, in the catalog's order."""
    k, n = F.col("p_partkey"), F.sequence(F.lit(0), (F.col("p_partkey") % 3).cast("int"))
    held = F.map_from_entries(F.transform(n, lambda i: F.struct(text("f", i).alias("name"), (k * 10 + i).alias("bytes"))))
    entries = V.table(spark, sf, "part").select(k.alias("position"), text("m", k).alias("id"), held.alias("files")).orderBy("position")
    return entries.select("id", F.aggregate(F.map_values("files"), F.lit(0).cast("long"), lambda s, b: s + b).alias("bytes"), F.size("files").cast("long").alias("files"))


_COLOR = "CAST(round_even(list_extract({0}, i + 1) + (list_extract({0}, least(i + 2, " + str(len(files.ANCHORS)) + ")) - list_extract({0}, i + 1)) * (p - i), 0) AS BIGINT) AS {1}"
_COLORS = ", ".join(_COLOR.format([a[c] for a in files.ANCHORS], "rgb"[c]) for c in range(3))


@query(S.with_(S.PX8, f"e AS (SELECT frame, min(luma) AS lo, max(luma) AS hi FROM px8 GROUP BY frame), l AS (SELECT frame, y, x, CAST(CASE WHEN hi = lo THEN 0 ELSE floor((luma - lo)::DOUBLE / (hi - lo) * 255) END AS BIGINT) AS level FROM px8 JOIN e USING (frame)), q AS (SELECT *, level / 255.0::DOUBLE * {len(files.ANCHORS) - 1} AS p, CAST(floor(level / 255.0::DOUBLE * {len(files.ANCHORS) - 1}) AS BIGINT) AS i FROM l) SELECT frame, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, level, {_COLORS} FROM q", raw=True))
def depth_colors(spark, sf):
    """Eight bits of each frame's range, and their colours."""
    levels = geometry.stretch(V.square_frames(spark, sf), ["frame"], "luma", 255)
    return geometry.colored(levels, "level", 255, files.ANCHORS).select("frame", *whole("y", "x", "level", "r", "g", "b"))


_LEVEL = "CAST(CASE WHEN hi = lo THEN 0 ELSE floor((z - lo) / (hi - lo) * 255) END AS BIGINT)"


@query(f"WITH v AS (SELECT vec_id // 50 AS frame, CAST(embedding[i + 1] AS DOUBLE) + 2.0::DOUBLE AS z FROM embeddings, range(64) r(i)), e AS (SELECT frame, min(z) AS lo, max(z) AS hi FROM v GROUP BY frame), q AS (SELECT frame, {_LEVEL} / 255.0::DOUBLE * {len(files.ANCHORS) - 1} AS p, CAST(floor({_LEVEL} / 255.0::DOUBLE * {len(files.ANCHORS) - 1}) AS BIGINT) AS i FROM v JOIN e USING (frame)), c AS (SELECT frame, {_COLORS} FROM q) SELECT frame, count(*) AS pixels, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b FROM c GROUP BY frame")
def image_files(spark, sf):
    """Coloured depth of fifty embeddings each, written as PNG files and read as images."""
    path = files.shared_dir(spark)
    files.register(spark)
    line = F.struct("vec_id", F.transform("embedding", lambda v: v.cast("double") + 2.0).alias("z"))
    maps = V.table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 50).alias("frame")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    maps.select(F.lit(0).cast("long").alias("video"), "frame", F.size("lines").alias("h"), F.lit(64).alias("w"), F.flatten("lines.z").alias("depth")).write.format("depth_files").option("path", path).mode("append").save()
    found = V.images(spark, f"{path}/batch-*/part-*/*_color.png")
    frame = F.regexp_extract("path", r"depth_0_(\d+)_color", 1).cast("long")
    px = found.select(frame.alias("frame"), F.explode(V.rgb_pixels("data")).alias("p"))
    total = lambda c: F.sum(F.col(f"p.{c}")).cast("long").alias(c)
    return px.groupBy("frame").agg(F.count(F.lit(1)).alias("pixels"), total("r"), total("g"), total("b"))
