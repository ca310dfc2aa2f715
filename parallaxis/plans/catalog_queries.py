"""Queries on catalogs, model stores, jobs and their messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parallaxis.operators import catalog, media
from parallaxis.plans import sql as S
from parallaxis.plans.registry import query
from parallaxis.sources import frames as V


def picked(values, k: Column) -> Column:
    """The value that ``k`` (from 0) picks."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))


def text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


@query("WITH e AS (SELECT p_partkey AS k, 'm' || p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'lab/m' || (p_partkey + 2) ELSE 'lab/Depth-' || p_partkey END AS repo, CASE WHEN p_partkey % 3 = 0 THEN 'M' || (p_partkey + 1) ELSE 'Model ' || p_partkey END AS name FROM part), w AS (SELECT CASE k % 6 WHEN 0 THEN 'm' || k WHEN 1 THEN 'M' || k WHEN 2 THEN ' LAB/depth-' || k WHEN 3 THEN 'model ' || k || ' ' WHEN 4 THEN 'M' || k || ' ' ELSE 'none ' || k END AS wanted FROM e), n AS (SELECT id, k, lower(u.x) AS nm FROM e, unnest([id, repo, name, split_part(repo, '/', 2)]) u(x)), f AS (SELECT nm, arg_min(id, k) AS id FROM n GROUP BY nm) SELECT w.wanted, coalesce(e.id, f.id) AS id, CASE WHEN coalesce(e.id, f.id) IS NOT NULL THEN e.id IS NOT NULL END AS exact FROM w LEFT JOIN e ON e.id = w.wanted LEFT JOIN f ON f.nm = lower(trim(w.wanted))")
def catalog_lookup(spark, sf):
    """The entry that each name means, where titles and repositories of some entries are ids of others."""
    k = F.col("key")
    entries = V.model_entries(spark, sf).withColumn("repo", F.when(k % 5 == 0, text("lab/m", k + 2)).otherwise(F.col("repo"))).withColumn("name", F.when(k % 3 == 0, text("M", k + 1)).otherwise(F.col("name")))
    wanted = F.when(k % 6 == 0, text("m", k)).when(k % 6 == 1, text("M", k)).when(k % 6 == 2, text(" LAB/depth-", k)).when(k % 6 == 3, text("model ", k, " ")).when(k % 6 == 4, text("M", k, " ")).otherwise(text("none ", k))
    return catalog.lookup(entries, entries.select(wanted.alias("wanted")), order="key").select("wanted", "id", "exact")


def _acknowledged(entries):
    return entries.where(F.col("key") % 2 == 0).select("id")


@query("SELECT 'm' || k AS id, k % 3 = 0 OR k % 5 = 0 AS needs, k % 2 = 0 AS acked, NOT (k % 3 = 0 OR k % 5 = 0) OR k % 2 = 0 AS usable FROM (SELECT p_partkey AS k FROM part)")
def license_gate(spark, sf):
    entries = V.model_entries(spark, sf)
    return catalog.license_gate(entries, _acknowledged(entries)).select("id", "needs", "acked", "usable")


def _store(spark, sf):
    """What a model store holds: entries with their evidence, and a row for each file found."""
    k, n = F.col("p_partkey"), F.sequence(F.lit(0), (F.col("p_partkey") % 3).cast("int"))
    each = F.transform(n, lambda i: F.struct(text("f", i).alias("name"), F.struct((k * 10 + i).alias("bytes"), text("AB", k, "x", i).alias("sha256")).alias("spec")))
    told = F.array_join(F.transform(n, lambda i: text('"f', i, '": {"sha256": "ab', k, "x", i, '", "bytes": ', k * 10 + i + F.when((k % 11 == 0) & (i == k % 3), 1).otherwise(0), "}")), ", ")
    manifest = text('{"revision": "', F.when(k % 23 == 0, "other").otherwise(text("r", k % 5)), '", "model_id": "', F.when(k % 29 == 0, "x").when(k % 2 == 0, text("m", k)).otherwise(text("lab/Depth-", k)), '", "runtime_probe_verified": ', F.when(k % 13 == 0, "false").otherwise("true"), ', "files": {', told, "}}")
    rows = V.table(spark, sf, "part").select(
        k.alias("key"), text("m", k).alias("id"), text("lab/Depth-", k).alias("repo"), text("r", k % 5).alias("revision"), F.when(k % 19 == 0, "downloading").when(k % 19 == 1, "loading").when(k % 19 == 2, "ready").alias("active"),
        (~((k % 3 == 0) | (k % 5 == 0)) | (k % 2 == 0)).alias("acknowledged"), (k % 17 != 0).alias("folder"), F.map_from_entries(each).alias("files"),
        F.when(k % 7 == 1, "READY r9").when(k % 7 != 0, text("READY r", k % 5, " at noon")).alias("marker"), F.when(k % 31 == 0, "{").otherwise(manifest).alias("manifest"),
    )
    entries = rows.withColumn("ready", catalog.ready_evidence(F.col("id"), F.col("repo"), F.col("revision"), F.col("files"), F.col("marker"), F.col("manifest")))
    k, i = F.col("key"), F.col("position")
    found = rows.select("key", "id", F.posexplode(F.map_keys("files")).alias("position", "name"))
    return entries, found.select("id", "position", ((k + i) % 7 != 0).alias("present"), ((k + 2 * i) % 11 != 0).alias("right_size"), ((k + i) % 13 != 0).alias("right_hash"))


_STORE = "WITH e AS (SELECT p_partkey AS k, NOT (p_partkey % 3 = 0 OR p_partkey % 5 = 0) OR p_partkey % 2 = 0 AS acked FROM part), f AS (SELECT k, i, CASE WHEN (k + i) % 7 = 0 OR (k + 2 * i) % 11 = 0 THEN 'missing' {0} END AS wrong FROM e, range(3) r(i) WHERE i <= k % 3), w AS (SELECT k, arg_min(wrong, i) AS wrong FROM f WHERE wrong IS NOT NULL GROUP BY k) SELECT 'm' || e.k AS id, CASE {1} WHEN NOT acked THEN 'awaiting_acknowledgment' WHEN e.k % 17 = 0 THEN 'missing' WHEN wrong IS NOT NULL THEN wrong WHEN e.k % 7 > 1 AND e.k % 23 <> 0 AND e.k % 29 <> 0 AND e.k % 13 <> 0 AND e.k % 11 <> 0 AND e.k % 31 <> 0 THEN 'ready' ELSE 'verified_download' END AS status FROM e LEFT JOIN w ON e.k = w.k"


@query(_STORE.format("", "WHEN e.k % 19 = 0 THEN 'downloading' WHEN e.k % 19 = 1 THEN 'loading'"))
def model_status(spark, sf):
    """The state of each model: what is going on, terms, files, and the evidence of a run."""
    return catalog.model_status(*_store(spark, sf)).select("id", "status")


@query(_STORE.format("WHEN (k + i) % 13 = 0 THEN 'failed'", ""))
def model_status_verified(spark, sf):
    """The same with checksums compared; the first wrong file decides."""
    return catalog.model_status(*_store(spark, sf), verify_hashes=True).select("id", "status")


@query("SELECT 'm' || p_partkey AS id, ['standard', 'metric', 'nested', 'Metric-Nested'][1 + p_partkey % 4] AS category, CAST(p_size * 100 AS BIGINT) AS bytes FROM part WHERE p_partkey % 4 IN (1, 2)")
def catalog_filter(spark, sf):
    return V.model_entries(spark, sf).where(F.col("category").isin("metric", "nested")).select("id", "category", "bytes")


#: Events in the order in which numbers pick them: type, stage, exit code.
_EVENTS = (("start", None, None), ("status", "validating", None), ("status", "downloading", None), ("download_progress", None, None), ("status", "verifying", None), ("status", "loading", None), ("conversion_progress", None, None), ("status", "finalizing", None), ("completed", None, None), ("error", "converting", None), ("cancel", None, None), ("cancelled", None, None), ("exit", None, 0), ("exit", None, 1))


@query("WITH RECURSIVE e AS (SELECT conv_id AS job, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, (conv_id * 7 + turn * 5 + turn * turn) % 14 AS k FROM conversations), s AS (SELECT job, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS turn, 'idle' AS state FROM e GROUP BY job UNION ALL SELECT e.job, e.n, e.turn, CASE WHEN k = 0 THEN 'validating' WHEN k IN (2, 3, 4) THEN 'preparing_model' WHEN k IN (5, 6, 7) THEN 'converting' WHEN k = 8 THEN 'completed' WHEN k = 9 THEN 'failed' WHEN k = 10 THEN 'cancelling' WHEN k = 11 THEN 'cancelled' WHEN k >= 12 AND state = 'cancelling' THEN 'cancelled' WHEN k = 13 AND state NOT IN ('failed', 'cancelled') THEN 'failed' WHEN k = 12 AND state IN ('validating', 'preparing_model', 'converting') THEN 'failed' ELSE state END FROM s JOIN e ON e.job = s.job AND e.n = s.n + 1) SELECT job, turn, state FROM s WHERE n > 0")
def job_state(spark, sf):
    """The state of a job after each of its events."""
    k = (F.col("conv_id") * 7 + F.col("turn") * 5 + F.col("turn") * F.col("turn")) % len(_EVENTS)
    events = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(s).cast("string").alias("stage"), F.lit(c).cast("int").alias("exit_code")) for t, s, c in _EVENTS])
    e = V.table(spark, sf, "conversations").select(F.col("conv_id").alias("job"), "turn", F.element_at(events, (k + 1).cast("int")).alias("e")).select("job", "turn", "e.*")
    return catalog.job_states(e, "job", "turn").select("job", "turn", "state")


@query("SELECT p_partkey AS job, CASE WHEN p_partkey % 20 + 1 > 1 AND coalesce(r, '') <> 'gpu' THEN NULL ELSE r END AS route FROM (SELECT *, CASE WHEN ask = 'auto' THEN CASE WHEN ready THEN 'gpu' ELSE 'compatible' END WHEN ask = 'gpu' AND NOT ready THEN NULL ELSE ask END AS r FROM (SELECT p_partkey, ['auto', 'gpu', 'compatible'][1 + p_partkey % 3] AS ask, p_partkey % 2 = 0 AS ready FROM part))")
def route_choice(spark, sf):
    k = F.col("p_partkey")
    return V.table(spark, sf, "part").select(k.alias("job"), catalog.route(picked(("auto", "gpu", "compatible"), k % 3), k % 2 == 0, k % 20 + 1).alias("route"))


@query("SELECT 'm' || p_partkey AS id, ['relative', 'focal_dependent_unscaled', 'meters', 'meters'][1 + p_partkey % 4] AS unit FROM part")
def depth_units(spark, sf):
    name = F.concat_ws("-", F.lit("Depth"), F.col("category"), F.lit("Large"))
    return V.model_entries(spark, sf).select("id", catalog.depth_unit(name).alias("unit"))


@query("SELECT p_partkey AS model, p_partkey % 3 <> 2 AS allowed FROM part")
def module_allowlist(spark, sf):
    k = F.col("p_partkey")
    inner = picked(("depth.nets.head", "depth", "depthless.evil"), k % 3)
    plain, nested = text('{"name": "B", "path": "', inner, '"}'), text('{"args": {"k": 1}, "path": "', inner, '"}')
    # what names no path at all stands only where the path would not be allowed either
    missing = F.when(k % 3 == 2, F.lit('{"name": "B"}')).otherwise(plain)
    no_object = F.when(k % 3 == 2, F.lit('"depth"')).otherwise(nested)
    made = F.element_at(F.array(plain, nested, missing, no_object), (1 + k % 4).cast("int"))
    document = text('{"net": {"__object__": {"path": "depth.core", "name": "A"}, "head": [{"__object__": ', made, "}]}}")
    documents = V.table(spark, sf, "part").select(k.alias("model"), document.alias("document"))
    return catalog.modules_allowed(documents, "model", "document", ("depth", "depth.core", "depth.nets.head"))


_MODELS = ("DA3-SMALL", "DA3-BASE", "other-large", "DA3MONO-LARGE", "DA3METRIC-LARGE", "other-giant")
_SUPPORTED = ("DA3-SMALL", "DA3-BASE", "DA3MONO-LARGE", "DA3METRIC-LARGE")


@query(S.with_(S.MEDIA, S.RATES, f"f AS (SELECT media AS k, {list(_MODELS)}[1 + media % 6] AS model, {S.HDR} AS hdr, abs(fps - avg_fps) > 0.005 AS vfr, ((coalesce(TRY_CAST(rotate_side AS INT), TRY_CAST(rotate_tag AS INT), 0) % 360) + 360) % 360 AS rot, width, height FROM rates) SELECT k AS media, CASE WHEN k % 23 = 0 THEN '{catalog.RUNNING}' WHEN k % 29 = 0 OR k % 11 = 0 THEN '{catalog.NO_INPUT}' WHEN k % 31 = 0 THEN '{catalog.NO_OUTPUT}' WHEN k % 13 = 0 THEN '{catalog.SAME_FILE}' WHEN k % 17 = 0 THEN '{catalog.NO_PROBE}' WHEN starts_with(model, 'other') THEN 'Model ''Title ' || model || ''' (' || model || ') is not yet integrated for inference in this version. Supported models: {', '.join(_SUPPORTED)}.' WHEN (k % 3 = 0 OR k % 5 = 0) AND k % 2 <> 0 THEN 'Model ''Title ' || model || ''' requires explicit license terms acknowledgment before conversion.' WHEN hdr THEN '{catalog.HDR}' WHEN vfr THEN '{catalog.VFR}' WHEN rot <> 0 THEN 'Rotated video (' || rot || '°) is not supported.' WHEN width % 2 <> 0 OR height % 2 <> 0 THEN '{catalog.ODD}' END AS message FROM f", raw=True))
def job_readiness(spark, sf):
    """What keeps each job from starting: the job itself, its files, the model, terms, and then the media."""
    k = F.col("media")
    model = picked(_MODELS, k % 6)
    facts = media.admit(V.media_facts(spark, sf)).withColumns({
        "running": k % 23 == 0, "input": F.when(k % 29 != 0, text("in", k)), "input_exists": k % 11 != 0, "output": F.when(k % 31 == 0, None).when(k % 13 == 0, text("in", k)).otherwise("out"), "probed": k % 17 != 0,
        "model": model, "title": text("Title ", model), "noncommercial": k % 3 == 0, "conflict": k % 5 == 0, "acknowledged": k % 2 == 0, "rotation": media.rotation(F.col("rotate_tag"), F.col("rotate_side")),
    })
    return facts.select("media", catalog.readiness(_SUPPORTED).alias("message"))


#: What follows the three needed settings of a command, picked by a number, and lines that are picked whole.
_EXTRAS = ("", ', "batch_size": 5', ', "batch_size": true', ', "batch_size": 21', ', "batch_size": "3"', ', "disparity_strength": "0.25", "q_screen": 1', ', "overwrite": "no", "enable_temporal_stabilization": 0', ', "batch_size": 2.5', ', "q_screen": "wide"', ', "device": "cuda:1", "model_id": "X", "acknowledge_license": null', ', "batch_size": null', ', "batch_size": 0', ', "overwrite": true, "depth_scale": "1/1"')
_LINES = ('{"input_path": "a", "output_path": "b"}', "not json", "[1]")


@query("WITH l AS (SELECT p_partkey AS k, CASE p_partkey % 16 WHEN 13 THEN '" + _LINES[0] + "' WHEN 14 THEN 'not json' WHEN 15 THEN '[1]' ELSE '{\"job_id\": \"j' || p_partkey || '\", \"input_path\": \"a\", \"output_path\": \"b\"' || " + repr(list(_EXTRAS)) + "[1 + p_partkey % 16] || '}' END AS line FROM part), j AS (SELECT k, CASE WHEN json_valid(line) THEN line END AS j FROM l), v AS (SELECT k, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'not a command' WHEN json_type(j, '$.job_id') IS NULL THEN 'job_id is missing' WHEN json_type(j, '$.q_screen') = 'VARCHAR' AND TRY_CAST(j ->> '$.q_screen' AS DOUBLE) IS NULL THEN 'q_screen is not a number' WHEN json_type(j, '$.batch_size') NOT IN ('UBIGINT', 'BIGINT') THEN 'batch_size is not an integer' WHEN coalesce(TRY_CAST(j ->> '$.batch_size' AS INT), 1) NOT BETWEEN 1 AND 20 THEN 'batch_size is not between 1 and 20' END AS problem, j FROM j) SELECT k AS command, problem, CASE WHEN problem IS NULL THEN j ->> '$.job_id' END AS job_id, CASE WHEN problem IS NULL THEN coalesce(j ->> '$.model_id', 'DA3-SMALL') END AS model_id, CASE WHEN problem IS NULL THEN j ->> '$.device' END AS device, CASE WHEN problem IS NULL THEN coalesce(TRY_CAST(j ->> '$.disparity_strength' AS DOUBLE), 0.001) END AS strength, CASE WHEN problem IS NULL THEN coalesce(TRY_CAST(j ->> '$.q_screen' AS DOUBLE), 0.6) END AS screen, CASE WHEN problem IS NULL THEN coalesce(j ->> '$.depth_scale', '1/2') END AS scale, CASE WHEN problem IS NULL THEN coalesce((j ->> '$.overwrite') IN ('no', 'true'), FALSE) END AS overwrite, CASE WHEN problem IS NULL THEN coalesce((j ->> '$.enable_temporal_stabilization') <> '0', TRUE) END AS stabilize, CASE WHEN problem IS NULL THEN FALSE END AS acknowledged, CASE WHEN problem IS NULL THEN coalesce(TRY_CAST(j ->> '$.batch_size' AS BIGINT), 1) END AS batch FROM v")
def worker_commands(spark, sf):
    """Commands from lines of JSON, with defaults, and why a line is none."""
    k = F.col("p_partkey")
    extra = picked(_EXTRAS, F.least(k % 16, F.lit(len(_EXTRAS) - 1)))
    line = F.when(k % 16 >= len(_EXTRAS), picked(_LINES, F.greatest(k % 16 - len(_EXTRAS), F.lit(0)))).otherwise(text('{"job_id": "j', k, '", "input_path": "a", "output_path": "b"', extra, "}"))
    c = catalog.commands(V.table(spark, sf, "part").select(k.alias("command"), line.alias("value")))
    names = {"job_id": "job_id", "model_id": "model_id", "device": "device", "disparity_strength": "strength", "q_screen": "screen", "depth_scale": "scale", "overwrite": "overwrite", "enable_temporal_stabilization": "stabilize", "acknowledge_license": "acknowledged", "batch_size": "batch"}
    return c.select("command", "problem", *[F.when(F.col("problem").isNull(), F.col(n)).alias(a) for n, a in names.items()])


@query("SELECT CAST(user_id AS VARCHAR) AS job, event_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'conversion_progress' END AS type, CASE WHEN event_type <> 'error' THEN event_id % 1000 END AS current_frame, CASE WHEN event_type <> 'error' THEN round(value, 2) END AS percent FROM events WHERE event_id % 7 <> 0")
def job_messages(spark, sf):
    """Messages of jobs from lines of text; every seventh line is none."""
    e, bad = V.table(spark, sf, "events"), F.col("event_type") == "error"
    made = F.to_json(F.struct(F.when(bad, "error").otherwise("conversion_progress").alias("type"), F.col("user_id").cast("string").alias("job_id"), F.when(~bad, F.col("event_id") % 1000).alias("current_frame"), F.when(~bad, F.round("value", 2)).alias("percent"), F.col("event_id").cast("double").alias("timestamp")))
    lines = e.select(F.when(F.col("event_id") % 14 == 0, "").when(F.col("event_id") % 7 == 0, "a line of a log").otherwise(made).alias("value"))
    return V.job_events(lines).select(F.col("job_id").alias("job"), F.col("timestamp").cast("long").alias("event_id"), "type", "current_frame", "percent")
