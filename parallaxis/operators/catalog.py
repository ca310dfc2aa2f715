"""Lookup and status of catalog entries, licences, and the state of jobs from their events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup(entries: DataFrame, wanted: DataFrame, name: str = "wanted", order: str = "position") -> DataFrame:
    """The entry each wanted name means: that of exactly this id, else the first of the catalog with such a name.

    Names are ids, repositories, titles and repositories' tails, without regard to case and outer
    blanks.  Each name is reduced to its first entry before it is joined, so a name that many
    entries share costs nothing.  ``exact`` says how it was found; both are null if there is none.
    """
    tail = F.element_at(F.split("repo", "/"), -1)
    names = F.explode(F.array_distinct(F.array(F.lower("id"), F.lower("repo"), F.lower("name"), F.lower(tail))))
    first = entries.select("id", order, names.alias("_name")).groupBy("_name").agg(F.min_by("id", order).alias("_first"))
    own = entries.groupBy(F.col("id").alias("_own")).agg(F.count(F.lit(1)).alias("_n"))
    found = wanted.withColumn("_key", F.lower(F.trim(name))).join(own, F.col(name) == F.col("_own"), "left").join(first, F.col("_key") == F.col("_name"), "left")
    out = found.withColumn("id", F.coalesce("_own", "_first"))
    return out.withColumn("exact", F.when(F.col("id").isNotNull(), F.col("_own").isNotNull())).select(*wanted.columns, "id", "exact")


def license_gate(entries: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Whether an entry needs an acknowledgement, and whether it may be used."""
    acks = acknowledged.select("id").distinct().withColumn("acked", F.lit(True))
    out = entries.join(acks, "id", "left").withColumn("acked", F.coalesce("acked", F.lit(False)))
    out = out.withColumn("needs", F.col("noncommercial") | F.col("conflict"))
    return out.withColumn("usable", ~F.col("needs") | F.col("acked"))


MANIFEST = "revision string, model_id string, runtime_probe_verified boolean, files map<string, struct<sha256: string, bytes: bigint>>"


def ready_evidence(id_, repo, revision, files, marker, manifest):
    """Whether a marker's text and a manifest (JSON) prove that this revision, with these ``files``, has been run.

    The marker names the revision; the manifest has revision, model, a verified probe, and the
    size and checksum of every file of the catalog's entry.
    """
    m = F.from_json(manifest, MANIFEST)
    same = F.forall(F.map_entries(files), lambda f: F.coalesce((F.lower(F.element_at(m["files"], f["key"])["sha256"]) == F.lower(f["value"]["sha256"])) & (F.element_at(m["files"], f["key"])["bytes"] == f["value"]["bytes"]), F.lit(False)))
    told = F.contains(marker, F.concat(F.lit("READY "), revision)) & (m["revision"] == revision) & ((m["model_id"] == repo) | (m["model_id"] == id_)) & m["runtime_probe_verified"]
    return F.coalesce(told & m["files"].isNotNull() & same, F.lit(False))


def model_status(entries: DataFrame, found: DataFrame, verify_hashes: bool = False) -> DataFrame:
    """``status`` of each entry of ``id, active, acknowledged, folder, ready``.

    ``found`` has a row for each file of an entry in the catalog's order: ``id, position, present,
    right_size, right_hash``; the first file with a problem decides.  Checksums count only with
    ``verify_hashes``, which also passes over what is said to be going on (``active``).
    """
    wrong = F.when(~F.col("present") | ~F.col("right_size"), "missing")
    wrong = wrong.when(~F.col("right_hash"), "failed") if verify_hashes else wrong
    first = found.withColumn("_wrong", wrong).where("_wrong is not null").groupBy("id").agg(F.min_by("_wrong", "position").alias("_wrong"))
    status = F.when(F.lit(not verify_hashes) & F.col("active").isin("downloading", "loading"), F.col("active")).when(~F.col("acknowledged"), "awaiting_acknowledgment")
    status = status.when(~F.col("folder"), "missing").when(F.col("_wrong").isNotNull(), F.col("_wrong")).when(F.col("ready"), "ready").otherwise("verified_download")
    return entries.join(first, "id", "left").withColumn("status", status).drop("_wrong")


# What an event makes of a job, by its type and, for status messages, its stage (fixed values of
# the protocol; start, cancel and exit are what the job's owner and its process do).
STATES = {
    ("start", None): "validating", ("cancel", None): "cancelling",
    ("status", "downloading"): "preparing_model", ("status", "verifying"): "preparing_model",
    ("status", "loading"): "converting", ("status", "converting"): "converting", ("status", "finalizing"): "converting",
    ("download_progress", None): "preparing_model", ("conversion_progress", None): "converting",
    ("completed", None): "completed", ("error", None): "failed", ("cancelled", None): "cancelled",
}


def job_states(events: DataFrame, job: str, order: str, kind: str = "type", stage: str = "stage", code: str = "exit_code") -> DataFrame:
    """The state after each event, from ``idle`` on.

    Most events say the state by themselves.  An ``exit`` looks at the one before: a job being
    cancelled is cancelled; a code other than 0 fails any job that is neither failed nor
    cancelled; code 0 fails a job that was still at work.  As exits change a state only in these
    ways, the last telling event and the exits since decide, which are two windows of one order.
    Other events change nothing.
    """
    told = None
    for (type_, at), state in STATES.items():
        here = (F.col(kind) == type_) & ((F.col(stage) == at) if at else F.lit(True))
        told = F.when(here, state) if told is None else told.when(here, state)
    so_far = W.partitionBy(job).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = events.withColumn("_told", told).withColumn("_part", F.count("_told").over(so_far)).withColumn("_state", F.coalesce(F.last("_told", ignorenulls=True).over(so_far), F.lit("idle")))
    since = W.partitionBy(job, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    left = F.col(kind) == "exit"
    rows = rows.withColumn("_exit", F.max(left).over(since)).withColumn("_bad", F.max(left & (F.coalesce(F.col(code), F.lit(1)) != 0)).over(since))
    state = F.when(F.col("_exit") & (F.col("_state") == "cancelling"), "cancelled").when(F.col("_bad") & ~F.col("_state").isin("failed", "cancelled"), "failed")
    state = state.when(F.col("_exit") & F.col("_state").isin("validating", "preparing_model", "converting"), "failed").otherwise(F.col("_state"))
    return rows.withColumn("state", state).drop("_told", "_part", "_state", "_exit", "_bad")


def route(requested, gpu_ready, batch):
    """The route of a job: ``gpu`` or ``compatible``; batches need the first; null where that cannot be."""
    ask = F.when((requested == "auto") & gpu_ready, "gpu").when(requested == "auto", "compatible").when((requested == "gpu") & ~gpu_ready, None).otherwise(requested)
    return F.when((batch > 1) & (F.coalesce(ask, F.lit("")) != "gpu"), None).otherwise(ask)


def depth_unit(name):
    """What a model's depths mean, by its name: metres, focal-dependent, or relative."""
    n = F.lower(name)
    return F.when(n.contains("nested"), "meters").when(n.contains("metric"), "focal_dependent_unscaled").otherwise("relative")


def modules_allowed(documents: DataFrame, key: str, text: str, modules: tuple[str, ...]) -> DataFrame:
    """``key, allowed``: whether every ``__object__`` of a JSON text, at any depth, is an object whose path is one of ``modules``.

    A text that is missing or cannot be read (or repeats a name in an object) is not allowed, nor is
    a definition without a path.  The texts become variants, and a recursive table expression
    walks down their objects and arrays, level by level.  Rows of one key (not null) are judged
    together.  The session's limit on rows of recursions is lifted, as these grow with the table.
    """
    spark = documents.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    known = F.array(*[F.lit(m) for m in modules])
    rows = documents.select(documents[key].alias("key"), documents[text].cast("string").alias("text"))
    inside = "schema_of_variant(n.node) LIKE 'OBJECT%' OR schema_of_variant(n.node) LIKE 'ARRAY%'"
    nodes = spark.sql(
        "WITH RECURSIVE nodes(key, name, node) MAX RECURSION LEVEL 2000 AS (SELECT key, CAST(NULL AS STRING), try_parse_json(text) FROM {docs} "
        f"UNION ALL SELECT n.key, e.key, e.value FROM nodes n, LATERAL variant_explode(n.node) e WHERE {inside}) SELECT * FROM nodes", docs=rows,
    )
    path = F.expr("CASE WHEN schema_of_variant(try_variant_get(node, '$.path', 'variant')) = 'STRING' THEN try_variant_get(node, '$.path', 'string') END")
    bad = F.when(F.col("name") == "__object__", ~F.coalesce(F.array_contains(known, path), F.lit(False))).otherwise(F.col("node").isNull() & F.col("name").isNull())
    return nodes.groupBy("key").agg((~F.max(bad)).alias("allowed")).withColumnRenamed("key", key)


# What keeps a job from starting, in the order in which it is asked (fixed texts).
RUNNING, NO_INPUT, NO_OUTPUT, SAME_FILE, NO_PROBE = (
    "A conversion job is already running.", "Please select an existing input video file.", "Please choose an output file location.",
    "Input and output files cannot be identical.", "Input video has not been probed or probe failed.",
)
HDR, VFR, ODD = "HDR input is not supported in the current vertical slice.", "Variable Frame Rate (VFR) is not supported; CFR required.", "Odd frame dimensions are not supported for Full-SBS 4:2:0 export."


def readiness(supported: tuple[str, ...]):
    """The first thing that keeps a job from starting, null if nothing does, from a row's facts.

    Columns: ``running, input_exists, input, output, probed, model, title, noncommercial, conflict,
    acknowledged, hdr, vfr, rotation, width, height``.
    """
    c = F.col
    not_yet = F.concat(F.lit("Model '"), c("title"), F.lit("' ("), c("model"), F.lit(f") is not yet integrated for inference in this version. Supported models: {', '.join(supported)}."))
    terms = F.concat(F.lit("Model '"), c("title"), F.lit("' requires explicit license terms acknowledgment before conversion."))
    asked = (
        (c("running"), F.lit(RUNNING)), (c("input").isNull() | ~c("input_exists"), F.lit(NO_INPUT)), (c("output").isNull(), F.lit(NO_OUTPUT)), (c("input") == c("output"), F.lit(SAME_FILE)), (~c("probed"), F.lit(NO_PROBE)),
        (~c("model").isin(*supported), not_yet), ((c("noncommercial") | c("conflict")) & ~c("acknowledged"), terms),
        (c("hdr"), F.lit(HDR)), (c("vfr"), F.lit(VFR)), (c("rotation") != 0, F.concat(F.lit("Rotated video ("), c("rotation").cast("string"), F.lit("°) is not supported."))),
        ((c("width") % 2 != 0) | (c("height") % 2 != 0), F.lit(ODD)),
    )
    return F.coalesce(*[F.when(F.coalesce(holds, F.lit(False)), text) for holds, text in asked])


# A command's settings and their values where a message has none (fixed values of the protocol).
COMMAND = {
    "model_id": "DA3-SMALL", "device": None, "disparity_strength": 0.001, "q_screen": 0.6, "depth_scale": "1/2", "pipeline_route": "auto", "enable_temporal_stabilization": True, "overwrite": False,
    "acknowledge_license": False, "cancel_file": None, "ffmpeg_path": None, "ffprobe_path": None, "protocol_version": "1.0", "batch_size": 1,
}
NEEDED = ("job_id", "input_path", "output_path")


def commands(lines: DataFrame, column: str = "value") -> DataFrame:
    """Commands from text lines, with defaults for what a line leaves out, and ``problem``: why a line is none.

    Needed settings must be there; numbers may come as texts; truth is what is neither false, 0,
    empty nor null; a batch is an integer from 1 to 20 and neither a text nor a truth value.
    """
    v = F.try_parse_json(column)
    kind = lambda n: F.expr(f"schema_of_variant(try_variant_get(_v, '$.{n}', 'variant'))")
    text = lambda n: F.expr(f"try_variant_get(_v, '$.{n}', 'string')")
    rows = lines.withColumn("_v", v)

    def setting(name, default):
        absent = kind(name).isNull()
        if isinstance(default, bool):
            held = F.when(kind(name).startswith("BOOLEAN"), F.expr(f"try_variant_get(_v, '$.{name}', 'boolean')")).when(kind(name) == "VOID", F.lit(False)).when(kind(name) == "STRING", text(name) != "")
            return F.when(absent, F.lit(default)).otherwise(F.coalesce(held, F.expr(f"try_variant_get(_v, '$.{name}', 'double')") != 0, F.lit(True)))
        if isinstance(default, float):
            number = F.expr(f"coalesce(try_variant_get(_v, '$.{name}', 'double'), try_cast(try_variant_get(_v, '$.{name}', 'string') AS double))")
            return F.when(absent, F.lit(default)).otherwise(number)
        if isinstance(default, int):
            return F.when(absent, F.lit(default).cast("long")).when(kind(name) == "BIGINT", F.expr(f"try_variant_get(_v, '$.{name}', 'bigint')"))
        return F.when(absent, F.lit(default).cast("string")).otherwise(text(name))

    rows = rows.withColumns({n: text(n) for n in NEEDED} | {n: setting(n, d) for n, d in COMMAND.items()})
    problem = F.when(F.col("_v").isNull() | ~F.expr("schema_of_variant(_v)").startswith("OBJECT"), "not a command")
    for n in NEEDED:
        problem = problem.when(kind(n).isNull(), f"{n} is missing")
    for n in ("disparity_strength", "q_screen"):
        problem = problem.when(F.col(n).isNull(), f"{n} is not a number")
    problem = problem.when(F.col("batch_size").isNull(), "batch_size is not an integer").when(~F.col("batch_size").between(1, 20), "batch_size is not between 1 and 20")
    return rows.withColumn("problem", problem).drop("_v")
