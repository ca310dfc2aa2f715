"""Metrics of jobs and stages, progress, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stage_means(rows: DataFrame, keys: list[str], stage: str, value: str) -> DataFrame:
    return rows.groupBy(*keys, stage).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def job_summary(rows: DataFrame, keys: list[str], value: str, ts: str) -> DataFrame:
    """Frames, interpolated 95th percentile, and frames per second of the time spanned (0 if none)."""
    span = (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / 1e6
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.coalesce(F.percentile(value, F.lit(0.95)), F.lit(0.0)).alias("p95"), span.alias("seconds"))
    return out.withColumn("fps", F.when(F.col("seconds") > 0, F.col("frames") / F.col("seconds")).otherwise(0.0))


def batch_report(jobs: DataFrame, key: str = "input") -> DataFrame:
    """``jobs, ok, failed``, frames per second of the time spent, and the different ``warnings``, of each input."""
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_set("warnings"))))
    out = jobs.groupBy(key).agg(F.count(F.lit(1)).alias("jobs"), F.count_if("ok").alias("ok"), F.sum("frames").alias("_frames"), F.sum("seconds").alias("_seconds"), every.alias("warnings"))
    fps = F.when(F.col("_seconds") > 0, F.col("_frames") / F.col("_seconds")).otherwise(0.0)
    return out.withColumn("failed", F.col("jobs") - F.col("ok")).withColumn("fps", fps).drop("_frames", "_seconds")


def bottlenecks(rows: DataFrame, keys: list[str], stage: str, value: str, ends: tuple[str, str], middle: str, factor: float = 1.2) -> DataFrame:
    """Whether the means of the two end stages outweigh the middle's; one aggregate, no pivot join."""
    mean = lambda s: F.coalesce(F.avg(F.when(F.col(stage) == s, F.col(value))), F.lit(0.0))
    out = rows.groupBy(*keys).agg((mean(ends[0]) + mean(ends[1])).alias("outer_ms"), mean(middle).alias("middle_ms"))
    return out.withColumn("io_bound", F.col("outer_ms") > factor * F.col("middle_ms"))


def progress(rows: DataFrame, job: str, frame: str, ts: str, total: str, least_seconds: float = 0.05) -> DataFrame:
    """Percent, recent frames per second and seconds left, from each event and the one before."""
    order = W.partitionBy(job).orderBy(frame)
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(F.col(ts).cast("timestamp")).over(order))) / 1e6
    out = rows.withColumn("seconds", seconds).withColumn("frames", F.col(frame) - F.lag(frame).over(order))
    fps = F.when(F.col("seconds") > least_seconds, F.col("frames") / F.col("seconds"))
    out = out.withColumn("percent", 100.0 * F.col(frame) / F.col(total)).withColumn("fps", fps)
    return out.withColumn("eta", F.when(F.col("fps") > 0, (F.col(total) - F.col(frame)) / F.col("fps")))


# The columns of the metrics file, in its order, and the stages that have means.
REPORT = ("frame_index", "frame_ms", "kernel_ms", "decode_wait_ms", "encode_wait_ms", "h2d_ms", "kernel_compute_ms", "d2h_ms", "queue_depth", "block_wait_ms")
STAGES = ("kernel_ms", "decode_wait_ms", "encode_wait_ms", "h2d_ms", "kernel_compute_ms", "d2h_ms", "block_wait_ms")


def stage_averages(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of each stage, and whether waiting to decode and encode outweighs the kernel by a fifth."""
    out = rows.groupBy(*keys).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c in STAGES])
    return out.withColumn("io_bound", F.col("avg_decode_wait_ms") + F.col("avg_encode_wait_ms") > 1.2 * F.col("avg_kernel_ms"))


def report_rows(rows: DataFrame, columns: tuple[str, ...] = REPORT) -> DataFrame:
    """The metrics file's columns in its order, doubles as text of four decimals."""
    kinds = dict(rows.dtypes)
    return rows.select(*[F.format_string("%.4f", F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns])


def write_report(rows: DataFrame, path: str, columns: tuple[str, ...] = REPORT) -> None:
    """CSV with a header."""
    report_rows(rows, columns).write.mode("overwrite").csv(path, header=True)


def write_report_json(rows: DataFrame, path: str, columns: tuple[str, ...] = REPORT) -> None:
    """A JSON object for each frame, with numbers as numbers."""
    rows.select(*columns).write.mode("overwrite").json(path)


def benchmark_markdown(jobs: DataFrame) -> DataFrame:
    """Adds ``report``: a job's page of Markdown, from ``backend, output, frames_in, frames_out, elapsed_s, avg_fps, p95_kernel_ms, warnings``."""
    number = lambda c: F.format_string("%.4f", F.col(c).cast("double"))
    item = lambda name, value: F.concat(F.lit(f"- {name}: `"), value, F.lit("`"))
    warnings = F.when(F.size(F.coalesce("warnings", F.array().cast("array<string>"))) == 0, F.array(F.lit("- none"))).otherwise(F.transform("warnings", lambda w: F.concat(F.lit("- "), w)))
    head = F.array(
        F.lit("# Benchmark Report"), F.lit(""), item("Backend", F.col("backend")), item("Output", F.col("output")), item("Frames in", F.col("frames_in").cast("string")), item("Frames out", F.col("frames_out").cast("string")),
        item("Elapsed s", number("elapsed_s")), item("Avg FPS", number("avg_fps")), item("p95 kernel ms", number("p95_kernel_ms")), F.lit(""), F.lit("## Warnings"),
    )
    return jobs.withColumn("report", F.array_join(F.concat(head, warnings, F.array(F.lit(""))), "\n"))
