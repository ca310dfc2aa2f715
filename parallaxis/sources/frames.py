"""Frames as tables: synthetic and raw sources, and the views that the test tables become.

Exploded frames have a row for each pixel: ``video, frame, y, x`` and channels.  Packed
frames have a row for each frame, with dimensions and binary planes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, **axes: int) -> DataFrame:
    """Every row for all combinations of the axes' values 0, 1, ... ; no shuffle, no join."""
    for name, n in axes.items():
        df = df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return df


def dealt(df: DataFrame, keys: list[str], partitions: int | None) -> DataFrame:
    """Rows dealt out by keys, into a number of tasks that Spark keeps if it is given."""
    return df.repartition(*keys) if partitions is None else df.repartition(partitions, *keys)


#: Pixels of a task that splats them: each becomes up to six rows, of some hundred bytes in each step.
TASK_PIXELS = 1 << 16


def pixel_partitions(spark: SparkSession, sf_dir: str) -> int:
    """In how many tasks :func:`pixel_rows` keeps within ``TASK_PIXELS`` for each, whatever the table's size."""
    pixels = table(spark, sf_dir, "embeddings").agg(F.sum(F.size("embedding"))).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, -(-pixels // TASK_PIXELS))


#: Rows of a task that does much with each.
TASK_ROWS = 1 << 14


def row_partitions(spark: SparkSession, sf_dir: str, name: str) -> int:
    """In how many tasks a table's rows keep within ``TASK_ROWS`` for each: a small file is one task otherwise."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // TASK_ROWS))


def ramp_frames(spark: SparkSession, frames: int = 24, width: int = 320, height: int = 180) -> DataFrame:
    """The synthetic source: luma ``(x + 3 * frame) mod 256``, chroma 128."""
    rows = spark.range(frames).select(F.col("id").cast("int").alias("frame"))
    return spread(rows, y=height, x=width).select("frame", "y", "x", ((F.col("x") + 3 * F.col("frame")) % 256).alias("luma"), F.lit(128).alias("u"), F.lit(128).alias("v"))


def explode_rgb(packed: DataFrame, width: int) -> DataFrame:
    """Pixels of packed RGB frames, a frame's bytes read once."""
    import numpy as np
    import pyarrow as pa

    names = ("frame", "y", "x", "r", "g", "b")

    def run(batches):
        for batch in batches:
            for frame, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                px = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, 3).astype(np.int32)
                at = np.arange(len(px))
                for low in range(0, len(px), 1 << 16):
                    part = slice(low, low + (1 << 16))
                    columns = [np.full(len(at[part]), frame, np.int64), (at[part] // width).astype(np.int32), (at[part] % width).astype(np.int32), *px[part].T]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    return packed.select(F.col("frame").cast("long").alias("frame"), "data").mapInArrow(run, "frame long, y int, x int, r int, g int, b int")


def images(spark: SparkSession, path: str) -> DataFrame:
    """``path, height, width, data`` (RGB bytes, rows from the top) and ``problem`` of image files.

    Spark's image source decodes what the Java runtime knows (PNG, JPEG, GIF, BMP); binary PPM and
    PGM are read besides.  One channel becomes three and alpha is dropped.  ``problem`` says that a
    file could not be read; its other columns are null.
    """
    import pandas as pd

    from parallaxis.sources.images import from_bgr, netpbm

    def plain(batches):
        for b in batches:
            yield pd.DataFrame([(p, h, w, from_bgr(d, h, w, n), None) for p, h, w, n, d in b.itertuples(index=False)], columns=["path", "height", "width", "data", "problem"])

    def portable(batches):
        for b in batches:
            yield pd.DataFrame([(p, *netpbm(bytes(c))) for p, c in b.itertuples(index=False)], columns=["path", "height", "width", "data", "problem"]).astype({"height": "Int32", "width": "Int32"})

    kind = "path string, height int, width int, data binary, problem string"
    known = F.lower("path").rlike(r"\.p[pgn]m$")
    read = spark.read.format("image").load(path).select("image.*").withColumnRenamed("origin", "path").where(~known)
    good = read.where("height > 0").select("path", "height", "width", "nChannels", "data").mapInPandas(plain, kind)
    bad = read.where("height <= 0").select("path", *[F.lit(None).cast(t).alias(c) for c, t in (("height", "int"), ("width", "int"), ("data", "binary"))], F.lit("unknown format").alias("problem"))
    other = spark.read.format("binaryFile").load(path).where(known).select("path", "content").mapInPandas(portable, kind)
    return good.unionByName(bad).unionByName(other)


def rgb_pixels(data: str):
    """An array of ``r, g, b`` from RGB bytes."""
    level = lambda i: F.conv(F.hex(F.substring(F.col(data), i + 1, F.lit(1))), 16, 10).cast("int")
    n = (F.octet_length(data) / 3).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(level(i * 3).alias("r"), level(i * 3 + 1).alias("g"), level(i * 3 + 2).alias("b")))


def pixel_rows(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """Each embedding as a frame of one row of pixels: depth 2 + v, colour v.

    ``partitions`` fixes into how many tasks the frames are dealt.  They are dealt packed: a task
    that deals pixels buffers many times what it reads.
    """
    packed = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "embedding")
    packed = packed if partitions is None else dealt(packed, ["frame"], partitions)
    rows = packed.select("frame", F.posexplode("embedding").alias("x", "v"))
    return rows.select("frame", F.floor(F.col("x") / 64).cast("int").alias("y"), "x", (F.col("v").cast("double") + 2.0).alias("z"), F.col("v").cast("double").alias("g"))


def square_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a frame of 8 by 8 luma values."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("i", "v"))
    v = F.col("v").cast("double")
    return rows.select("frame", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.rint(F.least(F.greatest(128.0 + 220.0 * v, F.lit(0.0)), F.lit(255.0))).cast("int").alias("luma"))


#: Size, length, cut frame and fade frame of the generated videos.
GEN_H, GEN_W, GEN_FRAMES, GEN_CUT, GEN_FADE = 12, 16, 12, 6, 9


def generated_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video for each nation: a moving texture, a cut, a fade, and a letterbox for even keys."""
    rows = spread(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("video")), frame=GEN_FRAMES, y=GEN_H, x=GEN_W)
    rows = rows.withColumn("cx", (F.col("x") + F.col("frame") * (1 + F.col("video") % 3)).cast("double")).withColumn("cy", F.col("y").cast("double"))
    first = "128 + 50 * sin(cx / 4) * cos(cy / 4) + 40 * sin(cx / 10 + cy / 8) + 25 * cos(cx / 2.5D)"
    second = "128 + 60 * sin(cx / 7) * sin(cy / 5) + 40 * cos(cy / 3)"
    lit = f"CASE WHEN frame = {GEN_FADE} THEN 0.02D ELSE 1.0D END"
    dark = "video % 2 = 0 AND (y < 2 OR y >= 10)"
    luma = F.expr(f"CASE WHEN {dark} THEN 0 ELSE int(floor(least(255.0D, greatest(0.0D, {lit} * (CASE WHEN frame < {GEN_CUT} THEN {first} ELSE {second} END))))) END")
    depth = F.expr(f"CASE WHEN frame < {GEN_CUT} THEN 2 + 0.6D * sin(cx / 16) * cos(cy / 14) + 0.3D * sin(cx / 25) ELSE 4.5D + 1.2D * cos(cx / 20 + cy / 15) END")
    return rows.select("video", "frame", "y", "x", luma.alias("luma"), depth.alias("z"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a user as a frame-wise signal: ``video, frame, value, kind``."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("video"), (F.row_number().over(order) - 1).alias("frame"), "value", F.col("event_type").alias("kind"))


def media_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe facts made up from parts, so that every rule of admission meets some of them."""
    k = F.col("p_partkey")
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        k.alias("media"),
        (F.col("p_size") * 16).alias("width"),
        (F.col("p_size") * 9).alias("height"),
        pick("24/1", "30000/1001", "25", "0/0", "12/1", "N/A", "50/2").alias("rate"),
        pick("24/1", "30000/1001", "25", "30/1", "12/1", "25/1", "50/2", "24000/1001").alias("average"),
        pick("yuv420p", "yuv420p10le", "p010le", "yuv444p12", "gray16", "yuvj420p").alias("pix_fmt"),
        pick(None, None, "8", "10").alias("raw_bits"),
        pick("bt709", "unknown", " SMPTE2084 ", "", "arib-std-b67", "N/A", "bt709").alias("transfer"),
        pick("bt709", None, "bt2020nc", "bt709", "smpte170m", "unknown", "bt709", "bt709", "bt709", "bt709", "bt709").alias("space"),
        pick("bt709", "bt709", None, "bt709", "BT2020", *["bt709"] * 8).alias("primaries"),
        pick("0", "90", "-90", None, "180", "0", "0", "0", "360").alias("rotate_tag"),
        pick(None, None, None, "270").alias("rotate_side"),
        pick("1:1", "1:1", None, "4:3", "1:1").alias("sar"),
        pick("aac", "aac,ac3", "flac", "", "mp3", "aac,opus").alias("codecs"),
        pick(None, "120", "x", None).alias("nb_frames"),
        F.col("p_retailprice").alias("duration"),
    )


def json_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON model catalog, with their files as a map of sizes and checksums."""
    kinds = "models array<struct<id string, repo_id string, ui_name string, category string, license string, noncommercial_ack_required boolean, license_conflict boolean, files map<string, struct<bytes: bigint, sha256: string>>>>"
    return spark.read.schema(kinds).option("multiLine", True).json(path).select(F.inline("models"))


def model_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries made up from parts: ``key, id, repo, name, category, noncommercial, conflict, files, bytes``."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("standard", "metric", "nested", "Metric-Nested"))), (1 + k % 4).cast("int"))
    of = lambda prefix: F.concat(F.lit(prefix), k)
    return table(spark, sf_dir, "part").select(
        k.alias("key"), of("m").alias("id"), of("lab/Depth-").alias("repo"), of("Model ").alias("name"), kind.alias("category"),
        (k % 3 == 0).alias("noncommercial"), (k % 5 == 0).alias("conflict"), (1 + k % 3).cast("int").alias("files"), (F.col("p_size") * 100).cast("long").alias("bytes"),
    )


def job_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Protocol messages from text lines; lines that are no message are dropped."""
    kind = "type string, job_id string, stage string, message string, current_frame long, total_frames long, percent double, fps double, timestamp double"
    parsed = lines.select(F.from_json(column, kind, {"mode": "PERMISSIVE"}).alias("m"))
    return parsed.where("m.type is not null").select("m.*")
