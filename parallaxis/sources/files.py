"""Data sources in Python: raw video frames as planes, and depth maps as files for other tools.

    spark.read.format("raw_frames").option("width", 1920).option("height", 1080).load(path)
    frames.write.format("depth_files").option("path", folder).mode("append").save()

Register them with :func:`register`.  Paths are those that ``pyarrow.fs`` reads (local or shared
mounts, ``file:``, ``hdfs:``, ``s3:`` ...); executors open them by themselves.

Writing is all or nothing: tasks write below a hidden folder, each attempt in a part of its own,
and the job's commit drops the parts of attempts that did not count and moves the folder into
place by one rename.  An attempt that fails removes its own part; an aborted job removes all.
"""

from __future__ import annotations

import io
import json
import posixpath
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes that a partition covers unless the option ``partitionBytes`` says otherwise, and bytes of a batch.
PARTITION, BATCH = 64 << 20, 8 << 20


def located(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def files_below(path: str, suffix: str = "") -> list:
    """Files of a folder (hidden ones and markers left out) or the file itself, by path, with sizes."""
    from pyarrow import fs

    system, at = located(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [info]
    found = [f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(suffix)]
    shown = lambda f: not any(part.startswith((".", "_")) for part in posixpath.relpath(f.path, at).split("/"))
    return sorted(filter(shown, found), key=lambda f: f.path)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or in a local session the temporary directory."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/parallaxis"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def positive(options, name: str) -> int:
    value = options.get(name)
    if value is None or not str(value).isdigit() or int(value) < 1:
        raise ValueError(f"option {name} must be a positive integer, got {value!r}")
    return int(value)


# -- raw frames ---------------------------------------------------------------------------


#: The planes of a layout: name, divisor of both sides, bytes for each place.
LAYOUTS = {"rgb24": (("rgb", 1, 3),), "nv12": (("y", 1, 1), ("uv", 2, 2)), "gray8": (("y", 1, 1),)}


@dataclass
class Frames:
    """Options of raw files, checked when the source is planned."""

    width: int
    height: int
    layout: str

    @classmethod
    def of(cls, options) -> Frames:
        layout = options.get("layout", "rgb24")
        if layout not in LAYOUTS:
            raise ValueError(f"option layout must be one of {sorted(LAYOUTS)}, got {layout!r}")
        width, height = positive(options, "width"), positive(options, "height")
        if layout == "nv12" and (width % 2 or height % 2):
            raise ValueError(f"nv12 has even sides, got {width} by {height}")
        return cls(width, height, layout)

    def planes(self) -> list[tuple[str, int, int, int]]:
        """Name, rows, columns and bytes for each place of the planes."""
        return [(name, self.height // d, self.width // d, n) for name, d, n in LAYOUTS[self.layout]]

    @property
    def nbytes(self) -> int:
        return sum(h * w * n for _, h, w, n in self.planes())


@dataclass
class ByteRange(InputPartition):
    path: str
    first: int
    count: int


PLANES = pa.schema([("path", pa.string()), ("frame", pa.int64()), ("plane", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])
PLANES_COLUMNS = "path string, frame long, plane string, height int, width int, data binary"


class RawReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.frames = options.get("path"), Frames.of(options)
        self.nbytes = int(options.get("partitionBytes", PARTITION))
        if not self.path:
            raise ValueError("a path is needed")

    def partitions(self) -> list[ByteRange]:
        size, out = self.frames.nbytes, []
        step = max(1, self.nbytes // size)
        for f in files_below(self.path):
            if f.size % size:
                raise ValueError(f"{f.path} ends within a frame: {f.size} bytes are no multiple of {size}")
            out += [ByteRange(f.path, k, min(step, f.size // size - k)) for k in range(0, f.size // size, step)]
        return out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.path)
        planes, size = self.frames.planes(), self.frames.nbytes
        step = max(1, BATCH // size)
        with system.open_input_file(partition.path) as f:
            for k in range(partition.first, partition.first + partition.count, step):
                n = min(step, partition.first + partition.count - k)
                f.seek(k * size)
                raw, rows = memoryview(f.read(n * size)), []
                if len(raw) != n * size:
                    raise ValueError(f"{partition.path} became shorter while it was read")
                for j in range(n):
                    at = j * size
                    for name, h, w, each in planes:
                        rows.append((partition.path, k + j, name, h, w, bytes(raw[at : at + h * w * each])))
                        at += h * w * each
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), PLANES, strict=True)], schema=PLANES)


class RawFrames(DataSource):
    """Fixed-length frames of raw files: a row for each plane of each frame (numbered in its file).

    Options: ``path``, ``width``, ``height``, ``layout`` (rgb24, nv12, gray8), ``partitionBytes``.
    A partition is a range of bytes; a file that ends within a frame is an error before any
    task starts.  Written rows are ``frame, data`` with whole frames; each task writes one file.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return PLANES_COLUMNS

    def reader(self, schema) -> RawReader:
        return RawReader(self.options)

    def writer(self, schema, overwrite: bool) -> RawWriter:
        return RawWriter(self.options, overwrite)


# -- writing --------------------------------------------------------------------------------


@dataclass
class Part(WriterCommitMessage):
    folder: str
    rows: int


class FolderWriter(DataSourceArrowWriter):
    """Tasks write parts of a hidden folder, which the commit renames; subclasses write the rows of a part."""

    def __init__(self, options, overwrite: bool):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("a path is needed")
        if overwrite:
            raise ValueError("append only: a batch never replaces another")
        self.batch = f"batch-{uuid.uuid4().hex}"
        self.hidden = f"{self.path.rstrip('/')}/.{self.batch}"

    def rows(self, system, folder: str, batches: Iterator[pa.RecordBatch]) -> int:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, hidden = located(self.hidden)
        folder = f"{hidden}/part-{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        try:
            return Part(posixpath.basename(folder), self.rows(system, folder, iterator))
        except BaseException:
            system.delete_dir(folder)
            raise

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, hidden = located(self.hidden)
        system.create_dir(hidden, recursive=True)
        kept = {m.folder for m in messages if m is not None and m.rows}
        for part in system.get_file_info(fs.FileSelector(hidden)):
            if posixpath.basename(part.path) not in kept:
                system.delete_dir(part.path)
        system.move(hidden, f"{posixpath.dirname(hidden)}/{self.batch}")

    def abort(self, messages) -> None:
        system, hidden = located(self.hidden)
        if system.get_file_info(hidden).is_file is False and system.get_file_info(hidden).type.name == "Directory":
            system.delete_dir(hidden)


class RawWriter(FolderWriter):
    def __init__(self, options, overwrite: bool):
        super().__init__(options, overwrite)
        self.frames = Frames.of(options)

    def rows(self, system, folder, batches) -> int:
        n = 0
        with system.open_output_stream(f"{folder}/frames.raw") as f:
            for b in batches:
                for data in b.column(b.schema.get_field_index("data")):
                    raw = data.as_py()
                    if raw is None or len(raw) != self.frames.nbytes:
                        raise ValueError(f"a frame has {self.frames.nbytes} bytes, not {None if raw is None else len(raw)}")
                    f.write(raw)
                    n += 1
        return n


# -- depth maps as files -----------------------------------------------------------------------

#: Colours that the colour map passes through, from far to near (a parameter of :func:`coloured`).
ANCHORS = ((0, 0, 4), (40, 11, 84), (101, 21, 110), (159, 42, 99), (212, 72, 66), (245, 125, 21), (250, 193, 39), (252, 255, 164))


def stretched(depth: np.ndarray, levels: int) -> np.ndarray:
    """Minimum to maximum as 0 to ``levels``, truncated; a flat map is 0."""
    low, high = depth.min(), depth.max()
    if abs(high - low) < 1e-8:
        return np.zeros(depth.shape, np.uint16)
    return ((depth - low) / (high - low) * levels).astype(np.uint16)


def coloured(depth: np.ndarray, anchors=ANCHORS) -> np.ndarray:
    """RGB bytes: 256 levels of depth along a line through the anchors."""
    at = stretched(depth, 255) / 255 * (len(anchors) - 1)
    table = np.array(anchors, float)
    return np.stack([np.rint(np.interp(at, np.arange(len(anchors)), table[:, c])) for c in range(3)], axis=-1).astype(np.uint8)


def png(px: np.ndarray) -> bytes:
    """A PNG of 8 bits RGB or 16 bits gray."""
    gray = px.ndim == 2
    raw = (px.astype(">u2") if gray else px).tobytes()
    stride = len(raw) // px.shape[0]
    lines = b"".join(b"\0" + raw[k : k + stride] for k in range(0, len(raw), stride))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", px.shape[1], px.shape[0], 16 if gray else 8, 0 if gray else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


class DepthWriter(FolderWriter):
    """For each row ``video, frame, h, w, depth``: values (npy), 16 bits gray and colours (png), and measures (json)."""

    def rows(self, system, folder, batches) -> int:
        n = 0
        for b in batches:
            for r in b.to_pylist():
                z = np.asarray(r["depth"], float)
                if z.size != r["h"] * r["w"] or not z.size or not np.isfinite(z).all() or (z <= 0).any():
                    raise ValueError(f"depth of frame {r['frame']} of {r['video']} is not positive, finite and of its size")
                z = z.reshape(r["h"], r["w"])
                values = io.BytesIO()
                np.save(values, z)
                facts = {"video": r["video"], "frame": r["frame"], "shape": list(z.shape), "min_depth": float(z.min()), "max_depth": float(z.max()), "mean_depth": float(z.mean())}
                files = {".npy": values.getvalue(), "_u16.png": png(stretched(z, 65535)), "_color.png": png(coloured(z)), "_metrics.json": json.dumps(facts, indent=2).encode()}
                for end, content in files.items():
                    with system.open_output_stream(f"{folder}/depth_{r['video']}_{r['frame']}{end}") as f:
                        f.write(content)
                n += 1
        return n


@dataclass
class Files(InputPartition):
    paths: list


DEPTHS = pa.schema([("video", pa.int64()), ("frame", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("depth", pa.list_(pa.float64())), ("min_depth", pa.float64()), ("max_depth", pa.float64()), ("mean_depth", pa.float64())])


class DepthReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.nbytes = options.get("path"), int(options.get("partitionBytes", PARTITION))

    def partitions(self) -> list[Files]:
        out, size = [], self.nbytes
        for f in files_below(self.path, ".npy"):
            if size >= self.nbytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as f:
                z = np.load(io.BytesIO(f.read()))
            with system.open_input_file(path[: -len(".npy")] + "_metrics.json") as f:
                facts = json.loads(f.read())
            row = [facts["video"], facts["frame"], *z.shape, z.ravel().tolist(), *(facts[k] for k in ("min_depth", "max_depth", "mean_depth"))]
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, DEPTHS, strict=True)], schema=DEPTHS)


class DepthFiles(DataSource):
    """Depth maps as files for other tools, a batch of a job in one folder; read again from values and measures."""

    @classmethod
    def name(cls) -> str:
        return "depth_files"

    def schema(self) -> str:
        return "video long, frame long, h int, w int, depth array<double>, min_depth double, max_depth double, mean_depth double"

    def reader(self, schema) -> DepthReader:
        return DepthReader(self.options)

    def writer(self, schema, overwrite: bool) -> DepthWriter:
        return DepthWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    for source in (RawFrames, DepthFiles):
        spark.dataSource.register(source)
    return spark


def raw_frames(spark: SparkSession, path: str, width: int, height: int, layout: str = "rgb24") -> DataFrame:
    """The rows of ``raw_frames`` files: ``path, frame, plane, height, width, data``."""
    return register(spark).read.format("raw_frames").option("width", width).option("height", height).option("layout", layout).load(path)


def plane_pixels(planes: DataFrame) -> DataFrame:
    """Pixels of planes, ``plane, frame, y, x, c, value`` (``c``: the byte of a place), without a shuffle.

    Bytes become numbers in Arrow batches, a part of a plane at a time.
    """
    schema = pa.schema([("path", pa.string()), ("frame", pa.int64()), ("plane", pa.string()), *[(c, pa.int32()) for c in ("y", "x", "c", "value")]])

    def run(batches):
        for b in batches:
            for path, frame, plane, height, width, data in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                px = np.frombuffer(data, np.uint8).reshape(height, width, -1)
                for top in range(0, height, max(1, (1 << 16) // (width * px.shape[2]))):
                    part = px[top : top + max(1, (1 << 16) // (width * px.shape[2]))]
                    y, x, c = (np.broadcast_to(a, part.shape).ravel().astype(np.int32) for a in np.ogrid[: part.shape[0], : part.shape[1], : part.shape[2]])
                    n = part.size
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.full(n, frame)), pa.array([plane] * n), pa.array(y + np.int32(top)), pa.array(x), pa.array(c), pa.array(part.ravel().astype(np.int32))], schema=schema)

    return planes.select("path", "frame", "plane", "height", "width", "data").mapInArrow(run, "path string, frame long, plane string, y int, x int, c int, value int")


def nv12_pixels(planes: DataFrame) -> DataFrame:
    """Exploded frames ``path, frame, y, x, luma, u, v``: each luma takes the chroma of its two by two places."""
    px = plane_pixels(planes)
    keys = ["path", "frame"]
    chroma = px.where("plane = 'uv'").groupBy(*keys, F.col("y").alias("_y"), F.col("x").alias("_x")).agg(F.max(F.when(F.col("c") == 0, F.col("value"))).alias("u"), F.max(F.when(F.col("c") == 1, F.col("value"))).alias("v"))
    luma = px.where("plane = 'y'").select(*keys, "y", "x", F.col("value").alias("luma"), F.floor(F.col("y") / 2).cast("int").alias("_y"), F.floor(F.col("x") / 2).cast("int").alias("_x"))
    return luma.join(chroma, [*keys, "_y", "_x"]).drop("_y", "_x")
