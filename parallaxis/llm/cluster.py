"""Shared-folder tables and small helpers that every operator of this subpackage uses.

Intermediate results that cut lineage are written as Parquet below the folder named by
``spark.checkpoint.dir``, which driver and executors share; a lost executor only costs a
re-read.  Where that setting is absent a cluster is an error; a session in one process (tests,
notebooks) uses a folder below the system's temporary directory.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written tables."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return it re-read.

    The table is a checkpoint: what is built on it never recomputes ``df``.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, so that no other column's name can clash."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batches, rows: int = 512, nbytes: int = 4 << 20):
    """Cut Arrow batches into slices of at most ``rows`` rows and about ``nbytes`` bytes.

    A slice is what an operator holds decoded at once, so memory does not follow the
    batch size set for the session.  A single longer text is a slice by itself.
    """
    for batch in batches:
        start, n = 0, batch.num_rows
        if not n:
            continue
        mean = max(1, batch.nbytes // n)
        step = max(1, min(rows, nbytes // mean))
        while start < n:
            yield batch.slice(start, min(step, n - start))
            start += step


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch from Python lists or NumPy arrays, in the order of ``schema``."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


_held: dict = {}


def held(key, make):
    """What ``make()`` gives for ``key``, kept by this Python worker until another key is asked for.

    Workers outlive stages.  Keeping one object at a time bounds what they hold to the
    largest one, not to the sum over all operators that ran before.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drop what :func:`held` keeps: for operators that hold nothing but follow one that does, in the same workers."""
    _held.clear()
