"""Tables that appear whole or not at all: stage, check, promote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame


class CommitError(Exception):
    """The staged table failed its checks, or its place is taken."""


def commit(df: DataFrame, path: str, checks: dict[str, Callable[[DataFrame], bool]], overwrite: bool = False) -> None:
    """Write ``df`` beside ``path``, run ``checks`` on what was written, then move it into place.

    Replacing takes two renames, between which there is no table: where readers must always see
    one, or writers may meet, use :class:`parallaxis.plans.versions.VersionedTable`.

    Each check gets the staged table and says whether it holds.  Whatever happens, no staged
    table is left behind, and an existing one is only replaced by one that passed.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    if fs.exists(place) and not overwrite:
        raise CommitError(f"{path} exists")
    staged = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".staging_{uuid.uuid4().hex}")
    try:
        df.write.parquet(staged.toString())
        written = spark.read.parquet(staged.toString())
        failed = [name for name, holds in checks.items() if not holds(written)]
        if failed:
            raise CommitError("failed: " + ", ".join(failed))
        if fs.exists(place):
            if not overwrite:
                raise CommitError(f"{path} appeared meanwhile")
            old = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".old_{uuid.uuid4().hex}")
            fs.rename(place, old)
            if not fs.rename(staged, place):
                fs.rename(old, place)
                raise CommitError(f"{path} could not be replaced")
            fs.delete(old, True)
        elif not fs.rename(staged, place):
            raise CommitError(f"{path} could not be created")
    finally:
        if fs.exists(staged):
            fs.delete(staged, True)


def exact_rows(n: int) -> Callable[[DataFrame], bool]:
    return lambda df: df.count() == n


def frames_complete(keys: list[str], n: int) -> Callable[[DataFrame], bool]:
    return lambda df: df.select(*keys).distinct().count() == n
