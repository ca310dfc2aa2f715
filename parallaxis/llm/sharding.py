"""Proportional stratified interleaving: shards of equal row counts with the corpus's mixture.

Each source's rows stand in a seeded shuffle's order; a row's fractional rank is its place
there, plus the source's own offset below 1, divided by the source's size, so all sources run
from 0 to 1 together, and small ones do not meet in the middle.  Sorted by fractional rank, any run of consecutive rows holds every source in proportion, and the
order is cut into runs whose lengths differ by one at most (the law ``rows``).

DataFrame functions only.  The text is read once, for its size and checksum; what is
shuffled is a few numbers for a row.  Ranks come from bucket counts (:mod:`ranks`), so no
source, however large, meets in one task.

A null text has no bytes (and checksum 0); a null source counts as the empty one.  Rows
alike in everything (repeated rows) are interchangeable, and each gets its own slot.  Null
ids are rows like others, and very long texts are read only for their size and checksum.  An
empty table has no rows in any shard.  Columns other than the three named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.llm.cluster import materialize
from parallaxis.llm.ranks import bucket_count, seeded_key, with_ranks

LAW = "rows"


def interleave_shards(docs: DataFrame, n_shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, text_crc32, law, shard, slot, grown_shard``; see the module."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = materialize(rows.withColumn("_key", seeded_key(seed, "source", "doc_id", "text_crc32")), "shard-rows")
    n = rows.count()
    ties = ["doc_id", "text_crc32", "size"]
    own = with_ranks(rows, ["source"], "_key", ties, bucket_count(n), "_rank", "_of")
    own = own.select("doc_id", "source", "size", "text_crc32", "_key", ((F.col("_rank") + seeded_key(seed, "source")) / F.col("_of")).alias("_fraction"))
    own = materialize(own.withColumn("_all", F.lit(0)), "shard-fractions")
    order = with_ranks(own, ["_all"], "_fraction", ["_key", "source", *ties], bucket_count(n), "_place", "_n")
    shard = F.expr(f"int((_place * {n_shards}) div _n)")
    start = F.expr(f"(_shard * _n + {n_shards - 1}) div {n_shards}")
    return order.withColumn("_shard", shard).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_place") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
