"""The corpus pipeline: toxicity, near-duplicates, secrets, packing, one table after another.

Each stage reads the table its predecessor wrote.  The first three return the columns of
documents: toxic documents go, one document of each near-duplicate group stays, and secrets
are replaced in the text (no document goes for them).  The last returns the packed pieces.

A document is toxic if the text scores 0.3 or more under a model fitted to the labels of
the folder (see :mod:`parallaxis.llm.toxicity`).  Rows are told apart by themselves, not by
their ids: of rows that repeat, or whose texts are near-duplicates, one stays, that of the
smallest id (a null id only if there is no other), and a row of another text stays even if its
id repeats.  Rows whose texts are null or have no words stay in every stage.  An empty table
stays empty.  Extra columns are carried along under their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.llm.cluster import materialize
from parallaxis.llm.minhash import near_duplicates
from parallaxis.llm.packing import pack
from parallaxis.llm.secrets import redact_secrets
from parallaxis.llm.toxicity import TOXIC, learn_toxicity, scored_rows


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit."""
    model = learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "score")
    return scored_rows(docs, model, score).where(F.col(score) < TOXIC).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: shingles of five words, similarity 0.8."""
    row = unused(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")  # written: numbers stay
    groups = near_duplicates(numbered, words=5, percent=80, id_col=row).where("n_shingles > 0").select(F.col("doc_id").alias("r"), F.col("component_id").alias("c"))
    groups = materialize(groups.join(numbered.select(F.col(row).alias("r"), F.col("doc_id").alias("id")), "r"), "groups")
    first = groups.groupBy("c").agg(F.min(F.struct(F.col("id").isNull(), "id", "r")).alias("first")).select(F.col("first.r").alias("r"))
    gone = groups.join(first, "r", "left_anti").select(F.col("r").alias("gone"))
    gone = materialize(gone, "gone")
    return numbered.join(gone, numbered[row] == gone["gone"], "left_anti").select(*[numbered[c] for c in docs.columns])


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without secrets in their texts, and ``n_chars`` of the new texts."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    import public_tokenizers as tokenizers

    return pack(docs, tokenizers.path("word_bpe_49k.json"), 4096, 1)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("secret scans", redact),
    ("best-fit packing", pack_documents),
]

#: A string kernel, random hash functions and a tokenizer are not SQL: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
