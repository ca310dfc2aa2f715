"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (lines).  Each paragraph is hashed to a wide
vector, and a document's fingerprint is the sum of its paragraphs' vectors, lane by lane,
modulo a power of two.  So the order of paragraphs does not matter, a paragraph is inserted
by adding its vector and deleted by subtracting it, and fingerprints of parts add up.

The vector has two sections:

* ``STRONG`` lanes of 64 bits, the output of an extendable-output hash of the paragraph.
  Different multisets agree on all of them only by a collision: equality is decided here.
* ``LIKE`` lanes of 32 bits: each word of the paragraph, whole, with the one behind it, hashes
  to one lane and a sign; so does every window of ``WINDOW`` bytes of a word of more than
  ``LONG`` bytes, as text without blanks is.  Sums of these are a linear sketch of the multiset
  of word pairs, so the cosine of two sections estimates how much is shared.

Null texts count as empty; very long texts are read whole; an empty table has an empty result.
Only the id and the text are read, so no other column can clash.  Rows with a null id have no successor: their edited text is cut
but gets nothing in its place, and the likeness to a next document is null.  Of rows with
the same id, those with smaller texts come first.
"""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.llm.cluster import batch_of, shuffle_partitions, slices, texts_of
from parallaxis.llm.hashing import hashed_words, mix

STRONG, LIKE = 8, 256
#: Bytes of a word from which it has windows too, and bytes of a window.
LONG, WINDOW = 24, 8

_random = random.Random(20260701)
_LETTERS = np.array([_random.getrandbits(64) for _ in range(256)], np.uint64)
_STEPS = np.array([_random.getrandbits(64) | 1 for _ in range(WINDOW)], np.uint64)
_NEXT = np.uint64(_random.getrandbits(64) | 1)


class Fingerprint:
    """A sum of paragraph vectors."""

    __slots__ = ("like", "strong")

    def __init__(self, strong=None, like=None):
        self.strong = np.zeros(STRONG, np.uint64) if strong is None else strong
        self.like = np.zeros(LIKE, np.uint32) if like is None else like

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        raw = text.encode()
        lines = raw.split(b"\n")
        digests = b"".join([hashlib.shake_128(line).digest(8 * STRONG) for line in lines])
        strong = np.frombuffer(digests, "<u8").reshape(-1, STRONG).sum(axis=0, dtype=np.uint64)
        flat = np.frombuffer(raw + b"\n", np.uint8)
        inside = flat > 32
        first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        if not len(first):
            return cls(strong)
        after = np.flatnonzero(~inside & np.concatenate([[False], inside[:-1]]))
        word = hashed_words(flat, first, after)
        # the word behind, if it is in the same line
        line = np.searchsorted(np.flatnonzero(flat == 10), first)
        behind = np.where(np.concatenate([line[1:] == line[:-1], [False]]), np.roll(word, -1), np.uint64(0))
        h = [mix(word + behind * _NEXT)]
        long = np.flatnonzero(after - first > LONG)
        if len(long):
            n = after[long] - first[long] - WINDOW + 1
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[long], n)
            h.append(mix(sum(_LETTERS[flat[at + k]] * _STEPS[k] for k in range(WINDOW))))
        h = np.concatenate(h)
        lane, up = (h & np.uint64(LIKE - 1)).astype(np.int64), (h >> np.uint64(63)).astype(bool)
        like = np.bincount(lane[up], minlength=LIKE) - np.bincount(lane[~up], minlength=LIKE)
        return cls(strong, like.astype(np.uint32))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.strong + other.strong, self.like + other.like)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.strong - other.strong, self.like - other.like)

    def __eq__(self, other) -> bool:
        return bool((self.strong == other.strong).all() and (self.like == other.like).all())

    __hash__ = None

    def __str__(self) -> str:
        return base64.b64encode(self.strong.astype("<u8").tobytes() + self.like.astype("<u4").tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        return cls(np.frombuffer(raw[: 8 * STRONG], "<u8"), np.frombuffer(raw[8 * STRONG :], "<u4"))

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints; else the cosine of the sketches, from 0 to 1."""
        if self == other:
            return 1.0
        a, b = self.like.view(np.int32).astype(float), other.like.view(np.int32).astype(float)
        norm = float(np.sqrt((a @ a) * (b @ b)))
        return 0.0 if norm == 0 else min(1.0, max(0.0, float(a @ b) / norm))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint``: one pass, no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for b in slices(batches):
            yield batch_of(schema, b.column(0), [str(Fingerprint.of(t or "")) for t in b.column(1).to_pylist()])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def with_heads(docs: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """``doc_id, text`` by runs of ascending ids, and how many: ``run``, and ``head`` for the row that follows a run.

    The runs' first ids are about quantiles, which are ids of the table; the row that begins a
    run goes, as a copy, to the end of the run before it too, and the first of all to the
    end of the last.  So every row meets its successor in its own run, with one shuffle.
    """
    known = docs.where(F.col("doc_id").isNotNull())
    found = known.agg(F.percentile_approx("doc_id", F.lit([k / parts for k in range(1, parts)] or [0.5]), 50 * parts).alias("q"), F.min("doc_id").alias("lo")).first()
    if found["lo"] is None:
        return known.select("doc_id", "text", F.lit(0).alias("run"), F.lit(False).alias("head")), 1
    bounds = np.array(sorted({found["lo"], *(found["q"] or [])}), np.int64)

    @F.pandas_udf("run int, begins boolean")
    def place(ids):
        run = np.searchsorted(bounds, ids.to_numpy(), side="right") - 1
        return pd.DataFrame({"run": run, "begins": bounds[run] == ids.to_numpy()})

    # of rows that share a run's first id, the first by text is its head
    rows = known.withColumn("place", place("doc_id")).select("doc_id", "text", "place.run", "place.begins")
    first = rows.where("begins").groupBy("doc_id", "run").agg(F.min("text").alias("text"))
    before = F.when(F.col("run") == 0, len(bounds) - 1).otherwise(F.col("run") - 1)
    heads = first.select("doc_id", "text", before.alias("run"), F.lit(True).alias("head"))
    return rows.select("doc_id", "text", "run", F.lit(False).alias("head")).unionByName(heads), len(bounds)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited text, and the likeness to both neighbours.

    The edited text: the last half of the code points (rounded down) replaced by the first
    as many of the document with the next id.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    docs = texts_of(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))

    def row(doc_id, text, own, after, next_own):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        other = Fingerprint.of(edited)
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), str(own), str(other), own.likeness(other), None if next_own is None else own.likeness(next_own)

    def walk(batches):
        held = None  # the row before: its id, text, fingerprint and run
        for b in slices(batches):
            out = []
            for doc_id, text, run, head in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = Fingerprint.of(text)
                if held is not None and held[3] == run:
                    out.append(row(*held[:3], text, own))
                held = None if head else (doc_id, text, own, run)
            if out:
                yield batch_of(schema, *(list(c) for c in zip(*out, strict=True)))

    def alone(batches):
        for b in slices(batches):
            out = [row(None, t, Fingerprint.of(t), "", None) for t in b.column(1).to_pylist()]
            yield batch_of(schema, *(list(c) for c in zip(*out, strict=True)))

    rows, n_runs = with_heads(docs, 2 * shuffle_partitions(docs.sparkSession))
    runs = rows.repartitionById(n_runs, F.col("run")).sortWithinPartitions("run", "head", "doc_id", "text")
    result = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return runs.select("doc_id", "text", "run", "head").mapInArrow(walk, result).unionByName(docs.where(F.col("doc_id").isNull()).mapInArrow(alone, result))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
