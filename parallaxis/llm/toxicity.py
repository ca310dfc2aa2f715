"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

The kernel of two words counts the subsequences of ``ORDER`` letters they share, each
weighted by ``DECAY`` for every position that it spans: letters may be missing in between
or strewn in, at a price, so ``id.iot`` or ``idiiot`` stays near ``idiot``.  It is a word's
kernel with a landmark, as a part of the landmark's kernel with itself (1 where the word
holds the whole landmark); that is a sum over the landmark's own subsequences only, so
what surrounds an insult in a word does not dilute it.

1. Landmarks are fragments (word beginnings and words) of labelled documents that set toxic
   ones apart, chosen by how often they occur in each class, without near copies.
2. A document is its words; letters spelled out one by one count as a word too.  For each
   landmark it has the largest kernel of a word, and the mean kernel over its words.  Only
   words that share at least all but one of a landmark's different letters, and a kernel of
   ``FLOOR``, count.
3. Nyström: both sets of values times the inverse root of the landmarks' own kernel matrix.
4. A linear support vector machine with squared hinge loss is fitted to them by Newton
   steps, and its margin turned into a probability by a logistic fit (on the same rows).

Labels are learned from a bounded sample (``sample`` rows, in the order of a hash of the
id), so what the driver holds is ``sample`` rows of a few dozen numbers; scoring is one
pass over all documents and whole texts, without a shuffle.

Null and empty texts are scored like texts without any landmark.  Labels that are null, or
of ids without a document, are not used; of repeated labels the larger counts.  If a class is
missing among the labels, every score is the share of toxic labels (0 if there are none).
Very long texts are read whole, and so are words of any length; an empty table has an empty
result; only ids, texts and labels are read, so no other column can clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.llm.cluster import batch_of, held, slices, texts_of

ORDER, DECAY, FLOOR = 3, 0.4, 0.5
#: Two letters that begin every word, so that subsequences tell its start from its inside.
START = "\x02\x03"
#: Powers (which are kernels again) for a text's largest value and for its mean.
SOFT, SHARP = 4, 12
#: A landmark's mean value over a text's words counts in full from one word in so many.
RATE = 60
#: Words whose values a Python worker keeps, and letters of a window: longer words are read in windows that overlap by half.
KEEP, LONGEST = 500_000, 40
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_][\W_]?\x20){2,}[^\W\d_](?!\S)")
SINGLE = re.compile(r"(?<!\S)\w\W? \w\W? \w(?!\w)")
LETTERS = re.compile(r"[\W\d_]+")


def kernels(words: list[str], landmarks: list[str], pairs: np.ndarray | None = None, inside: list[bool] | None = None) -> np.ndarray:
    """Raw subsequence kernels of ``words[i], landmarks[j]`` for the rows (i, j) of ``pairs`` (or all).

    ``inside`` marks strings that are not the start of their word.
    """
    if pairs is None:
        pairs = np.stack(np.meshgrid(np.arange(len(words)), np.arange(len(landmarks)), indexing="ij"), -1).reshape(-1, 2)
    if not len(pairs):
        return np.zeros(0)
    w, m = codes([x if within else START + x for x, within in zip(words, inside or [False] * len(words), strict=True)]), codes([START + x for x in landmarks])
    a, b = w[pairs[:, 0]], m[pairs[:, 1]]
    n, la, lb = len(pairs), a.shape[1], b.shape[1]
    b = np.where(b == 0, -1, b)  # padding equals nothing
    inner = np.ones((la + 1, n, lb + 1))  # of order 0, for prefixes of both strings
    for order in range(1, ORDER + 1):
        outer = np.zeros((la + 1, n, lb + 1))
        total = np.zeros(n)
        row = np.zeros((n, lb + 1))
        for i in range(1, la + 1):
            same = a[:, i - 1, None] == b
            if order == ORDER:
                total += (same * inner[i - 1][:, :-1]).sum(axis=1) * DECAY**2
                continue
            gain = np.zeros((n, lb + 1))
            gain[:, 1:] = same * inner[i - 1][:, :-1] * DECAY**2
            for j in range(1, lb + 1):  # gaps in the landmark
                gain[:, j] += DECAY * gain[:, j - 1]
            row = DECAY * row + gain  # gaps in the word
            outer[i] = row
        inner = outer
    return total


def codes(words: list[str]) -> np.ndarray:
    """Code points of each word, padded with zeros."""
    longest = max(1, max(map(len, words), default=1))
    out = np.zeros((len(words), longest), np.int32)
    for k, word in enumerate(words):
        out[k, : len(word)] = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<i4")
    return out


def letter_bits(words: list[str]) -> np.ndarray:
    """Which letters a word has, one bit for each (by code point modulo 64)."""
    return np.bitwise_or.reduce(np.where((c := codes(words)) > 0, np.uint64(1) << (c % 64).astype(np.uint64), np.uint64(0)), axis=1)


def windows(word: str) -> list[str]:
    """The letters of a word, all of them: its first ``LONGEST``, and windows over those that follow."""
    letters, step = LETTERS.sub("", word), LONGEST // 2
    return [letters[:LONGEST], *(letters[at : at + LONGEST] for at in range(step, len(letters) - step, step))]


def words_of(text: str) -> list[str]:
    """The words of a text, lower-cased; letters spelled out one by one count as a word too."""
    text = text.lower()
    words = WORD.findall(text)
    if SINGLE.search(text):
        words += [re.sub(r"[\W_]", "", m[0]) for m in SPELLED.finditer(text)]
    return words


@dataclass
class Landmarks:
    """Landmark strings and the values of words against them."""

    strings: list[str]
    kept: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        k = len(self.strings)
        self.own = kernels(self.strings, self.strings, np.repeat(np.arange(k), 2).reshape(-1, 2)) if k else np.zeros(0)
        self.bits = letter_bits(self.strings) if k else np.zeros(0, np.uint64)
        self.n_bits = np.bitwise_count(self.bits).astype(int)
        both = kernels(self.strings, self.strings).reshape(k, k) if k else np.zeros((0, 0))
        gram = both / np.sqrt(np.outer(self.own, self.own)) if k else both
        values, vectors = np.linalg.eigh(gram) if k else (np.zeros(0), both)
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T if k else both
        self.root = np.kron(np.eye(2), root)

    def learn(self, words: list[str]) -> None:
        """Keep each word's row of values: 0 for words that are near no landmark."""
        if not words or not self.strings:
            return
        if not self.rows:
            self.rows.append(np.zeros(len(self.strings)))
        for start in range(0, len(words), 4096):
            some = words[start : start + 4096]
            cut = list(map(windows, some))
            owner = np.repeat(np.arange(len(some)), list(map(len, cut)))
            plain = [x for parts in cut for x in parts]
            inside = np.concatenate([[False], owner[1:] == owner[:-1]])
            lengths = np.array(list(map(len, plain)))
            shared = np.bitwise_count(letter_bits(plain)[:, None] & self.bits[None, :]).astype(int)
            near = np.argwhere((shared >= np.maximum(self.n_bits - 1, 2)[None, :]) & (lengths[:, None] >= ORDER))
            value = np.zeros(len(near))
            # pairs of like lengths together, so that padding stays small
            order = np.argsort(lengths[near[:, 0]], kind="stable")
            for at in range(0, len(order), 8192):
                pick = order[at : at + 8192]
                used, index = np.unique(near[pick, 0], return_inverse=True)
                value[pick] = kernels([plain[k] for k in used], self.strings, np.stack([index, near[pick, 1]], 1), inside[used].tolist()) / self.own[near[pick, 1]]
            value = np.minimum(value, 1.0)
            self.kept.update(dict.fromkeys(some, 0))
            strong = np.flatnonzero(value >= FLOOR)
            word = owner[near[strong, 0]]
            for k in np.unique(word).tolist():
                row = np.zeros(len(self.strings))
                mine = strong[word == k]
                np.maximum.at(row, near[mine, 1], value[mine])
                self.kept[some[k]] = len(self.rows)
                self.rows.append(row)

    def values(self, texts: list[str]) -> np.ndarray:
        """For each text: each landmark's largest value, and its mean over all words times ``RATE`` (1 at most)."""
        k = len(self.strings)
        out = np.zeros((len(texts), 2 * k))
        if not k:
            return out
        if len(self.kept) > KEEP:
            self.kept.clear()
            self.rows.clear()
        cut = list(map(words_of, texts))
        missing = set()
        for words in cut:
            missing.update(words)
        missing = missing.difference(self.kept)
        self.learn(list(missing))
        get = self.kept.__getitem__
        for n, words in enumerate(cut):
            hits = [self.rows[h] for h in map(get, words) if h]
            if hits:
                out[n, :k] = np.max(hits, axis=0) ** SOFT
                out[n, k:] = np.minimum(1.0, np.sum(np.power(hits, SHARP), axis=0) * (RATE / len(words)))
        return out


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray
    slope: float
    shift: float
    prior: float | None = None  # the score of everything, if a class is missing

    def score(self, values: np.ndarray, root: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(values), self.prior)
        margin = values @ root @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Weights (the last for a constant 1) of a squared-hinge machine, by Newton steps on the active rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        active = y * (x @ w) < 1
        new = np.linalg.solve(ridge + 2 * cost * x[active].T @ x[active], 2 * cost * x[active].T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def fit_logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities of +1, with smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.stack([margin, np.ones(len(margin))], 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), z.T @ (target - p))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fragments(texts: DataFrame, shortest: int = 4, longest: int = 10) -> DataFrame:
    """``doc_id, fragment``: the different beginnings of words, and whole words, of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("fragment", pa.string())])

    def run(batches):
        for b in slices(batches):
            ids, out = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = set()
                for word in {LETTERS.sub("", w) for w in words_of(text or "")}:
                    found.update(word[:n] for n in range(shortest, min(len(word), longest) + 1))
                ids += [doc_id] * len(found)
                out += found
            yield batch_of(schema, ids, out)

    return texts.mapInArrow(run, "doc_id long, fragment string")


def choose_landmarks(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int, most: int) -> list[str]:
    """From (fragment, toxic documents, clean documents): the most telling, without near copies."""
    scored = []
    for fragment, toxic, clean in rows:
        rate, other = toxic / n_toxic, (clean + 0.5) / (n_clean + 1)
        if rate > 4 * other:
            scored.append((-rate * min(np.log(rate / other), 2.0), -len(fragment), fragment))
    chosen: list[str] = []
    for _, _, fragment in sorted(scored):
        if len(chosen) == most:
            break
        # its beginnings and continuations say the same about the same words
        if not any(fragment.startswith(c) or c.startswith(fragment) for c in chosen):
            chosen.append(fragment)
    return chosen


def learn_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 8000, most_landmarks: int = 40, held_out=None) -> Model:
    """Fit on at most ``sample`` labelled rows; ``held_out`` is a condition on ``doc_id`` never learned from."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    if held_out is not None:
        labels = labels.where(~held_out)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = [(r["doc_id"], r["toxic"]) for r in labels.collect()]  # at most `sample` small rows
    known = dict(picked)
    if not known:
        return Model([], np.zeros(1), 1.0, 0.0, prior=0.0)
    spark = docs.sparkSession
    ids = spark.createDataFrame(picked, "doc_id long, toxic int")
    texts = texts_of(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id")  # `sample` rows at most
    n_toxic = sum(known.values())
    if not 0 < n_toxic < len(known):
        return Model([], np.zeros(1), 1.0, 0.0, prior=n_toxic / len(known))
    counts = fragments(texts.select("doc_id", "text")).join(F.broadcast(ids), "doc_id").groupBy("fragment").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    least = max(4, round(0.03 * n_toxic))
    telling = counts.where((F.col("toxic") >= least) & (F.col("toxic") * (len(known) - n_toxic) > 4 * F.col("clean") * n_toxic))
    # fragments of the bounded sample in at least 3 % of its toxic rows: about 33 times those of one text at most
    rows = [(r["fragment"], r["toxic"], r["clean"]) for r in telling.collect()]
    strings = choose_landmarks(rows, n_toxic, len(known) - n_toxic, most_landmarks)
    if not strings:
        return Model([], np.zeros(1), 1.0, 0.0, prior=n_toxic / len(known))
    schema = pa.schema([("toxic", pa.int32()), ("values", pa.list_(pa.float64()))])

    def run(batches):
        marks = Landmarks(strings)
        for b in slices(batches):
            yield batch_of(schema, b.column(1), list(marks.values([t or "" for t in b.column(0).to_pylist()])))

    got = texts.select("text", "toxic").mapInArrow(run, "toxic int, values array<double>").collect()
    y = np.array([1.0 if r["toxic"] else -1.0 for r in got])
    if len(y) == 0 or abs(y.sum()) == len(y):
        return Model([], np.zeros(1), 1.0, 0.0, prior=float(len(y) and (y > 0).mean()))
    x = np.array([r["values"] for r in got]) @ Landmarks(strings).root
    weights = fit_svm(x, y)
    slope, shift = fit_logistic(np.hstack([x, np.ones((len(x), 1))]) @ weights, y)
    return Model(strings, weights, slope, shift)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: the probability of the label 1, from the text alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        marks = marks_of(model.landmarks)
        for b in slices(batches):
            yield batch_of(schema, b.column(0), model.score(marks.values([t or "" for t in b.column(1).to_pylist()]), marks.root))

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def scored_rows(docs: DataFrame, model: Model, score_col: str, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, and the score as ``score_col``."""

    @F.pandas_udf("double")
    def score(texts):
        marks = marks_of(model.landmarks)
        out = [model.score(marks.values([t or "" for t in texts.iloc[at : at + 512]]), marks.root) for at in range(0, len(texts), 512)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(score_col, score(docs[text_col]))


def marks_of(strings: list[str]) -> Landmarks:
    return held((Landmarks, tuple(strings)), lambda: Landmarks(strings))


#: The score from which a document counts as toxic.
TOXIC = 0.3


def held_out_fold():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=held_out_fold())
    return score_toxicity(docs, model).select("doc_id", held_out_fold().alias("held_out"), "score", F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"))
