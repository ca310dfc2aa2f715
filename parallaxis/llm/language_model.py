"""Language-model scores by deleted interpolation over all word pairs of the corpus.

The probability of a word w after another, u (or after the start of the text), mixes

    P(w | u) = a2 * c(u, w) / c(u) + a1 * c(w) / N + a0 / (V + 1)

with weights for the bucket of the context's frequency (its power of two).  Every word and
every pair of words that occurs in a training document is counted, however rare, so what is
gathered grows with the corpus.

Texts stand in *blocks* of a few MB, one row each, and a block is the unit of counting:

1. A block's different words and pairs, as 64-bit hashes with their counts in it, are cut by
   ranges of the hash into slots; one row holds a block's share of a slot.  So a word that is
   in every text has one entry for a block, not one for a text, and no key is ever hot.
2. A slot's rows are summed, and each block gets its entries' counts over the corpus back, in
   the order in which it sent them.
3. With these a block scores its own texts, without further joins.

There are as many slots as keep one within ``SLOT`` tokens, so memory does not follow the
corpus; with very many slots a row holds few entries, as in an ordinary grouping.

The weights come from expectation-maximisation: one fold of the training documents is deleted
from the counts and held out.  It has blocks of its own, so only these are read for it.  Its
tokens are summed by bucket and by the sizes of their estimates in quarters of a power of two
(a table bounded by its bins, whatever the corpus).  Afterwards the counts take the fold in,
and the weights stay.

Null and empty texts are a single end; a null id is never held out; each row is scored by
itself, so repeated rows and ids need nothing special.  A text longer than a block is a block.
Without training tokens, N is 0 and every score is that of unseen words.  An empty table has an
empty result.  Only the id and the text are read, so no other column can clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.llm.cluster import batch_of, materialize, shuffle_partitions, slices, texts_of
from parallaxis.llm.hashing import mix
from parallaxis.llm.shingles import word_hashes

FOLDS, HELD_OUT, DELETED = 7, 2, 5
#: Bytes and rows of a block; tokens of a slot; bytes of text that are hashed at once.
BLOCK, ROWS, SLOT, AT_ONCE = 4 << 20, 20_000, 1 << 20, 1 << 20
END, START = np.uint64(0x9D5C0FB1A3E7264B), np.uint64(0x51C1E3A7720D88F5)
_LEFT = np.uint64(0xD6E8FEB86659FD93)
STEPS, BINS = 60, 4
BUCKETS = 66

WORDS, PAIRS, TOTALS = 0, 1, 2
COUNTS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("slot", pa.int32()), ("main", pa.binary()), ("deleted", pa.binary()), ("types", pa.int64()), ("n_main", pa.int64()), ("n_deleted", pa.int64())])
COUNT_COLUMNS = "block long, kind int, slot int, main binary, deleted binary, types long, n_main long, n_deleted long"


def fold_of(doc_id: int | None) -> int:
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end behind each text, and the text each token is of."""
    words, of, at = [], [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < AT_ONCE):
            size += len(texts[end] or "")
            end += 1
        word, upto = word_hashes(texts[at:end])
        words.append(np.insert(word, upto, END))
        of.append(np.repeat(np.arange(at, end), np.diff(np.concatenate([[0], upto])) + 1))
        at = end
    return np.concatenate(words), np.concatenate(of)


def pair_hashes(word: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the hash of it and the one before, and the first token of each text."""
    first = np.concatenate([[True], of[1:] != of[:-1]])
    before = np.concatenate([[START], word[:-1]])
    before[first] = START
    return mix(mix(before * _LEFT + START) + word), first


def packed(counts: np.ndarray) -> bytes:
    """A byte for each count; those that need more follow in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.uint64).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.uint64, offset=n)
    return out


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences, byte place by byte place: the high ones are zeros, which Spark's compression removes."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


TEXTS = pa.schema([("id", pa.int64()), ("text", pa.string())])


def packed_texts(ids: list, texts: list[str]) -> bytes:
    """Rows as one compressed value, so that a block stays small wherever Spark holds it."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, TEXTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch_of(TEXTS, ids, texts))
    return out.getvalue().to_pybytes()


def unpacked_texts(raw: bytes) -> tuple[list, list[str]]:
    rows = pa.ipc.open_stream(raw).read_all()
    return rows["id"].to_pylist(), rows["text"].to_pylist()


def text_blocks(docs: DataFrame) -> DataFrame:
    """``block, deleted, size, texts``: a row for a few MB of texts; the deleted fold has blocks of its own."""
    schema = pa.schema([("block", pa.int64()), ("deleted", pa.bool_()), ("size", pa.int64()), ("texts", pa.binary())])

    def run(batches):
        block, open_blocks = TaskContext.get().partitionId() << 32, {False: ([], [], 0), True: ([], [], 0)}
        for b in slices(batches, 512, 1 << 20):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fold = fold_of(doc_id) == DELETED
                ids, texts, size = open_blocks[fold]
                ids.append(doc_id)
                texts.append(text or "")
                size += len(text or "") + 1
                open_blocks[fold] = ids, texts, size
                if size >= BLOCK or len(ids) >= ROWS:
                    yield batch_of(schema, [block], [fold], [size], [packed_texts(ids, texts)])
                    block += 1
                    open_blocks[fold] = [], [], 0
        for fold, (ids, texts, size) in open_blocks.items():
            if ids:
                yield batch_of(schema, [block], [fold], [size], [packed_texts(ids, texts)])
                block += 1

    return docs.mapInArrow(run, "block long, deleted boolean, size long, texts binary")


def slots_of(keys: np.ndarray, n_slots: int) -> np.ndarray:
    """Where each slot's keys begin among sorted ones, and an end."""
    slot = ((keys >> np.uint64(32)) * np.uint64(n_slots)) >> np.uint64(32)
    return np.searchsorted(slot, np.arange(n_slots + 1, dtype=np.uint64))


def share_out(blocks: DataFrame, n_slots: int) -> DataFrame:
    """``slot, kind, block, keys, main, deleted``: a block's different words and pairs, with their counts in its training documents."""
    schema = pa.schema([("slot", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("main", pa.binary()), ("deleted", pa.binary())])

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                block, fold, raw = (c[at].as_py() for c in b.columns)
                ids, texts = unpacked_texts(raw)
                word, of = tokens_of(texts)
                use = np.array([fold_of(i) != HELD_OUT for i in ids])[of]
                for kind, tokens in ((WORDS, word), (PAIRS, pair_hashes(word, of)[0])):
                    keys, index = np.unique(tokens, return_inverse=True)
                    del tokens
                    n, none = np.bincount(index[use], minlength=len(keys)), np.zeros(len(keys), np.uint8)
                    main, deleted = (none, n) if fold else (n, none)
                    start = slots_of(keys, n_slots)
                    some = np.flatnonzero(np.diff(start))
                    cut = [(int(start[s]), int(start[s + 1])) for s in some]
                    yield batch_of(schema, some.astype(np.int32), np.full(len(some), kind, np.int32), np.full(len(some), block), [packed_keys(keys[x:y]) for x, y in cut], [packed(main[x:y]) for x, y in cut], [packed(deleted[x:y]) for x, y in cut])

    return blocks.select("block", "deleted", "texts").mapInArrow(run, "slot int, kind int, block long, keys binary, main binary, deleted binary")


def summed(shares: DataFrame, parts: int) -> DataFrame:
    """Each share's counts over the whole corpus, in its own order, and totals of each slot's words (``TOTALS``)."""
    order = ["slot", "kind", "block"]

    def total(rows):
        slot, kind = rows[0][0], rows[0][1]
        keys = [unpacked_keys(r[3]) for r in rows]
        size = [len(k) for k in keys]
        found, index = np.unique(np.concatenate(keys), return_inverse=True)
        both = []
        for column in (4, 5):
            n = np.concatenate([unpacked(r[column], k) for r, k in zip(rows, size, strict=True)])
            both.append(np.bincount(index, n, len(found)).astype(np.int64))
        cut = np.split(index, np.cumsum(size)[:-1])
        nothing = [0] * len(rows)
        yield batch_of(COUNTS, [r[2] for r in rows], [kind] * len(rows), [slot] * len(rows), [packed(both[0][i]) for i in cut], [packed(both[1][i]) for i in cut], nothing, nothing, nothing)
        if kind == WORDS:
            yield batch_of(COUNTS, [None], [TOTALS], [slot], [None], [None], [int((both[0] + both[1] > 0).sum())], [int(both[0].sum())], [int(both[1].sum())])

    def run(batches):
        held = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][:2] != row[:2]:
                    yield from total(held)
                    held = []
                held.append(row)
        if held:
            yield from total(held)

    dealt = shares.repartition(parts, "slot").sortWithinPartitions(*order)
    return dealt.select("slot", "kind", "block", "keys", "main", "deleted").mapInArrow(run, COUNT_COLUMNS)


class Counted:
    """A block's tokens with their counts over the corpus, outside (``main``) and inside the deleted fold."""

    def __init__(self, texts: list[str], shares: pa.Table, n_slots: int):
        """``shares``: the block's rows of :func:`summed`."""
        word, self.of = tokens_of(texts)
        pair, self.first = pair_hashes(word, self.of)
        self.main, self.deleted = {}, {}
        kinds, slots = shares["kind"].to_numpy(), shares["slot"].to_numpy()
        for kind, tokens in ((WORDS, word), (PAIRS, pair)):
            keys, index = np.unique(tokens, return_inverse=True)
            at = np.flatnonzero(kinds == kind)
            rows = pa.array(at[np.argsort(slots[at])])
            sizes = np.diff(slots_of(keys, n_slots))
            sizes = sizes[sizes > 0].tolist()
            for name, into in (("main", self.main), ("deleted", self.deleted)):
                into[kind] = np.concatenate([unpacked(r, n) for r, n in zip(shares[name].take(rows).to_pylist(), sizes, strict=True)])[index]

    def contexts(self, words: np.ndarray) -> np.ndarray:
        """How often what stands before each token is a context: a word as often as it occurs, a start as often as a text ends."""
        before = np.concatenate([[0], words[:-1]])
        before[self.first] = words[-1]  # the last token of a block is an end
        return before


def estimates(pairs: np.ndarray, contexts: np.ndarray, words: np.ndarray, n: int):
    """Bucket of each token's context, and the two estimates that are not uniform."""
    bucket = np.where(contexts > 0, np.floor(np.log2(np.maximum(contexts, 1))).astype(np.int64) + 1, 0)
    return bucket, pairs / np.maximum(1, contexts), words / max(1, n)


def cells(bucket: np.ndarray, two: np.ndarray, one: np.ndarray, types: int) -> pd.DataFrame:
    """Tokens summed by bucket and by the sizes of both estimates against the uniform one."""
    size = lambda f: np.where(f > 0, np.rint(BINS * np.log2(np.maximum(f * (types + 1), 1e-9))).astype(np.int64) + 200, -1)
    rows = pd.DataFrame({"bucket": bucket, "r2": size(two), "r1": size(one), "n": 1, "two": two, "one": one})
    return rows.groupby(["bucket", "r2", "r1"], as_index=False).sum()


def learn_weights(found: pd.DataFrame, types: int) -> np.ndarray:
    """Weights (a2, a1, a0) for each bucket of context frequency, by expectation-maximisation over :func:`cells`."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = 0, 0.9, 0.1  # contexts never seen outside the deleted fold
    if not len(found):
        return weights
    n, bucket = found["n"].to_numpy(float), found["bucket"].to_numpy()
    part = np.stack([found["two"] / n, found["one"] / n, np.full(len(n), 1 / (types + 1))], 1)
    for _ in range(STEPS):
        share = part * weights[bucket]
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        gained = np.stack([np.bincount(bucket, n * share[:, k], BUCKETS) for k in range(3)], 1)
        total = gained.sum(axis=1, keepdims=True)
        weights = np.where(total > 0, (gained + [0, 0, 1e-3]) / (total + 1e-3), weights)
    weights[0] = 0, weights[0, 1] / weights[0, 1:].sum(), weights[0, 2] / weights[0, 1:].sum()
    return weights


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    docs = texts_of(docs, id_col, text_col)
    blocks = materialize(text_blocks(docs), "blocks")
    size = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()["size"]
    parts = shuffle_partitions(docs.sparkSession)
    n_slots = max(4 * parts, size // (6 * SLOT) + 1)  # about six bytes a token
    counts = materialize(summed(share_out(blocks, n_slots), parts), "counts")
    r = counts.where(F.col("kind") == TOTALS).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "n_main", "n_deleted")]).first()
    types, n_main, n = r["types"], r["n_main"], r["n_main"] + r["n_deleted"]
    shares = counts.where(F.col("kind") != TOTALS).select("block", "kind", "slot", "main", "deleted")
    cell = pa.schema([("bucket", pa.int64()), ("r2", pa.int64()), ("r1", pa.int64()), ("n", pa.int64()), ("two", pa.float64()), ("one", pa.float64())])

    def observe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return cell.empty_table()
        c = Counted(unpacked_texts(left["texts"][0].as_py())[1], right, n_slots)
        found = cells(*estimates(c.main[PAIRS], c.contexts(c.main[WORDS]), c.main[WORDS], n_main), types)
        return pa.Table.from_pandas(found, schema=cell, preserve_index=False)

    some = blocks.where("deleted").select("block", "texts")
    apart = shares.join(some.select("block"), "block", "left_semi")
    seen = some.groupBy("block").cogroup(apart.groupBy("block")).applyInArrow(observe, "bucket long, r2 long, r1 long, n long, two double, one double")
    # a row for each bucket and bins: bounded whatever the corpus
    weights = learn_weights(seen.groupBy("bucket", "r2", "r1").agg(F.sum("n").alias("n"), F.sum("two").alias("two"), F.sum("one").alias("one")).toPandas(), types)

    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out.empty_table()
        ids, texts = unpacked_texts(left["texts"][0].as_py())
        c = Counted(texts, right, n_slots)
        words, pairs = c.main[WORDS] + c.deleted[WORDS], c.main[PAIRS] + c.deleted[PAIRS]
        bucket, two, one = estimates(pairs, c.contexts(words), words, n)
        a = weights[bucket]
        p = np.log10(a[:, 0] * two + a[:, 1] * one + a[:, 2] / (types + 1))
        base = np.log10((words + 1) / (n + types + 1))
        total = lambda x: np.bincount(c.of, x, len(ids))
        columns = [ids, [fold_of(i) == HELD_OUT for i in ids], total(None), total(words > 0).astype(np.int64), [n] * len(ids), total(base), total(p)]
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, out, strict=True)], schema=out)

    return blocks.select("block", "texts").groupBy("block").cogroup(shares.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
