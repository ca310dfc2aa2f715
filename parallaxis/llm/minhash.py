"""MinHash near-duplicates by a forest of sorted signature orders.

1. Each text's set of word shingles is hashed to a signature of ``TREES`` labels, each of
   ``DEPTH`` minima under independent hash functions.  Documents with the same set are one
   class from here on, represented by their smallest id.
2. Every tree is an order: classes sorted by label.  It is dealt out by ranges of the label
   and then of the id, so a crowded region is split like any other.  In an order, classes
   that agree on their first minima stand together; a class's candidates are the next few
   with a common prefix of ``SHALLOW`` minima or more.  The depth adapts to the region: the
   more classes share the shallow prefix, the longer a prefix is asked of neighbours
   further off, so that dense regions link along their longest common prefixes.
3. Candidates whose sizes or one-bit sketches rule out the similarity are left out.
4. Links are confirmed on full sets, taken from the texts again, in two rounds: first the
   best few candidates of each class, then all candidates whose ends are still in different
   components.  So a group of thousands costs a few comparisons for each member.
5. The neighbours are few, so in a crowded region they may miss partners.  Whatever run of
   equal ``SHALLOW`` minima still holds classes of different components is compared whole,
   every class with every one of another component, in tiles of bounded size, by sketch and
   whole signature.  (Of documents that share half of their shingles, as those with a passage
   in common do, one pair in 400 passes.)  Pairs are never rows: a class that takes part in any
   goes to the cells it needs, and each cell compares full sets and returns its links.
6. Components follow from the confirmed links (:mod:`components`).

Null, empty and blank texts have no shingles and link with nothing.  Rows that repeat an id
get a row each; rows of the same id belong together only through their sets.  Null ids keep
their rows, belong to their set's class, and are never kept.  Very long texts are read whole; an
empty table has an empty result; only the id and the text are read, so no other column can clash.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallaxis.llm.cluster import batch_of, materialize, release, shuffle_partitions, slices, texts_of
from parallaxis.llm.components import components, merged_components
from parallaxis.llm.shingles import shingle_hashes, shingle_sets

TREES, DEPTH, SHALLOW = 16, 8, 3
#: Neighbours behind a class that are looked at, and the run of a shallow prefix up to which all of them count.
NEAR = 8
#: Bits of two sketches that agree, of 128, for a candidate.  At a similarity s the mean is 64 (1 + s).
AGREE = 98
#: Minima of two signatures that agree, of all ``TREES * DEPTH``, for a pair of a run: 5 deviations below the mean at 0.8.
EQUAL = 79
#: Candidates of a class that the first round confirms.
BEST = 3
#: Rows of a tile of a run, and ids in a cell whose texts are confirmed together.
TILE, CELL = 1024, 256
#: Ids that may be broadcast (8 bytes each); beyond that, texts are found by a shuffled join.
BROADCAST_IDS = 2_000_000

_random = random.Random(20260703)
_XOR = np.array([_random.getrandbits(64) for _ in range(TREES * DEPTH)], np.uint64)
_TIMES = np.array([_random.getrandbits(64) | 1 for _ in range(TREES * DEPTH)], np.uint64)


def signatures(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The low 16 bits of each minimum: a row for each text (texts without shingles: zeros)."""
    out = np.zeros((len(starts) - 1, TREES * DEPTH), np.uint16)
    some = np.flatnonzero(np.diff(starts) > 0)
    if len(some):
        for j in range(TREES * DEPTH):
            out[some, j] = np.minimum.reduceat((h ^ _XOR[j]) * _TIMES[j], starts[some]).astype(np.uint16)
    return out


def signature_rows(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, set1, set2, signature``: the set's size, 128 bits of it, and its signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()), ("signature", pa.binary())])

    def run(batches):
        release()
        for b in slices(batches, 1024, 2 << 20):
            h, starts = shingle_hashes(b.column(1).to_pylist(), words)
            sig = signatures(h, starts)
            n, s1, s2 = [], [], []
            for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own = np.unique(h[x:y])
                n.append(len(own))
                s1.append(int(own.sum(dtype=np.uint64).view(np.int64)))
                s2.append(int(((own ^ _XOR[0]) * _TIMES[0] >> np.uint64(7)).sum(dtype=np.uint64).view(np.int64)))
            yield batch_of(schema, b.column(0), n, s1, s2, [r.tobytes() for r in sig])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set1 long, set2 long, signature binary")


def forest_rows(classes: DataFrame) -> DataFrame:
    """A row for each class and tree: ``tree, label, id, n, sketch``; labels sort as their minima do."""
    schema = pa.schema([("tree", pa.int32()), ("label", pa.binary()), ("id", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(len(ids), TREES, DEPTH)
            sketch = np.packbits((sig.reshape(len(ids), -1) >> 3 & 1).astype(bool), axis=1)
            for tree in range(TREES):
                labels = sig[:, tree].astype(">u2")
                yield batch_of(schema, np.full(len(ids), tree, np.int32), [x.tobytes() for x in labels], ids, n, [x.tobytes() for x in sketch])

    return classes.select("id", "n", "signature").mapInArrow(run, "tree int, label binary, id long, n long, sketch binary")


def neighbours(tree, label, ids, n, sketch, percent: int, done: int):
    """Candidate pairs (i, j) and their agreement, of sorted rows, for rows from ``done`` on as the later one."""
    rows = len(ids)
    common = np.zeros((NEAR + 1, rows), np.int64)  # shared minima of a row and the one so many before it
    found = []
    for off in range(1, min(NEAR, rows - 1) + 1):
        same = (tree[off:] == tree[:-off])[:, None] & (label[off:] == label[:-off])
        common[off, off:] = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    close = common[1] >= SHALLOW
    group = np.cumsum(~close)
    crowd = np.bincount(group)[group]
    extra = np.ceil(np.log2(np.maximum(crowd, NEAR) / NEAR)).astype(np.int64)
    for off in range(1, min(NEAR, rows - 1) + 1):
        deep = SHALLOW if off <= 2 else np.minimum(SHALLOW + extra, DEPTH)
        j = np.flatnonzero(common[off] >= deep)
        j = j[j >= max(off, done)]
        i = j - off
        agree = 128 - np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1).astype(int)
        fits = (agree >= AGREE) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (ids[i] != ids[j])
        found.append((i[fits], j[fits], agree[fits]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """``a, b, agree`` with a < b: neighbours in any of the orders."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("agree", pa.int32())])
    parts = shuffle_partitions(classes.sparkSession)
    order = ["tree", "label", "id"]
    dealt = forest_rows(classes).repartitionByRange(2 * parts, *order).sortWithinPartitions(*order)

    def walk(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            tree, ids, n = (b.column(k).to_numpy() for k in (0, 2, 3))
            label = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u2").reshape(-1, DEPTH)
            sketch = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint64).reshape(-1, 2)
            done = 0
            if held is not None:  # the rows before stay for as long as they can have neighbours
                done = len(held[0])
                tree, label, ids, n, sketch = (np.concatenate(x) for x in zip(held, (tree, label, ids, n, sketch), strict=True))
            i, j, agree = neighbours(tree, label, ids, n, sketch, percent, done)
            held = [x[-NEAR:] for x in (tree, label, ids, n, sketch)]
            if len(i):
                yield batch_of(schema, np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), agree.astype(np.int32))

    return dealt.mapInArrow(walk, "a long, b long, agree int").groupBy("a", "b").agg(F.max("agree").alias("agree"))


def run_rows(classes: DataFrame) -> DataFrame:
    """A row for each class and tree: ``key`` (tree and first minima), ``id, n, component``."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("component", pa.int64())])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint16).reshape(b.num_rows, TREES, DEPTH)
            for tree in range(TREES):
                key = np.full(b.num_rows, tree)
                for k in range(SHALLOW):
                    key = key << 16 | sig[:, tree, k]
                yield batch_of(schema, key, *b.columns[:3])

    return classes.select("id", "n", "component", "signature").mapInArrow(run, "key long, id long, n long, component long")


def agreeing(tree: int, sig: np.ndarray, n: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int):
    """Pairs of rows of different components whose sketches and then whole signatures agree enough.

    A pair that meets in the runs of several trees belongs to the first of these.
    """
    bits = np.packbits((sig >> 3 & 1).astype(bool), axis=1).view(np.uint64)
    differ = sum(np.bitwise_count(bits[left, None, k] ^ bits[right, k]).astype(int) for k in range(bits.shape[1]))
    i, j = np.nonzero((128 - differ >= AGREE) & (component[left, None] != component[right]))
    i, j = left[i], right[j]
    near = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    i, j = i[near], j[near]
    keep = [np.zeros(0, bool)]
    for at in range(0, len(i), 65536):
        same = sig[i[at : at + 65536]] == sig[j[at : at + 65536]]
        begin = same.reshape(-1, TREES, DEPTH)[:, :, :SHALLOW].all(axis=2)
        keep.append((same.sum(axis=1) >= EQUAL) & (begin.argmax(axis=1) == tree))
    keep = np.concatenate(keep)
    return i[keep], j[keep]


#: What a cell knows of a class.
CELLS = pa.schema([("key", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("cell", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("component", pa.int64()), ("signature", pa.binary())])
CELL_COLUMNS = "key long, c1 long, c2 long, cell long, id long, n long, component long, signature binary"


def cells_of_runs(classes: DataFrame, percent: int) -> DataFrame:
    """The classes of each run that have a partner of another component within the bounds, with the two cells in which both are.

    A run of more than ``TILE`` rows is cut into tiles, and every two of them meet apart;
    tiles of the run's largest component meet only those of the others.
    """
    rows = run_rows(classes)
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    rows = materialize(rows.join(materialize(mixed, "mixed"), "key").join(classes.select("id", "signature"), "id"), "runs")
    sizes = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("size"))
    sizes = sizes.withColumn("mains", F.when(F.col("size") > TILE, F.ceil(F.col("most") / TILE)).otherwise(0))
    sizes = sizes.withColumn("others", F.when(F.col("size") > TILE, F.ceil((F.col("size") - F.col("most")) / TILE)).otherwise(1))
    own = (F.col("component") == F.col("main")) & (F.col("mains") > 0)
    tiled = rows.join(materialize(sizes, "sizes"), "key").withColumn("tile", F.when(own, F.pmod(F.xxhash64("id"), "mains")).otherwise(F.col("mains") + F.pmod(F.xxhash64("id"), "others")))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.when(own, F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1)))
    order = ["key", "t1", "t2"]
    tiled = tiled.select("key", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "id", "n", "component", "size", "signature")
    dealt = tiled.repartition(2 * shuffle_partitions(classes.sparkSession), *order).sortWithinPartitions(*order)

    def compare(x, sig):
        key, t1, t2, tile, ids, n, component, size = x
        left, right = np.flatnonzero(tile == t1[0]), np.flatnonzero(tile == t2[0])
        i, j = agreeing(int(key[0] >> 48), sig, n, component, left, right, percent)
        many = -(-int(size[0]) // CELL)
        cell = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % many
        low, high = np.minimum(cell[i], cell[j]), np.maximum(cell[i], cell[j])
        rows = np.unique(np.stack([np.tile(low, 2), np.tile(high, 2), np.concatenate([i, j])]), axis=1)
        at = rows[2]
        return batch_of(CELLS, key[at], rows[0], rows[1], cell[at], ids[at], n[at], component[at], [x.tobytes() for x in sig[at]])

    def walk(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([c.to_numpy() for c in b.columns[:8]])
            sig = np.frombuffer(b"".join(b.column(8).to_pylist()), np.uint16).reshape(-1, TREES * DEPTH)
            if held is not None:
                x, sig = np.concatenate([held[0], x], axis=1), np.concatenate([held[1], sig])
            ends = np.flatnonzero((x[:3, 1:] != x[:3, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
                yield compare(x[:, start:end], sig[start:end])
            last = ends[-1] if len(ends) else 0
            held = x[:, last:], sig[last:]
        if held is not None:
            yield compare(*held)

    return dealt.mapInArrow(walk, CELL_COLUMNS)


def texts_of_ids(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, text``, one for each of the ids (``doc_id``, which may repeat)."""
    ids = materialize(ids.distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    return materialize(docs.join(F.broadcast(ids) if few else ids, "doc_id").dropDuplicates(["doc_id"]), "texts")


def confirm_cells(cells: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of what :func:`cells_of_runs` gives, enough of the links ``a, b`` to join what they join.

    The ids of a run fall into cells of about ``CELL``; the texts of two cells are read
    once for all of the pairs between them.
    """
    texts = texts_of_ids(cells.select(F.col("id").alias("doc_id")), docs)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(rows: pa.Table) -> pa.Table:
        ids, first = np.unique(rows["id"].to_numpy(), return_index=True)  # tiles may name an id more than once
        rows = rows.take(pa.array(first))
        n, component, cell = (rows[c].to_numpy() for c in ("n", "component", "cell"))
        sig = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint16).reshape(-1, TREES * DEPTH)
        c1, c2 = rows["c1"][0].as_py(), rows["c2"][0].as_py()
        i, j = agreeing(rows["key"][0].as_py() >> 48, sig, n, component, np.flatnonzero(cell == c1), np.flatnonzero(cell == c2), percent)
        if c1 == c2:
            i, j = i[i < j], j[i < j]
        sets, up = [], {}
        for b in slices(rows.select(["id", "text"]).to_batches(), 512, 4 << 20):
            sets += shingle_sets(b.column(1).to_pylist(), words)
        number = np.unique(np.concatenate(sets), return_inverse=True)[1]
        sets = np.split(number, np.cumsum([len(x) for x in sets])[:-1])
        has = np.zeros(len(number) + 1, np.int64)

        def root(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        partners, joined = {}, []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            partners.setdefault(x, []).append(y)
        for x, others in partners.items():
            others = [y for y in others if root(x) != root(y)]
            if not others:
                continue
            own, near = sets[x], [sets[y] for y in others]
            has[own] = 1
            upto = np.concatenate([[0], np.cumsum(has[np.concatenate(near)])])
            has[own] = 0
            shared = np.diff(upto[np.concatenate([[0], np.cumsum([len(z) for z in near])])])
            for y, z, k in zip(others, near, shared.tolist(), strict=True):
                if k > 0 and 100 * k >= percent * (len(own) + len(z) - k) and root(x) != root(y):
                    up[root(y)] = root(x)
                    joined.append((x, y))
        return pa.table([pa.array([int(ids[x]) for x, _ in joined], pa.int64()), pa.array([int(ids[y]) for _, y in joined], pa.int64())], schema=schema)

    return cells.join(texts.withColumnRenamed("doc_id", "id"), "id").groupBy("key", "c1", "c2").applyInArrow(check, "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough.  ``docs`` has one text for each id."""
    texts = texts_of_ids(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs)
    both = (
        pairs.select("a", "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b in slices(batches, 512, 4 << 20):
            ids_a, ids_b = b.column(0).to_pylist(), b.column(1).to_pylist()
            text = dict(zip(ids_a, b.column(2).to_pylist(), strict=True)) | dict(zip(ids_b, b.column(3).to_pylist(), strict=True))
            sets = dict(zip(text, shingle_sets(list(text.values()), words), strict=True))
            keep = []
            for x, y in zip(ids_a, ids_b, strict=True):
                p, q = sets[x], sets[y]
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(shared > 0 and 100 * shared >= percent * (len(p) + len(q) - shared))
            yield batch_of(schema, [x for x, k in zip(ids_a, keep, strict=True) if k], [y for y, k in zip(ids_b, keep, strict=True) if k])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def best_of_each(pairs: DataFrame) -> DataFrame:
    """Pairs that are among the best few of either end (an end has at most 2 * NEAR * TREES)."""
    ends = pairs.select("a", "b", "agree", F.explode(F.array("a", "b")).alias("end"))
    rank = F.row_number().over(W.partitionBy("end").orderBy(F.desc("agree"), "a", "b"))
    return ends.withColumn("rank", rank).where(F.col("rank") <= BEST).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row for each document; see the module."""
    docs = texts_of(docs, id_col, text_col)
    rows = materialize(signature_rows(docs, words), "signatures")
    key = ["set1", "set2", "n_shingles"]
    some = rows.where("n_shingles > 0")
    sets = materialize(some.groupBy(*key).agg(F.min("doc_id").alias("id")), "sets")
    # ids may repeat: then the class has its signature twice, and one of them is taken
    classes = sets.where("id is not null").join(some.withColumnRenamed("doc_id", "id"), [*key, "id"]).dropDuplicates(key).select("id", F.col("n_shingles").alias("n"), "signature")
    classes = materialize(classes, "classes")
    pairs = materialize(candidates(classes, percent), "candidates")
    named = docs.where("doc_id is not null")
    first = materialize(best_of_each(pairs), "best")
    links = materialize(confirm(first, named, words, percent), "confirmed")
    so_far = materialize(components(links), "components")
    of = lambda end: so_far.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
    rest = pairs.join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = materialize(rest.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"), "rest")
    if not rest.isEmpty():
        so_far = materialize(merged_components(so_far, materialize(confirm(rest, named, words, percent), "confirmed")), "components")
    parts = classes.join(so_far, "id", "left").withColumn("component", F.coalesce("component", "id"))
    far = materialize(cells_of_runs(parts, percent), "far")
    if not far.isEmpty():
        more = materialize(confirm_cells(far, named, words, percent), "confirmed")
        if not more.isEmpty():
            so_far = merged_components(so_far, more)
    classed = sets.join(so_far, "id", "left").select(*key, F.coalesce("component", "id").alias("component_id"))
    out = rows.drop("signature").join(classed, key, "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
