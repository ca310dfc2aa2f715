"""Embedding near-duplicates by NN-descent.

1. Vectors that are equal in all components and label are one class, represented by the
   smallest id; vectors that are null, zero or not finite link with nothing.
2. First lists come from a few random orders: the signs of random projections put near
   vectors side by side, and each run of such an order is compared within itself.  Orders are
   dealt out by ranges of label, signs and id, so no label or crowd of copies meets in one
   task, and runs overlap by half.  Every link met in a run is kept, as a star around the
   smallest id it leads to, before lists are cut; stars make the first components.
3. A class's list has its ``LIST`` nearest inside its component and its ``LIST`` nearest
   outside.  Whatever it may miss inside is compared whole in step 5.  A list whose other half is
   saturated, full of what may be links, is doubled, again and again while it stays so, up to
   ``WIDEST``; the audit stands for what lies beyond.
4. Refinement: at every class, those in its list and a sample of those that list it meet
   (neighbours of neighbours), with 64-byte codes of their vectors.  Each keeps the nearest of
   the others outside its component; pairs that may link two components are confirmed on full
   vectors and join them.  Rounds end when none is joined, no list is doubled and lists hardly
   change.
5. Links are counted inside components without writing pairs out.  In a large one, members
   within half of the limiting angle of its centre (the core) all link with each other, by the
   triangle inequality; what remains is compared in tiles of bounded size.
6. Recall is audited: query classes are compared with everything in blocks, and their true
   links with those counted, copies of their own left out; where they have few links, more
   are asked.  If recall is below ``RECALL``, more orders are drawn and refined; if it stays
   below ``LEAST_RECALL`` an error is raised.  The result has it as a column, null where the
   queries have no link at all, so that nothing was measured.

Cosines are in double precision, by one function for links and counts.  Ids that repeat are
rows of their own; null ids and null labels link with nothing, and their component is their
own id.  Vectors of different lengths link with nothing of another length.  An empty table
has an empty result.  Extra columns are left out, so no name can clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallaxis.llm.cluster import batch_of, materialize, shuffle_partitions
from parallaxis.llm.components import components, star_components

#: Entries of either half of a list, and to how many it is doubled while it is saturated; rows of a run; partners that a row keeps from a meeting.
LIST, WIDEST, RUN, KEEP = 8, 64, 512, 3
#: Random orders at first; their signs; rounds of refinement.
ORDERS, BITS, ROUNDS = 8, 24, 3
#: Bytes of a code, and how far below the limit the cosine of two codes may be for a pair to be confirmed.
CODE, MARGIN = 64, 0.03
#: Members of a component up to which it is one tile, and the most rows of a tile.
WHOLE, TILE = 96, 4096
#: Queries of the audit, how many times as many if they have less than so many links, the recall it asks for, and that below which there is no result.
QUERIES, MORE, ENOUGH, RECALL, LEAST_RECALL = 256, 16, 200, 0.995, 0.9

PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64()), ("kind", pa.int32())])
PAIR_COLUMNS = "a long, b long, score double, kind int"
LINK, INSIDE, OUTSIDE = 0, 1, 2


def unit(raw: list[bytes], dim: int) -> np.ndarray:
    """Rows of unit length from packed floats or doubles of ``dim`` components."""
    if all(len(r) == 4 * dim for r in raw):
        x = np.frombuffer(b"".join(raw), np.float32).astype(float)
    else:
        x = np.concatenate([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64) for r in raw])
    x = x.reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares stay in range
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """All cosines of two blocks of unit rows.  Those next to the limit are summed again row by row, so all callers decide alike."""
    s = x @ y.T
    i, j = np.nonzero(np.abs(s - least) < 1e-9)
    if len(i):
        s[i, j] = row_cosines(x[i], y[j])
    return s


def row_cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(axis=1)


def codes(x: np.ndarray) -> np.ndarray:
    """Unit rows as ``CODE`` small integers: their components, or projections of longer ones."""
    d = x.shape[1]
    if d > CODE:
        x = x @ np.random.default_rng(d).standard_normal((d, CODE))
    top = np.abs(x).max(axis=1, keepdims=True)
    out = np.zeros((len(x), CODE), np.int8)
    out[:, : x.shape[1]] = np.rint(x * (127.0 / np.where(top > 0, top, 1)))
    return out


def code_scores(c: np.ndarray) -> np.ndarray:
    """Cosines of codes within each group of ``(..., n, CODE)``; exact sums of integers, so the same wherever two rows meet."""
    c = c.astype(np.float32)
    norm = np.sqrt(np.maximum((c * c).sum(axis=-1), 1).astype(float))
    return (c @ np.swapaxes(c, -1, -2)).astype(float) / (norm[..., :, None] * norm[..., None, :])


def prepared(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, vector, dim``: ``vector`` packed, in single precision where that loses nothing; null where nothing can link."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("vector", pa.binary()), ("dim", pa.int32())])

    def run(batches):
        for b in batches:
            packed, dims = [], []
            for label, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = np.array([np.nan if e is None else e for e in v], float) if v and label is not None else np.zeros(0)
                fine = len(x) and np.isfinite(x).all() and x.any()
                if fine:
                    x = x + 0.0  # signed zeros are equal
                    with np.errstate(over="ignore"):
                        short = x.astype(np.float32)
                    packed.append(short.tobytes() if np.array_equal(short, x) else x.tobytes())
                else:
                    packed.append(None)
                dims.append(len(x) if fine else None)
            yield batch_of(schema, b.column(0), b.column(1), packed, dims)

    picked = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[label_col].cast("string").alias("label"), rows[vector_col].cast("array<double>").alias("vector"))
    return picked.mapInArrow(run, "vec_id long, label string, vector binary, dim int")


def roots_of(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The smallest id reachable from each of a few rows."""
    root = ids.copy()
    some = np.flatnonzero(linked.any(axis=1))
    if len(some):
        near, at, far = linked[np.ix_(some, some)], root[some], np.iinfo(np.int64).max
        while True:
            new = np.minimum(at, np.where(near, at[None, :], far).min(axis=1))
            if (new == at).all():
                break
            at = new
        root[some] = at
    return root


def nearest(score: np.ndarray, allowed: np.ndarray, keep: int):
    """Row and column of the best ``keep`` allowed entries of each row."""
    s = np.where(allowed, score, -9.0)
    keep = min(keep, s.shape[-1])
    top = np.argpartition(-s, keep - 1, axis=-1)[..., :keep]
    value = np.take_along_axis(s, top, -1)
    good = np.nonzero(value > -9)
    return good[:-1], top[good], value[good]


def compare_run(ids: np.ndarray, x: np.ndarray, least: float) -> list:
    """Of a run's rows: links as stars, and each row's nearest inside and outside of what it is linked with."""
    linked = cosines(x, x, least) >= least
    np.fill_diagonal(linked, False)
    root = roots_of(ids, linked)
    star = np.flatnonzero(root != ids)
    out = [(ids[star], root[star], np.ones(len(star)), np.full(len(star), LINK))]
    score, same = code_scores(codes(x)), root[:, None] == root[None, :]
    for kind, allowed in ((INSIDE, same & ~np.eye(len(ids), dtype=bool)), (OUTSIDE, ~same)):
        (i,), j, s = nearest(score, allowed, KEEP)
        out.append((ids[i], ids[j], s, np.full(len(i), kind)))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def first_meetings(classes: DataFrame, orders: int, seed: int, least: float) -> DataFrame:
    """``a, b, score, kind`` from runs of random orders."""
    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("number", pa.int32()), ("signs", pa.int32()), ("id", pa.int64()), ("vector", pa.binary())])

    def sign(batches):
        planes = {}
        for b in batches:
            labels, dims, ids, raw = b.column(1), np.array(b.column(3).to_pylist()), b.column(0), b.column(2).to_pylist()
            for d in np.unique(dims).tolist() if b.num_rows else ():
                at = np.flatnonzero(dims == d)
                x = unit([raw[k] for k in at], d)
                if d not in planes:
                    planes[d] = np.random.default_rng(seed).standard_normal((orders, d, BITS))
                for number in range(orders):
                    bits = (x @ planes[d][number] > 0).astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1))
                    gray = bits.copy()  # neighbours in the order differ by few signs
                    for shift in (1, 2, 4, 8, 16):
                        gray ^= gray >> shift
                    take = pa.array(at)
                    yield batch_of(schema, labels.take(take), np.full(len(at), d, np.int32), np.full(len(at), number, np.int32), gray.astype(np.int32), ids.take(take), b.column(2).take(take))

    def walk(batches):
        held, key, fresh = [], None, 0

        def compare():
            a, b, s, kind = compare_run(np.array([r[0] for r in held]), unit([r[1] for r in held], key[1]), least)
            return batch_of(PAIRS, a, b, s, kind.astype(np.int32))

        for batch in batches:
            for label, dim, number, _, vec_id, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (label, dim, number) != key or len(held) == RUN:
                    if fresh and len(held) > 1:
                        yield compare()
                    held = held[RUN // 2 :] if (label, dim, number) == key else []
                    key, fresh = (label, dim, number), 0
                held.append((vec_id, vector))
                fresh += 1
        if fresh and len(held) > 1:
            yield compare()

    order = ["label", "dim", "number", "signs", "id"]
    dealt = classes.select("id", "label", "vector", "dim").mapInArrow(sign, "label string, dim int, number int, signs int, id long, vector binary")
    dealt = dealt.repartitionByRange(2 * shuffle_partitions(classes.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(walk, PAIR_COLUMNS)


def with_codes(classes: DataFrame) -> DataFrame:
    """``id, code`` of classes."""
    schema = pa.schema([("id", pa.int64()), ("code", pa.binary())])

    def run(batches):
        for b in batches:
            dims, raw = np.array(b.column(2).to_pylist()), b.column(1).to_pylist()
            for d in np.unique(dims).tolist() if b.num_rows else ():
                at = np.flatnonzero(dims == d)
                yield batch_of(schema, b.column(0).take(pa.array(at)), [c.tobytes() for c in codes(unit([raw[k] for k in at], d))])

    return classes.select("id", "vector", "dim").mapInArrow(run, "id long, code binary")


def best(pairs: DataFrame, wide: DataFrame | None = None, most: int = LIST) -> DataFrame:
    """The nearest ``LIST`` of each class inside its component, and the nearest outside (``size`` of those in ``wide``, up to ``most``); ``fresh`` where no old entry."""
    rank = F.dense_rank().over(W.partitionBy("a").orderBy(F.desc("score"), "b"))  # repeated entries are ties
    inside, outside = [pairs.where(F.col("kind") == kind).withColumn("rank", rank) for kind in (INSIDE, OUTSIDE)]
    if wide is not None:
        outside = outside.where(F.col("rank") <= most).join(wide, outside["a"] == wide["id"], "left").where(F.col("rank") <= F.coalesce("size", F.lit(LIST))).drop("id", "size")
    else:
        outside = outside.where(F.col("rank") <= LIST)
    return inside.where(F.col("rank") <= LIST).unionByName(outside).groupBy("a", "b", "kind").agg(F.first("score").alias("score"), F.min("fresh").alias("fresh"))


def saturated(lists: DataFrame, wide: DataFrame | None, least: float) -> DataFrame:
    """``id, size`` of the classes whose list of others is full of what may be links: as many again are to be listed."""
    full = lists.where(F.col("kind") == OUTSIDE).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    full = full.where(F.col("low") >= least - MARGIN)
    full = full.withColumn("size", F.lit(LIST)) if wide is None else full.join(wide, "id", "left").withColumn("size", F.coalesce("size", F.lit(LIST)))
    return full.where((F.col("n") >= F.col("size")) & (F.col("size") < WIDEST)).select("id", (2 * F.col("size")).alias("size"))


def attached(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lists with the codes and components of both ends, and with the half that each entry now belongs to."""
    node = nodes.select("id", "code", "component")
    at = lambda end: node.select(F.col("id").alias(end), F.col("code").alias(f"code_{end}"), F.col("component").alias(f"of_{end}"))
    kind = F.when(F.col("of_a") == F.col("of_b"), INSIDE).otherwise(OUTSIDE)
    return lists.select("a", "b", "score").join(at("a"), "a").join(at("b"), "b").withColumn("kind", kind)


def meetings(full: DataFrame, least: float, size: int = LIST) -> DataFrame:
    """``a, b, score, kind`` of neighbours of neighbours: what each may list, and pairs (``LINK``) that may join two components.

    At a class meet its list and, up to as many, those that list it, chosen by a hash.  ``size`` is
    that of the longest list.
    """
    rows = full.select(F.col("a").alias("via"), F.lit(0).alias("back"), F.col("b").alias("id"), F.col("code_b").alias("code"), F.col("of_b").alias("component"))
    rows = rows.unionByName(full.select(F.col("b").alias("via"), F.lit(1).alias("back"), F.col("a").alias("id"), F.col("code_a").alias("code"), F.col("of_a").alias("component")))
    most = 4 * size
    place = F.row_number().over(W.partitionBy("via").orderBy("back", F.xxhash64("via", "id"), "id"))
    rows = rows.withColumn("place", place).where(F.col("place") <= most).select("via", "id", "code", "component")

    def meet(via, ids, code, component):
        start = np.flatnonzero(np.concatenate([[True], via[1:] != via[:-1]]))
        size = np.diff(np.concatenate([start, [len(via)]]))
        step = max(1, (1 << 21) // int(size.max()) ** 2)
        for low in range(0, len(start), step):
            first, n = start[low : low + step], size[low : low + step]
            index = first[:, None] + np.arange(n.max())[None, :]
            there = np.arange(n.max())[None, :] < n[:, None]
            index = np.where(there, index, 0)
            own, comp = ids[index], component[index]
            score = code_scores(code[index])
            allowed = there[:, :, None] & there[:, None, :] & (comp[:, :, None] != comp[:, None, :])
            (g, i), j, s = nearest(score, allowed, KEEP)
            a, b = own[g, i], own[g, j]
            yield a, b, s, np.full(len(a), OUTSIDE)
            maybe = s >= least - MARGIN
            yield np.minimum(a, b)[maybe], np.maximum(a, b)[maybe], s[maybe], np.full(maybe.sum(), LINK)

    def walk(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            x = [b.column(0).to_numpy(), b.column(1).to_numpy(), np.frombuffer(b"".join(b.column(2).to_pylist()), np.int8).reshape(-1, CODE), b.column(3).to_numpy()]
            x = x if held is None else [np.concatenate(p) for p in zip(held, x, strict=True)]
            cut = int(np.flatnonzero(x[0] != x[0][-1])[-1]) + 1 if x[0][0] != x[0][-1] else 0
            held = [c[cut:] for c in x]
            for out in meet(*(c[:cut] for c in x)) if cut else ():
                yield batch_of(PAIRS, *out[:3], out[3].astype(np.int32))
        for out in meet(*held) if held is not None else ():
            yield batch_of(PAIRS, *out[:3], out[3].astype(np.int32))

    return rows.mapInArrow(walk, PAIR_COLUMNS)


def confirm(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs ``a, b`` whose cosine reaches the limit."""
    vec = classes.select("id", "vector", "dim")
    both = pairs.join(vec.select(F.col("id").alias("a"), F.col("vector").alias("x"), "dim"), "a").join(vec.select(F.col("id").alias("b"), F.col("vector").alias("y")), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b in batches:
            dims, x, y = np.array(b.column(4).to_pylist()), b.column(2).to_pylist(), b.column(3).to_pylist()
            for d in np.unique(dims).tolist() if b.num_rows else ():
                at = np.flatnonzero(dims == d)
                keep = pa.array(at[row_cosines(unit([x[k] for k in at], d), unit([y[k] for k in at], d)) >= least])
                yield batch_of(schema, b.column(0).take(keep), b.column(1).take(keep))

    return both.select("a", "b", "x", "y", "dim").mapInArrow(run, "a long, b long")


def merged(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the components that links between some of them join."""
    of = lambda end: nodes.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
    between = links.join(of("a"), "a").join(of("b"), "b").where("of_a != of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()
    joined = components(between).toDF("component", "into")
    return nodes.join(joined, "component", "left").select("id", "code", F.coalesce("into", "component").alias("component"))


def descend(classes: DataFrame, state, orders: int, seed: int, rounds: int, least: float):
    """Draw orders, then refine: ``(nodes, lists)`` with ``nodes`` the classes' codes and components."""
    met = materialize(first_meetings(classes, orders, seed, least), "met")
    links = met.where(F.col("kind") == LINK).select("a", "b")
    if state is None:
        stars = star_components(links)
        nodes = with_codes(classes).join(stars, "id", "left").select("id", "code", F.coalesce("component", "id").alias("component"))
        lists = met.where(F.col("kind") != LINK).withColumn("fresh", F.lit(1))
    else:
        nodes, lists = merged(state[0], links), state[1].unionByName(met.where(F.col("kind") != LINK).withColumn("fresh", F.lit(1)))
    nodes, lists = materialize(nodes, "nodes"), materialize(best(lists), "lists")
    wide, most, left = None, LIST, rounds
    while left > 0:
        left -= 1
        full = materialize(attached(lists, nodes), "full")
        new = materialize(meetings(full, least, most), "met")
        maybe = new.where(F.col("kind") == LINK).select("a", "b").distinct()
        links = materialize(confirm(maybe, classes, least), "links")
        joined = not links.isEmpty()
        if joined:
            nodes = materialize(merged(nodes, links), "nodes")
        lists = materialize(best(full.select("a", "b", "score", "kind").withColumn("fresh", F.lit(0)).unionByName(new.where(F.col("kind") == OUTSIDE).withColumn("fresh", F.lit(1))), wide, most), "lists")
        more = materialize(saturated(lists, wide, least), "saturated") if most < WIDEST and rounds else None
        if more is not None and not more.isEmpty():
            wide = more if wide is None else materialize(more.unionByName(wide.join(more, "id", "left_anti")), "wide")
            most, left = 2 * most, max(left, 1)  # a longer list is filled by another round at least
            continue
        r = lists.agg(F.sum("fresh").alias("fresh"), F.count(F.lit(1)).alias("all")).first()
        if not joined and (not r["all"] or r["fresh"] <= 0.2 * r["all"]):
            break
    return nodes, lists


def count_links(members: DataFrame, least: float) -> DataFrame:
    """``id, n``: vectors linked to each class, from ``id, component, vector, dim, copies`` of components of two classes or more.

    Its own copies count too, without itself.
    """
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def count(table: pa.Table) -> pa.Table:
        ids, copies, tile = (table[c].to_numpy() for c in ("id", "copies", "tile"))
        x, (t1, t2) = unit(table["vector"].to_pylist(), table["dim"][0].as_py()), (table["t1"][0].as_py(), table["t2"][0].as_py())
        n = np.zeros(len(ids), np.int64)
        left, right = np.flatnonzero(tile == t1), np.flatnonzero(tile == t2)
        for at in range(0, len(left), 1024):
            rows = left[at : at + 1024]
            linked = (cosines(x[rows], x[right], least) >= least) & (ids[rows, None] != ids[right])
            if t1 == t2:
                n[rows] = linked @ copies[right] + copies[rows] - 1
            else:
                n[rows] += linked @ copies[right]
                n[right] += copies[rows] @ linked
        return pa.table([pa.array(ids), pa.array(n)], schema=schema)

    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sized = materialize(members.join(sizes, "component"), "members")
    plain = ["id", "component", "vector", "dim", "copies", "tile", "t1", "t2"]
    zero = F.lit(0).cast("long")
    pairs = sized.where(F.col("size") <= WHOLE).select("id", "component", "vector", "dim", "copies", zero.alias("tile"), zero.alias("t1"), zero.alias("t2"))
    large = sized.where(F.col("size") > WHOLE)
    cored = None
    if not large.isEmpty():
        cored = materialize(with_core(large, least), "cored")
        parts = cored.groupBy("component").agg(F.count_if("core").alias("cores"), F.count_if(~F.col("core")).alias("outers"), F.coalesce(F.sum(F.when(F.col("core"), F.col("copies"))), F.lit(0)).alias("core_copies"))
        tiles = lambda n: F.greatest(F.ceil(F.col(n) / TILE), F.least(F.lit(64), F.ceil(F.col(n) / WHOLE)))
        cored = cored.join(materialize(parts, "parts"), "component").withColumn("outer_tiles", tiles("outers")).withColumn("core_tiles", tiles("cores"))
        # tiles of the outer members come first, and every pair of tiles with one of them meets
        h = F.xxhash64("id")
        tile = F.when(F.col("core"), F.col("outer_tiles") + F.pmod(h, F.col("core_tiles"))).otherwise(F.pmod(h, F.col("outer_tiles")))
        last = F.when(F.col("core"), F.col("outer_tiles")).otherwise(F.col("outer_tiles") + F.col("core_tiles")) - 1
        met = cored.withColumn("tile", tile).where(last >= 0).withColumn("other", F.explode(F.sequence(zero, last)))
        met = met.withColumn("t1", F.least("tile", "other")).withColumn("t2", F.greatest("tile", "other"))
        pairs = pairs.unionByName(met.select(*plain))
    counted = pairs.groupBy("component", "t1", "t2").applyInArrow(count, "id long, n long")
    if cored is not None:
        counted = counted.unionByName(cored.where("core").select("id", (F.col("core_copies") - 1).alias("n")))
    return counted.groupBy("id").agg(F.sum("n").cast("long").alias("n"))


def with_core(members: DataFrame, least: float) -> DataFrame:
    """Adds ``core``: whether a member is within half of the limiting angle of its component's mean direction."""
    schema = pa.schema([("component", pa.int64()), ("total", pa.binary())])

    def add(batches):
        for b in batches:
            if b.num_rows:
                comp, dims, raw = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(1).to_pylist()
                for c in np.unique(comp):
                    at = np.flatnonzero(comp == c)
                    yield batch_of(schema, [c], [unit([raw[k] for k in at], int(dims[at[0]])).sum(axis=0).tobytes()])

    def centre(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table["total"].to_pylist()), float).reshape(table.num_rows, -1).sum(axis=0)
        return pa.table([pa.array([table["component"][0].as_py()], pa.int64()), pa.array([x.tobytes()], pa.binary())], schema=schema)

    sums = members.select("component", "vector", "dim").mapInArrow(add, "component long, total binary")
    centres = materialize(sums.groupBy("component").applyInArrow(centre, "component long, total binary"), "centres")
    within = math.acos(min(1.0, least)) / 2 - 1e-6 if least > 0 else -1.0  # a little less: rounding never makes a core pair no link
    out = pa.schema([("id", pa.int64()), ("component", pa.int64()), ("vector", pa.binary()), ("dim", pa.int32()), ("copies", pa.int64()), ("core", pa.bool_())])

    def mark(batches):
        for b in batches:
            core, dims, raw, totals = [], b.column(3).to_numpy(), b.column(2).to_pylist(), b.column(5).to_pylist()
            for d, v, c in zip(dims.tolist(), raw, totals, strict=True):
                c = np.frombuffer(c, float)
                norm = np.sqrt(c @ c)
                core.append(bool(norm > 0 and within > 0 and unit([v], d)[0] @ c / norm >= math.cos(within)))
            yield batch_of(out, *b.columns[:5], core)

    both = members.join(centres, "component").select("id", "component", "vector", "dim", "copies", "total")
    return both.mapInArrow(mark, "id long, component long, vector binary, dim int, copies long, core boolean")


def audit(classes: DataFrame, counts: DataFrame, least: float) -> float | None:
    """The share of the query classes' links to other classes that ``counts`` (``id, n``) has; null if they have none.

    A class's own copies are no evidence, so they are left out.  Too few links make too little of
    it, so then there are ``MORE`` times as many queries.
    """
    for queries in (QUERIES, MORE * QUERIES):
        r = audited(classes, counts, least, queries)
        if (r["all"] or 0) >= ENOUGH:
            break
    return r["met"] / r["all"] if r["all"] else None


def audited(classes: DataFrame, counts: DataFrame, least: float, queries: int):
    """``all``, the links of some query classes, found by comparing them with everything in blocks, and ``met``, how many were counted."""
    picked = classes.orderBy(F.xxhash64("id"), "id").limit(queries).select("id", "label", "dim", "vector").collect()  # as many rows as queries
    groups = {}
    for r in picked:
        groups.setdefault((r["label"], r["dim"]), []).append((r["id"], bytes(r["vector"])))
    groups = {k: (np.array([i for i, _ in v]), unit([x for _, x in v], k[1])) for k, v in groups.items()}
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            labels, raw, dims, copies = (b.column(k).to_pylist() for k in range(4))
            copies, by = np.array(copies), {}
            for k, key in enumerate(zip(labels, dims, strict=True)):
                if key in groups:
                    by.setdefault(key, []).append(k)
            for key, at in by.items():
                asked, q = groups[key]
                for low in range(0, len(at), 2048):
                    part = at[low : low + 2048]
                    yield batch_of(schema, asked, (cosines(q, unit([raw[k] for k in part], key[1]), least) >= least) @ copies[part])

    true = classes.select("label", "vector", "dim", "copies").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n_all"))
    asked = true.join(counts, "id", "left").join(classes.select("id", "copies"), "id")
    other = F.col("n_all") - F.col("copies")  # every copy links with itself here
    met = F.greatest(F.coalesce(F.col("n") - F.col("copies") + 1, F.lit(0)), F.lit(0))
    return asked.agg(F.sum(other).alias("all"), F.sum(F.least(other, met)).alias("met")).first()


def embedding_duplicates(rows: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", orders: int = ORDERS, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, n_links, component_id, kept, recall``, a row for each vector; see the module."""
    vectors = materialize(prepared(rows, id_col, vector_col, label_col).withColumn("key", F.xxhash64("label", "vector")), "vectors")
    usable = vectors.where("vector is not null and vec_id is not null")
    classes = usable.groupBy("key", "label", "dim", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    # an id of different vectors: its class of the least key keeps it, others get ids beyond all others until the end
    several = materialize(usable.groupBy("vec_id").agg(F.min("key").alias("lowest"), F.max("key").alias("highest")).where("lowest != highest").select(F.col("vec_id").alias("id"), "lowest"), "several")
    repeats = not several.isEmpty()
    if repeats:
        other = F.lit(1 << 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64("key", "id"), 2))
        classes = classes.join(several, "id", "left").withColumn("id", F.when(F.col("key") != F.col("lowest"), other).otherwise(F.col("id"))).drop("lowest")
    classes = materialize(classes, "classes")
    state, recall = None, 0.0
    for attempt in range(3):
        state = descend(classes, state, orders << attempt, 7 + attempt, rounds, least)
        found = state[0].select("id", "component")
        sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("component")
        members = found.join(sizes, "component").join(classes.select("id", "vector", "dim", "copies"), "id")
        counts = materialize(count_links(members, least), "counts")
        recall = audit(classes, counts, least)
        if recall is None or recall >= RECALL:
            break
    if recall is not None and recall < LEAST_RECALL:
        raise RuntimeError(f"only {recall:.3f} of the audited links were found")
    result = classes.select("id", "key", "label", "vector", "copies").join(found, "id").join(counts, "id", "left")
    result = result.select("key", "label", "vector", F.coalesce("n", F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"))
    linked = usable.join(result, ["key", "label", "vector"]).select("vec_id", "n_links", "component_id")
    if repeats:
        first = linked.groupBy("component_id").agg(F.min("vec_id").alias("first"))
        linked = linked.join(first, "component_id").select("vec_id", "n_links", F.col("first").alias("component_id"))
    alone = vectors.where("vector is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).withColumn("kept", kept).withColumn("recall", F.lit(recall).cast("double"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
