"""Connected components of a link table, by rounds of joins.

Alternates two rewrites of the links until they no longer change.  *Large star*: every
neighbour with a larger id is linked to the smallest neighbour (or the vertex itself).
*Small star*: every neighbour with a smaller id, and the vertex, is linked to the smallest.
Both keep components and move links towards stars around each component's smallest id;
the number of rounds grows with the logarithm of the number of vertices.

Stars found within blocks of rows are contracted first (:func:`star_components`): a vertex has
few of them, whatever its degree, and only their centres take part in the rounds.

A vertex of any degree is handled by a partial minimum and an equi-join, whose skewed keys
Spark splits; each round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxis.llm.cluster import batch_of, materialize, shuffle_partitions


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 30)).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component``: the smallest id reachable, for every id that has a link to another."""
    big, small = F.greatest(a, b), F.least(a, b)
    links = materialize(links.where(F.col(a) != F.col(b)).select(big.alias("u"), small.alias("v")).distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        # in `large` every link still points from the larger to the smaller id
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(small_star.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        state, before = _state(links), state
        if state == before:
            break
    stars = links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    roots = links.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return stars.unionByName(roots)


def merged_components(so_far: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``so_far`` (``id, component``) after more links: only what they join takes part in new rounds."""
    of = lambda end, name: so_far.select(F.col("id").alias(end), F.col("component").alias(name))
    ends = links.select(a, b).join(of(a, "of_a"), a, "left").join(of(b, "of_b"), b, "left")
    between = ends.select(F.coalesce("of_a", a).alias("a"), F.coalesce("of_b", b).alias("b")).where("a != b").distinct()
    joined = materialize(components(between), "joined")
    moved = so_far.join(joined.select(F.col("id").alias("component"), F.col("component").alias("into")), "component", "left")
    new = joined.join(so_far.select("id"), "id", "left_anti")
    return moved.select("id", F.coalesce("into", "component").alias("component")).unionByName(new.select("id", "component"))


def star_components(stars: DataFrame) -> DataFrame:
    """``id, component`` of ``a, b`` where ``b`` is the smallest id that ``a`` reaches within some block of rows.

    A row is in a few blocks, so ``a`` repeats a few times only.  Its smallest centre stands
    for it, and its other centres are linked with that one: what is left to join are centres.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def contract(batches):
        held = None
        for batch in batches:
            x = np.stack([c.to_numpy() for c in batch.columns])
            x = x if held is None else np.concatenate([held, x], axis=1)
            if not x.shape[1]:
                continue
            start = np.flatnonzero(np.concatenate([[True], x[0, 1:] != x[0, :-1]]))
            held = x[:, start[-1] :]
            yield pairs_with_least(x[:, : start[-1]], start[:-1])
        if held is not None:
            yield pairs_with_least(held, np.zeros(1, int))

    def pairs_with_least(x, start):
        """The least centre of each ``a`` (rows are sorted), then its other centres with the least."""
        least = np.repeat(x[1, start], np.diff(np.concatenate([start, [x.shape[1]]]))) if len(start) else x[1]
        rest = np.flatnonzero(x[1] != least)
        return batch_of(schema, np.concatenate([x[0, start], x[1, rest]]), np.concatenate([x[1, start], least[rest]]))

    dealt = stars.select("a", "b").repartition(shuffle_partitions(stars.sparkSession), "a").sortWithinPartitions("a", "b")
    # a centre that another centre reaches becomes a pair like any other vertex; both kinds of pairs are links
    pairs = materialize(dealt.mapInArrow(contract, "a long, b long").distinct(), "stars")
    centres = materialize(stars.select(F.col("b").alias("id")).distinct(), "centres")
    between = pairs.join(centres.withColumnRenamed("id", "a"), "a")
    joined = components(between)
    leaves = pairs.join(centres.withColumnRenamed("id", "a"), "a", "left_anti")
    named = leaves.join(joined.select(F.col("id").alias("b"), "component"), "b", "left").select(F.col("a").alias("id"), F.coalesce("component", "b").alias("component"))
    rest = centres.join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return named.unionByName(rest)
