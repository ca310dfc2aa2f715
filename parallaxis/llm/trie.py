"""The prefix trie of conversations, from their globally sorted turn arrays.

A turn is 16 bytes of the SHA-256 of its role and text, so a conversation is a binary key whose
common prefixes are common turns.

1. *Rebuild*: a conversation's turns, and those of the one whose first turns it takes, come
   together by one shuffle of digests and word counts; texts are not moved.
2. *Sort*: keys are sorted globally (ranges of key and id, so copies are split as well).
3. *Sweep*: neighbours' longest common prefix says which nodes of the open stack close.  A node
   hands its counts to its parent as it closes; what is held is one path.
4. *Stitch*: a node on the path of a partition's first or last conversation may go on in the next
   partition.  These open stacks are fragments (as many as two paths are long), and runs of up
   to ``FAN`` neighbouring partitions are stitched by the same stack, level by level, until one
   is left.  No task reads more than ``FAN`` stacks.
5. The conversations that end in a node are hashed as they pass.  Where their run is cut by a
   border or long, it is written in pieces, which are hashed one after another in a task of
   their own (a digest has one order), a piece at a time.
6. A node finds its parent's smallest member by a join on the node's id, a digest of its path.

Rows without ``conv_id`` are of no conversation and are left out.  Turns are in order of ``turn``
(null first), and those of equal ``turn`` in the order of their digests, so the result is the same
for any order of rows; repeated rows are repeated turns.  Null roles and texts are empty.  A
conversation whose turns all go is turnless: it ends in the root.  Without conversations there
is no node, not even a root.  Texts of any length are read whole; the turns of one conversation
(20 bytes each) are held together.  Columns other than the four are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.llm.cluster import batch_of, materialize, shuffle_partitions

TURN = 16
#: Partitions stitched by one task; ids in a piece; rows of a batch that is handed out.
FAN, PIECE, ROWS = 64, 1 << 14, 2048
GROUP, HEADS = 20, 4
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(convs: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, words``; see the module for nulls and ties."""
    whole = lambda c: F.coalesce(convs[c].cast("string"), F.lit(""))
    said = convs.select(convs["conv_id"].cast("long").alias("conv_id"), convs["turn"].cast("long").alias("turn"), whole("role").alias("role"), whole("text").alias("text"))
    of = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    words = F.expr(r"regexp_count(text, r'[^\x20\x09-\x0D]+')").cast("long")
    return said.where("conv_id is not null").select("conv_id", "turn", F.substring(F.unhex(F.sha2(of.cast("binary"), 256)), 1, TURN).alias("digest"), words.alias("words"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, path, words``: the first h turns of the group's first conversation, then the own ones after the first h."""
    group = F.expr(f"conv_id - conv_id % {GROUP}")
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    rows = turns.select(group.alias("of"), (F.col("conv_id") != group).alias("later"), "conv_id", heads.alias("heads"), "turn", "digest", "words")
    rows = rows.repartition(shuffle_partitions(turns.sparkSession), "of").sortWithinPartitions("of", "later", "conv_id", F.col("turn").asc_nulls_first(), "digest")
    schema = pa.schema([("conv_id", pa.int64()), ("path", pa.binary()), ("words", pa.binary())])

    def run(batches):
        of, first, held, out = None, (b"", b""), None, []

        def finished():
            nonlocal first
            group, conv, h, path, words = held
            path, words = b"".join(path), b"".join(words)
            if group != of:
                first = (b"", b"")
            if conv == group:
                first = (path[: HEADS * TURN], words[: HEADS * 8])
            return conv, first[0][: h * TURN] + path[h * TURN :], first[1][: h * 8] + words[h * 8 :]

        for b in batches:
            ids, groups, h = (b.column(k).to_numpy() for k in (2, 0, 3))
            digests, words = b.column(5).to_pylist(), b.column(6).to_numpy().astype("<i8")
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if held is None or held[1] != ids[low]:
                    if held is not None:
                        out.append(finished())
                        of = held[0]
                    held = (int(groups[low]), int(ids[low]), int(h[low]), [], [])
                held[3].append(b"".join(digests[low:high]))
                held[4].append(words[low:high].tobytes())
                if len(out) >= ROWS:
                    yield batch_of(schema, *zip(*out, strict=True))
                    out = []
        if held is not None:
            out.append(finished())
            yield batch_of(schema, *zip(*out, strict=True))

    return rows.mapInArrow(run, "conv_id long, path binary, words binary")


class Node:
    """A node while it is open; its numbers are those of what has closed below it and of what ends in it."""

    __slots__ = ("depth", "turn", "words", "id", "parent", "left", "members", "least", "children", "leaves", "saved", "ends")

    def __init__(self, depth, turn, words, id, parent, left, members=0, least=None, children=0, leaves=0, saved=0, ends=None):  # noqa: A002
        self.depth, self.turn, self.words, self.id, self.parent, self.left = depth, turn, words, id, parent, left
        self.members, self.least, self.children, self.leaves, self.saved, self.ends = members, least, children, leaves, saved, ends

    def add(self, other: Node) -> None:
        """Another fragment of the same node."""
        self.members += other.members
        self.least = other.least if self.least is None else self.least if other.least is None else min(self.least, other.least)
        self.children, self.leaves, self.saved = self.children + other.children, self.leaves + other.leaves, self.saved + other.saved
        self.ends = self.ends or other.ends

    def close(self) -> None:
        self.leaves = self.leaves or 1
        self.saved += (self.members - 1) * self.words

    def take(self, child: Node) -> None:
        """A closed child's numbers."""
        self.members += child.members
        self.least = child.least if self.least is None else min(self.least, child.least)
        self.children, self.leaves, self.saved = self.children + 1, self.leaves + child.leaves, self.saved + child.saved

    def row(self) -> tuple:
        return tuple(getattr(self, name) for name in self.__slots__)


#: ``kind`` 0: a finished node; 1: an open fragment, at ``place`` in its block's order; 2: a piece of the ids that end in a node.
KIND = pa.schema([
    ("kind", pa.int32()), ("block", pa.int64()), ("place", pa.int64()), ("depth", pa.int64()), ("turn", pa.binary()), ("words", pa.int64()), ("id", pa.binary()), ("parent", pa.binary()), ("left", pa.bool_()),
    ("members", pa.int64()), ("least", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()),
])
KIND_COLUMNS = "kind int, block long, place long, depth long, turn binary, words long, id binary, parent binary, left boolean, members long, least long, children long, leaves long, saved long, ends string"


class Sweep:
    """The open stack of a block, and what it gives out: rows of ``KIND``."""

    def __init__(self, block: int, last: bool = False):
        self.block, self.last, self.stack, self.edge, self.rows = block, last, [], [], []

    def close_to(self, depth: int) -> None:
        """Close nodes deeper than ``depth``; those on the block's first path stay fragments."""
        while len(self.stack) > depth + 1:
            node = self.stack.pop()
            if node.left:
                self.edge.append(node)
            else:
                node.close()
                self.rows.append((0, self.block, 0, *node.row()))
                self.stack[-1].take(node)

    def push(self, turn: bytes, words: int, left: bool) -> None:
        above = self.stack[-1] if self.stack else None
        id_ = hashlib.sha256(above.id + turn).digest()[:TURN] if above else b""
        self.stack.append(Node(len(self.stack), turn, words, id_, above.id if above else None, left))

    def fragment(self, node: Node, left: bool) -> None:
        """The next fragment of a block, in the order of the tree: it goes on an open node or opens one."""
        if node.depth < len(self.stack) and self.stack[node.depth].turn == node.turn:
            self.stack[node.depth].add(node)
            return
        self.close_to(node.depth - 1)
        node.left = left
        self.stack.append(node)

    def finish(self) -> None:
        if self.last:
            self.close_to(0)
            for root in self.stack:
                root.close()
                self.rows.append((0, self.block, 0, *root.row()))
            self.stack = []
        path = [*(n for n in self.stack if n.left), *reversed(self.edge), *(n for n in self.stack if not n.left)]
        self.rows += [(1, self.block, k, *n.row()) for k, n in enumerate(path)]

    def ready(self, least: int = 1):
        """Batches of the rows so far, if there are so many."""
        if len(self.rows) >= least:
            for k in range(0, len(self.rows), ROWS):
                yield batch_of(KIND, *zip(*self.rows[k : k + ROWS], strict=True))
            self.rows = []


class Ends:
    """The ids of a run of equal conversations, of the node on top of the stack."""

    def __init__(self, sweep: Sweep, first: bool):
        self.sweep, self.ids, self.piece, self.cut = sweep, [], 0, first

    def add(self, conv: int) -> None:
        self.ids.append(conv)
        if len(self.ids) >= PIECE:
            self.write()

    def write(self) -> None:
        self.cut = True
        text = ",".join(map(str, self.ids))
        self.sweep.rows.append((2, self.sweep.block, self.piece, 0, None, 0, self.node.id, None, None, 0, None, 0, 0, 0, text))
        self.piece, self.ids = self.piece + 1, []

    def finish(self, border: bool) -> None:
        """At the run's end: hashed whole if it lies within the block."""
        if self.cut or border:
            if self.ids:
                self.write()
        else:
            self.node.ends = hashlib.sha256(",".join(map(str, self.ids)).encode()).hexdigest()

    def start(self, node: Node) -> Ends:
        self.node = node
        return self


def swept(paths: DataFrame) -> DataFrame:
    """Rows of ``KIND`` from the sorted paths; a partition is a block."""

    def run(batches):
        sweep, ends, before = Sweep(TaskContext.get().partitionId()), None, None
        for b in batches:
            ids = b.column(0).to_numpy().tolist()
            for conv, path, words in zip(ids, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if path != before:
                    if ends:
                        ends.finish(False)
                    depth, most = 0, 0 if before is None else min(len(path), len(before)) // TURN
                    while depth < most and path[depth * TURN : (depth + 1) * TURN] == before[depth * TURN : (depth + 1) * TURN]:
                        depth += 1
                    if before is None:
                        sweep.push(b"", 0, True)
                    sweep.close_to(depth)
                    for k in range(depth, len(path) // TURN):
                        sweep.push(path[k * TURN : (k + 1) * TURN], int.from_bytes(words[k * 8 : k * 8 + 8], "little"), before is None)
                    ends, before = Ends(sweep, before is None).start(sweep.stack[-1]), path
                node = sweep.stack[-1]
                node.members += 1
                node.least = conv if node.least is None else min(node.least, conv)
                ends.add(conv)
                yield from sweep.ready(ROWS)
        if ends:
            ends.finish(True)
            sweep.finish()
            yield from sweep.ready()

    return paths.mapInArrow(run, KIND_COLUMNS)


def stitched(fragments: DataFrame, last: bool) -> DataFrame:
    """Runs of ``FAN`` neighbouring blocks as one block each."""

    def run(batches):
        sweep, before = None, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                into, block = row[-1], row[1]
                if sweep is None or sweep.block != into:
                    if sweep is not None:
                        sweep.finish()
                        yield from sweep.ready()
                    sweep, first = Sweep(into, last), block
                node = Node(*row[3:-1])
                sweep.fragment(node, node.left and block == first and not last)
                yield from sweep.ready(ROWS)
        if sweep is not None:
            sweep.finish()
            yield from sweep.ready()

    n = shuffle_partitions(fragments.sparkSession)
    rows = fragments.withColumn("into", F.floor(F.col("block") / FAN)).repartition(n, "into").sortWithinPartitions("into", "block", "place")
    return rows.mapInArrow(run, KIND_COLUMNS)


def hashed_pieces(pieces: DataFrame) -> DataFrame:
    """``id, cut_ends``: the digest of a node's pieces one after another, in the order of blocks."""
    schema = pa.schema([("id", pa.binary()), ("cut_ends", pa.string())])

    def run(batches):
        node, digest = None, None
        for b in batches:
            done = []
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if id_ != node:
                    if digest:
                        done.append((node, digest.hexdigest()))
                    node, digest = id_, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if done:
                yield batch_of(schema, *zip(*done, strict=True))
        if digest:
            yield batch_of(schema, [node], [digest.hexdigest()])

    n = shuffle_partitions(pieces.sparkSession)
    rows = pieces.repartition(n, "id").sortWithinPartitions("id", "block", "place").select("id", "ends")
    return rows.mapInArrow(run, "id binary, cut_ends string")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """A row for each node: see the module, and the columns of :func:`op11_prefix_trie`."""
    spark = convs.sparkSession
    n = shuffle_partitions(spark)
    paths = materialize(rebuilt(turns_of(convs)), "paths")
    rows = materialize(swept(paths.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")), "swept")
    nodes, pieces, blocks = rows.where("kind = 0"), rows.where("kind = 2"), n
    while True:
        blocks = -(-blocks // FAN)
        rows = materialize(stitched(rows.where("kind = 1"), blocks == 1), "stitched")
        nodes = nodes.unionByName(rows.where("kind = 0"))
        if blocks == 1:
            break
    nodes = nodes.join(hashed_pieces(pieces), "id", "left")
    above = nodes.where("children > 0").select(F.col("id").alias("parent"), F.col("least").alias("parent_conv_id"))
    below = nodes.select(
        "parent",
        F.col("least").alias("conv_id"),
        "depth",
        F.col("members").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("cut_ends", "ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
    return below.join(above, "parent", "left")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
