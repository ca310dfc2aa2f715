"""Phrase collocations: frequent phrases of 2 to 4 words, counted as sorted runs of packed ids.

A phrase is no more frequent than its words, so only words with ``least`` occurrences in their
language matter.

1. *Blocks*: texts are read once, cut into words, and become blocks of a few MB: the words of
   a block, one row each with its count, and the block's text as numbers of these words.
2. *Dictionary*: a block's words meet those of other blocks by one shuffle on (lang, word), are
   summed in sorted order, and frequent ones get an id.  Ids go back to the blocks they came
   from; nothing is broadcast.  A block is then a sequence of ids, with breaks at the ends of
   pieces and texts and where a word is not frequent.
3. *Keys*: every run of 2 to 4 ids is a key of 16 bytes (four ids, missing ones 0).  A block
   sorts its keys by radix, counts runs of equal ones, and cuts them at the bounds of ranges;
   a range's share of a block is one row.  So a phrase has one entry for a block, however often
   it occurs.  There is a range for about ``RANGE`` entries; its bounds (16 bytes for each
   range, times ``SAMPLE`` while they are chosen) come from keys sampled by their hash.
4. *Counts*: a range's rows are merged by the same sort and run-length sums; frequent ones stay.
5. What is left is a small table of frequent phrases.  Cuts, drops and the ranking are joins,
   aggregates and windows over it; the ranking takes the first of each of many parts of a
   language before the first of all, so no language meets in one task.

Null texts are empty, a null lang is ``und``.  Lower-casing and splitting are for ASCII only, so
other letters and blanks are parts of words.  Ties are broken by the phrase, so they cannot
occur.  Repeated rows count as often as they are there; ids are not read.  A text longer than a
block is a block.  An empty table has no phrases.  Only text and lang are read, so no other
column can clash.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallaxis.llm.cluster import batch_of, materialize, shuffle_partitions, slices
from parallaxis.llm.hashing import mix

LEAST, TOP, RATIO, SCALE, LONGEST = 30, 2000, 80, 2_000_000, 4
#: Bytes of text in a block and of text cut at once; rows of a batch; entries of a range; sampled keys for each.
BLOCK, AT_ONCE, ROWS, RANGE, SAMPLE = 8 << 20, 1 << 20, 8192, 1 << 20, 32

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[list(b".,;:!?\n\x0b\x0c\r")] = 10  # what ends a piece, fixed by the contract
_TABLE[9] = 32
TABLE = _TABLE.tobytes()
_CUT = re.compile(rb"[\t .,;:!?\n-\r]")
GAP, END = 0, 1  # numbers of the empty word between two blanks, and of a piece's end

BLOCKS = pa.schema([("block", pa.int64()), ("number", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("body", pa.binary())])


def squeezed(a: np.ndarray) -> bytes:
    """Integers as their bytes place by place, compressed: the high ones are zeros."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
    return len(a).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def spread_out(raw: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(raw[8:], n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


class Block:
    """The words of some texts by number, in the order in which they first occur."""

    def __init__(self):
        self.size, self.parts, numbers = 0, [], count(END + 1)
        self.words = defaultdict(lambda: defaultdict(numbers.__next__, {b"": GAP, b"\n": END}))

    def add(self, lang: str, text: bytes) -> None:
        number, start = self.words[lang].__getitem__, 0
        while start < len(text):
            end = start + AT_ONCE
            if end < len(text):
                cut = _CUT.search(text, end)
                end = cut.start() if cut else len(text)
            words = text[start:end].translate(TABLE).replace(b"\n", b" \n ").split(b" ")
            part = np.fromiter(map(number, words), np.int32, len(words))
            self.parts.append(part[part != GAP])
            start = end
        self.parts.append(np.array([END], np.int32))
        self.size += len(text)

    def rows(self, block: int):
        """Its words, then (numbered 0) its body, as batches of ``BLOCKS``."""
        body = np.concatenate(self.parts)
        counts = np.bincount(body, minlength=1)
        for lang, numbers in self.words.items():
            new = [(w, k) for w, k in numbers.items() if k > END]
            for at in range(0, len(new), ROWS):
                part = new[at : at + ROWS]
                n = len(part)
                yield batch_of(BLOCKS, [block] * n, [k for _, k in part], [lang] * n, [w.decode() for w, _ in part], counts[[k for _, k in part]], [None] * n)
        yield batch_of(BLOCKS, [block], [0], [None], [None], [len(body)], [squeezed(body)])


def blocks_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``block, number, lang, word, n`` of a block's words; at number 0 its ``body``."""

    def run(batches):
        held, block = Block(), TaskContext.get().partitionId() << 32
        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.add(lang, (text.as_py() or "").encode())
                if held.size >= BLOCK:
                    yield from held.rows(block)
                    held, block = Block(), block + 1
        if held.parts:
            yield from held.rows(block)

    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "block long, number long, lang string, word string, n long, body binary")


def dictionary(words: DataFrame, least: int) -> DataFrame:
    """Frequent words and who asked for them.

    A row with ``word`` is an entry: ``part, at`` (which make its id), ``lang, word, n``.  A row with
    ``block`` says that this block's ``number`` is that entry.
    """
    schema = pa.schema([("part", pa.int64()), ("at", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("block", pa.int64()), ("number", pa.int64())])

    def run(batches):
        part, at, held = TaskContext.get().partitionId(), 0, None

        def done(rows):
            nonlocal at
            if not rows.num_rows:
                return
            lang, word, n = rows.column(0), rows.column(1), rows.column(4).to_numpy()
            new = np.ones(rows.num_rows, bool)
            same = pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(word[1:], word[:-1]))
            new[1:] = ~same.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            total = np.add.reduceat(n, starts)
            frequent = total >= least
            ids = at + np.cumsum(frequent) - 1
            keep = np.flatnonzero(frequent)
            if len(keep):
                first = pa.array(starts[keep])
                none = pa.nulls(len(keep), pa.int64())
                yield batch_of(schema, np.full(len(keep), part), ids[keep], lang.take(first), word.take(first), total[keep], none, none)
                run_of = np.cumsum(new) - 1
                asked = np.flatnonzero(frequent[run_of])
                nothing = pa.nulls(len(asked), pa.string())
                yield batch_of(schema, np.full(len(asked), part), ids[run_of[asked]], nothing, nothing, pa.nulls(len(asked), pa.int64()), rows.column(2).to_numpy()[asked], rows.column(3).to_numpy()[asked])
            at += len(keep)

        for b in batches:
            if not b.num_rows:
                continue
            rows = b if held is None else pa.concat_batches([held, b])
            lang, word, last = rows.column(0), rows.column(1), rows.num_rows - 1
            # the last run stays, as it may go on
            tail = np.flatnonzero(~(pc.and_(pc.equal(lang, lang[last]), pc.equal(word, word[last]))).to_numpy(zero_copy_only=False))
            cut = int(tail[-1]) + 1 if len(tail) else 0
            yield from done(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield from done(held)

    n = shuffle_partitions(words.sparkSession)
    rows = words.where("number > 0").select("lang", "word", "block", "number", "n").repartition(n, "lang", "word").sortWithinPartitions("lang", "word")
    return rows.mapInArrow(run, "part long, at long, lang string, word string, n long, block long, number long")


def encoded(bodies: DataFrame, asked: DataFrame, offsets: dict[int, int]) -> DataFrame:
    """``block, ids``: each block's text as ids (0 where it breaks)."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.binary())])
    none = F.lit(None)
    rows = bodies.select("block", F.lit(0).cast("long").alias("number"), none.cast("long").alias("part"), none.cast("long").alias("at"), "body")
    rows = rows.unionByName(asked.select("block", "number", "part", "at", none.cast("binary").alias("body")))
    first = np.zeros(max(offsets, default=0) + 1, np.int64)
    first[list(offsets)] = list(offsets.values())

    def run(batches):
        body, numbers, ids, block = None, [], [], None

        def done():
            known = np.zeros(int(body.max()) + 1, np.uint32)
            if numbers:
                known[np.concatenate(numbers)] = np.concatenate(ids)
            return batch_of(schema, [block], [squeezed(known[body])])

        for b in batches:
            blocks = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)] if len(blocks) else []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if block != int(blocks[low]):
                    if body is not None:
                        yield done()
                    block, numbers, ids = int(blocks[low]), [], []
                    body = spread_out(b.column(4)[low].as_py(), np.int32)
                    low += 1
                part, at = (b.column(k).slice(low, high - low).to_numpy(zero_copy_only=False) for k in (2, 3))
                numbers.append(b.column(1).slice(low, high - low).to_numpy())
                ids.append((first[part.astype(np.int64)] + at.astype(np.int64) + 1).astype(np.uint32))
        if body is not None:
            yield done()

    n = shuffle_partitions(bodies.sparkSession)
    return rows.repartition(n, "block").sortWithinPartitions("block", "number").mapInArrow(run, "block long, ids binary")


def keys_of(ids: np.ndarray) -> np.ndarray:
    """The keys of all runs of 2 to ``LONGEST`` ids, as two rows of 64 bits."""
    ids = np.concatenate([ids, np.zeros(LONGEST, ids.dtype)])
    n, there = len(ids) - LONGEST, ids > 0
    runs, held = [], there[:n]
    for k in range(1, LONGEST):
        held = held & there[k : n + k]
        runs.append(np.flatnonzero(held))
    out = np.zeros((2, sum(map(len, runs))), np.uint64)
    start = 0
    for size, at in enumerate(runs, 2):
        for k in range(size):
            half = out[k // 2, start : start + len(at)]
            half |= ids[at + k].astype(np.uint64) << np.uint64(32 * (1 - k % 2))
        start += len(at)
    return out


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of two-row keys, by stable counting passes over 16 bits, least ones first; digits alike in all are passed over."""
    order = np.arange(keys.shape[1], dtype=np.int32 if keys.shape[1] < 1 << 31 else np.int64)
    for row in (1, 0):
        for shift in (0, 16, 32, 48):
            digit = (keys[row] >> np.uint64(shift)).astype(np.uint16)
            if digit.size and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and how often each occurs (or the sum of its ``n``)."""
    order = radix_order(keys)
    keys = keys[:, order]
    new = np.ones(keys.shape[1], bool)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    starts = np.flatnonzero(new)
    sums = np.diff(np.append(starts, len(new))) if n is None else np.add.reduceat(n[order], starts) if len(starts) else n
    return keys[:, starts], sums


def sampled_keys(blocks: DataFrame, share: float) -> np.ndarray:
    """The keys whose hash lies below ``share``, sorted."""
    schema = pa.schema([("high", pa.int64()), ("low", pa.int64())])
    limit = np.uint64(min(2**64 - 1, int(share * 2**64)))

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                keys = keys_of(spread_out(raw.as_py(), np.uint32))
                keys = np.unique(keys[:, mix(mix(keys[0]) + keys[1]) <= limit], axis=1)
                yield batch_of(schema, keys[0].view(np.int64), keys[1].view(np.int64))

    rows = blocks.select("ids").mapInArrow(run, "high long, low long").distinct().toPandas()
    keys = np.stack([rows["high"].to_numpy(np.int64), rows["low"].to_numpy(np.int64)]).view(np.uint64)
    return keys[:, radix_order(keys)]


def cuts_at(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the sorted ``keys`` lie below each of the sorted ``bounds``."""
    low, high = np.searchsorted(keys[0], bounds[0], "left"), np.searchsorted(keys[0], bounds[0], "right")
    for k in np.flatnonzero(high > low):
        low[k] += np.searchsorted(keys[1, low[k] : high[k]], bounds[1, k], "left")
    return low


def counted(blocks: DataFrame, bounds: np.ndarray, least: int) -> DataFrame:
    """``high, low, a``: the keys with ``least`` occurrences in all blocks."""
    sent = pa.schema([("range", pa.int64()), ("keys", pa.binary()), ("low", pa.binary()), ("n", pa.binary())])
    given = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("a", pa.int64())])

    def send(batches):
        for b in batches:
            for raw in b.column(0):
                keys, n = run_lengths(keys_of(spread_out(raw.as_py(), np.uint32)))
                at = np.concatenate([[0], cuts_at(keys, bounds), [len(n)]])
                for k in np.flatnonzero(at[1:] > at[:-1]).tolist():
                    some = slice(int(at[k]), int(at[k + 1]))
                    high = np.diff(keys[0, some], prepend=np.uint64(0))
                    yield batch_of(sent, [k], [squeezed(high)], [squeezed(np.ascontiguousarray(keys[1, some]))], [squeezed(n[some])])

    def merge(batches):
        range_, held = None, []

        def reduced():
            return run_lengths(np.concatenate([k for k, _ in held], axis=1), np.concatenate([n for _, n in held]))

        def done():
            keys, n = reduced()
            often = np.flatnonzero(n >= least)
            for at in range(0, len(often), ROWS):
                some = often[at : at + ROWS]
                yield batch_of(given, keys[0, some].view(np.int64), keys[1, some].view(np.int64), n[some])

        for b in batches:
            for k, high, low, n in zip(b.column(0).to_pylist(), *(b.column(c) for c in (1, 2, 3)), strict=True):
                if range_ is not None and k != range_:
                    yield from done()
                    held = []
                range_ = k
                held.append((np.stack([np.cumsum(spread_out(high.as_py(), np.uint64), dtype=np.uint64), spread_out(low.as_py(), np.uint64)]), spread_out(n.as_py(), np.int64)))
                if len(held) > 1 and sum(len(x) for _, x in held) >= 2 * RANGE:
                    held = [reduced()]
        if held:
            yield from done()

    n = shuffle_partitions(blocks.sparkSession)
    rows = blocks.select("ids").mapInArrow(send, "range long, keys binary, low binary, n binary")
    return rows.repartition(n, "range").sortWithinPartitions("range").mapInArrow(merge, "high long, low long, a long")


def phrase_counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (``high, low, a``), frequent words (``id, lang, word, f``), and ``lang, n`` of all words."""
    spark = docs.sparkSession
    blocks = materialize(blocks_of(docs, text_col, lang_col), "blocks")
    found = materialize(dictionary(blocks, least), "dictionary")
    entries = found.where("word is not null")
    parts = {r["part"]: (r["size"], r["total"]) for r in entries.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).collect()}
    offsets, ids = {}, 0
    for part in sorted(parts):
        offsets[part] = ids
        ids += parts[part][0]
    if ids >= 1 << 31:
        raise ValueError("more frequent words than ids of 31 bits")
    body = materialize(encoded(blocks.where("number = 0"), found.where("block is not null"), offsets), "encoded")
    total = (LONGEST - 1) * sum(t for _, t in parts.values())
    ranges = max(4 * shuffle_partitions(spark), -(-total // RANGE))
    keys = sampled_keys(body, SAMPLE * ranges / max(1, total))
    bounds = np.unique(keys[:, [keys.shape[1] * k // ranges for k in range(1, ranges)]], axis=1) if keys.shape[1] else keys
    grams = materialize(counted(body, bounds, least), "phrases")
    numbered = spark.createDataFrame([(p, o) for p, o in offsets.items()], "part long, first long")  # a row for each partition
    words = entries.join(F.broadcast(numbered), "part").select((F.col("first") + F.col("at") + 1).alias("id"), "lang", "word", F.col("n").alias("f"))
    return grams, words, blocks.where("number > 0").groupBy("lang").agg(F.sum("n").alias("n"))


def _key(*ids) -> tuple:
    """High and low half of the key of some ids."""
    at = [*ids, *[F.lit(0).cast("long")] * (LONGEST - len(ids))]
    return F.shiftleft(at[0], 32).bitwiseOR(at[1]), F.shiftleft(at[2], 32).bitwiseOR(at[3])


def _part(*ids):
    high, low = _key(*ids)
    return F.struct(high.alias("h"), low.alias("l"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, ratio: int = RATIO, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases."""
    grams, words, totals = phrase_counts(docs, least, text_col, lang_col)
    words = materialize(words, "words")
    mask = F.lit((1 << 32) - 1).cast("long")
    ids = [F.shiftright("high", 32), F.col("high").bitwiseAND(mask), F.shiftright("low", 32), F.col("low").bitwiseAND(mask)]
    size = F.when(F.col("low") == 0, 2).when(ids[3] == 0, 3).otherwise(4)
    grams = grams.withColumn("size", size)
    counts = grams.select(F.col("high").alias("h"), F.col("low").alias("l"), F.col("a").alias("f"))
    counts = counts.unionByName(words.select(F.shiftleft("id", 32).alias("h"), F.lit(0).cast("long").alias("l"), "f"))

    # both parts of each cut, looked up in one join and brought together again
    cut = lambda n, k: [F.struct(F.lit(2 * k + side).alias("at"), part.alias("part")) for side, part in enumerate((_part(*ids[:k]), _part(*ids[k:n])))]
    cuts = [F.array(*[s for k in range(1, n) for s in cut(n, k)]) for n in (2, 3, 4)]
    sides = grams.select("high", "low", "size", "a", F.explode(F.when(F.col("size") == 2, cuts[0]).when(F.col("size") == 3, cuts[1]).otherwise(cuts[2])).alias("s"))
    sides = sides.select("high", "low", "size", "a", F.col("s.at").alias("at"), F.col("s.part.h").alias("h"), F.col("s.part.l").alias("l"))
    pick = [F.max(F.when(F.col("at") == k, F.col("f"))).alias(f"f{k}") for k in range(2, 2 * LONGEST)]
    scored = sides.join(counts, ["h", "l"]).groupBy("high", "low", "size", "a").agg(*pick)
    exact = lambda k: F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(f{2 * k} as decimal(20,0)) + cast(f{2 * k + 1} as decimal(20,0)))")
    of = lambda k: F.struct(exact(k).alias("score"), F.lit(k).alias("k"), F.col(f"f{2 * k}").alias("l"), F.col(f"f{2 * k + 1}").alias("r"))
    best = F.least(*[F.when(F.col("size") > k, of(k)) for k in range(1, LONGEST)])  # nulls are passed over
    scored = scored.select("high", "low", "a", best.alias("best"))

    # the most frequent longer phrase around each
    inner = lambda n: F.array(*[_part(*ids[i : i + m]) for m in range(2, n) for i in range(n - m + 1)])
    around = grams.where("size > 2").select(F.explode(F.when(F.col("size") == 3, inner(3)).otherwise(inner(4))).alias("p"), "a")
    around = around.groupBy(F.col("p.h").alias("high"), F.col("p.l").alias("low")).agg(F.max("a").alias("longer"))
    kept = scored.join(around, ["high", "low"], "left").where(f"longer is null or 100 * cast(longer as decimal(20,0)) < {ratio} * cast(a as decimal(20,0))")

    spelled = kept.select("high", "low", "a", "best", F.posexplode(F.array(*ids)).alias("at", "id")).where("id > 0").join(words, "id")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ")
    spelled = spelled.groupBy("high", "low", "a", "best").agg(F.min("lang").alias("lang"), line.alias("phrase"))
    rows = spelled.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs.sparkSession))))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(f"place <= {top}")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(f"rank <= {top}")
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
