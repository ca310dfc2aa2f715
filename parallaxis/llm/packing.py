"""Packing token sequences by a linear grouping scheme.

1. Every text is tokenised once; documents over the capacity are cut into pieces.  What
   remains is a number for a piece: its length.
2. Lengths are counted.  There are at most ``capacity`` different ones, so the histogram's
   size is bounded whatever the corpus, and the plan is made from it alone:
   large lengths, sorted, fall into groups of equal cardinality and are rounded up to their
   group's largest; the few sizes that are left give a linear program over configurations
   (which sizes share a sequence), solved by column generation with a knapsack for pricing;
   whole parts of its solution are taken; actual lengths, from long to short, replace the
   rounded ones; what is left over and the small pieces go, longest first, to the tightest
   gap that holds them.  Equal sequences are handled as runs, so this takes as many steps
   as there are lengths and configurations, not pieces.  A few group counts and limits of
   "large" are tried, and the plan with the fewest sequences is used.
3. Each piece gets its rank among those of its length (:mod:`ranks`), and the plan says for
   each interval of ranks into which sequences and where they go.

Nulls and empty texts have one token, the separator.  Rows with null or repeated ids are
pieces like others; repeated rows have places of their own in the order, so a crowd of them is
split.  Very long texts are read whole and cut.  An empty table has an empty result.  Only the
id and the text are read, so no other column can clash.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.llm.cluster import batch_of, held, materialize, slices, texts_of
from parallaxis.llm.ranks import bucket_count, seeded_key, with_ranks

#: Strings whose ids a Python worker keeps, and code points up to which a string is kept.
KEEP = 300_000
KEEP_LENGTH = 64
#: Strings that a call of the library encodes.
BATCH = 4000

#: Letters of which normalisation changes nothing but case, one for one, as ``str.lower`` does.
LETTERS = "a-zß-öø-įı-ňŊ-žſа-яё"
PLAIN = re.compile(f"[!-~À-ÖØ-ÞŸА-ЯЁ{LETTERS}]+").fullmatch
#: The split in front of merges (fixed by the vocabulary's family), of lower-case strings without white space.
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+").findall
#: Marks that make one part behind a word.
MARKS = ".,;:!?%&#*$"


class WordIds:
    """Packed ids of texts by a tokenizer that drops white space, with repeated strings kept.

    Nothing in such a vocabulary crosses a space or line break, so a text's ids are those
    of the strings between them.  A string of plain letters, digits and ASCII marks is split
    into parts here, and new parts go through the library's merges many at a time: the last
    token of a part, and no other, ends a word in the vocabulary, so the ids tell where parts
    end.  Any other string (marks that combine, other scripts, special tokens) goes to the
    library as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        merges_only = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        self.parts = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": merges_only}}))
        end = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(1 + max(spec["model"]["vocab"].values()), bool)
        self.ends[[i for token, i in spec["model"]["vocab"].items() if token.endswith(end)]] = True
        self.kept: dict[str, bytes] = {"": b""}

    def learn_parts(self, parts: list[str]) -> None:
        for start in range(0, len(parts), BATCH):
            some = parts[start : start + BATCH]
            ids = np.array(self.parts.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts, raw = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), ids.tobytes()
            self.kept.update(zip(some, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))

    def learn(self, missing: set[str]) -> None:
        """Keep the ids of new strings.  (A part's ids are also those of a string that is just this part.)"""
        kept, words, cores, tails, split, odd, new = self.kept, [], [], [], {}, [], set()
        for word in missing:
            core = word.rstrip(MARKS)
            if core.isalpha() and (core.isascii() or PLAIN(core)):
                low, tail = core.lower(), word[len(core) :]
                words.append(word)
                cores.append(low)
                tails.append(tail)
            elif PLAIN(word) and "<|" not in word:
                parts = split[word] = PARTS(word.lower())
                new.update(parts)
            else:
                odd.append(word)
        new.update(cores, tails)
        self.learn_parts(list(new.difference(kept)))
        for word, core, tail in zip(words, cores, tails, strict=True):
            kept[word] = kept[core] + kept[tail] if tail else kept[core]
        for word, parts in split.items():
            kept[word] = b"".join([kept[p] for p in parts])
        for start in range(0, len(odd), BATCH):
            some = odd[start : start + BATCH]
            for word, e in zip(some, self.whole.encode_batch_fast(some, add_special_tokens=False), strict=True):
                kept[word] = np.array(e.ids, "<u4").tobytes()
        self.long = [w for w in (*missing, *new) if len(w) > KEEP_LENGTH]

    def encode(self, texts: list[str]) -> list[bytes]:
        kept = self.kept
        if len(kept) > KEEP:
            kept.clear()
            kept[""] = b""
        cut = [text.replace("\n", " ").split(" ") for text in texts]
        missing = set()
        for words in cut:
            missing.update(words)
        missing = missing.difference(kept)
        self.learn(missing)
        get = kept.__getitem__
        out = [b"".join(map(get, words)) for words in cut]
        for word in self.long:
            kept.pop(word, None)
        return out


def word_ids(path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
    return held((WordIds, path), lambda: WordIds(path))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, separator: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and the separator, cut at the capacity."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = separator.to_bytes(4, "little")

    def run(batches):
        coder = word_ids(tokenizer_path)
        for b in slices(batches):
            out = []
            for doc_id, ids in zip(b.column(0).to_pylist(), coder.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield batch_of(schema, *(list(c) for c in zip(*out, strict=True)))

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of configurations (copies of each size) near the linear program's optimum.

    Minimises the sequences that cover the demand.  The basis starts with one size in each
    configuration; the knapsack finds the configuration worth most at the current prices,
    which enters while it is worth more than a sequence.
    """
    k = len(sizes)
    rounds = capacity // int(sizes.min())
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(60 * k):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)
        best, came = np.zeros(capacity + 1), []
        for _ in range(rounds):
            offers = np.full((k + 1, capacity + 1), -1.0)
            offers[k] = best
            for i, s in enumerate(sizes):
                offers[i, s:] = best[: capacity + 1 - s] + price[i]
            came.append(offers.argmax(axis=0))
            best = offers.max(axis=0)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for choice in reversed(came):
            i = choice[room]
            if i < k:
                column[i] += 1
                room -= sizes[i]
        x, move = inverse @ demand, inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(move > 1e-9, x / move, np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, demand.astype(float))
    return [(basis[:, j].astype(int), int(x[j] + 1e-6)) for j in np.argsort(-x) if x[j] >= 1]


class Plan:
    """Runs of equal sequences under construction, and what goes where.

    ``rows``: (length, first rank, end rank, first sequence, pieces of it in a sequence, offset).
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.next_rank, self.capacity = dict(counts), defaultdict(int), capacity
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs (first sequence, how many)
        self.has = np.zeros(capacity + 1, bool)
        self.sequences = 0

    def put(self, length: int, n_sequences: int, first: int, each: int, offset: int) -> None:
        rank, n = self.next_rank[length], n_sequences * each
        self.rows.append((length, rank, rank + n, first, each, offset))
        self.next_rank[length] += n
        self.left[length] -= n

    def leave(self, room: int, first: int, n_sequences: int) -> None:
        if room and n_sequences:
            self.gaps[room].append((first, n_sequences))
            self.has[room] = True

    def substitute(self, groups: list[list[int]], config: np.ndarray, times: int) -> None:
        """Build ``times`` sequences of a configuration from the longest pieces each group has left."""
        slots = [g for g, copies in enumerate(config) for _ in range(copies)]
        taken: list[list[tuple[int, int]]] = []  # for each slot, runs (length, how many)
        avail = {g: [[n, self.left[n]] for n in groups[g] if self.left[n] > 0] for g in set(slots)}
        for g in slots:
            need, runs = times, []
            while need and avail[g]:
                length, have = avail[g][0]
                use = min(need, have)
                runs.append((length, use))
                need -= use
                if use == have:
                    avail[g].pop(0)
                else:
                    avail[g][0][1] -= use
            taken.append(runs)
        times = min(sum(n for _, n in runs) for runs in taken)
        if not times:
            return
        at, runs = 0, [list(reversed(r)) for r in taken]
        while at < times:
            step = min([times - at, *(r[-1][1] for r in runs)])
            first, offset = self.sequences, 0
            for r in runs:
                length, n = r.pop()
                self.put(length, step, first, 1, offset)
                offset += length
                if n > step:
                    r.append((length, n - step))
            self.sequences += step
            self.leave(self.capacity - offset, first, step)
            at += step

    def best_fit(self) -> None:
        """Everything that is left, longest first, into the tightest gaps, then into new sequences."""
        for length in sorted((n for n, c in self.left.items() if c > 0), reverse=True):
            while self.left[length] > 0:
                want = self.left[length]
                room = length + int(self.has[length:].argmax()) if self.has[length:].any() else 0
                if room:
                    first, n = self.gaps[room].pop()
                    self.has[room] = bool(self.gaps[room])
                else:
                    room, first = self.capacity, self.sequences
                    each = room // length
                    n = -(-want // each)
                    self.sequences += n
                each, offset = room // length, self.capacity - room
                full = min(n, want // each)
                if full:
                    self.put(length, full, first, each, offset)
                    self.leave(room - each * length, first, full)
                if full < n:
                    rest = self.left[length] if full == want // each else 0
                    if rest:
                        self.put(length, 1, first + full, rest, offset)
                        self.leave(room - rest * length, first + full, 1)
                    self.leave(room, first + full + bool(rest), n - full - bool(rest))


def plan_packing(counts: dict[int, int], capacity: int, tries=((32, 2), (32, 3), (48, 4))) -> Plan:
    """The plan with the fewest sequences among those of ``tries`` (groups, 1 / large's share)."""
    best = None
    for n_groups, share in tries:
        plan = Plan(counts, capacity)
        large = sorted((n for n in counts if capacity // share < n < capacity), reverse=True)
        if large:
            upto = np.cumsum([counts[n] for n in large])
            group_of = np.minimum((upto - 1) * n_groups // upto[-1], n_groups - 1)
            groups = [[n for n, g in zip(large, group_of, strict=True) if g == k] for k in sorted(set(group_of.tolist()))]
            sizes = np.array([g[0] for g in groups])
            demand = np.array([sum(counts[n] for n in g) for g in groups])
            for config, times in configurations(sizes, demand, capacity):
                plan.substitute(groups, config, times)
        plan.best_fit()
        if best is None or plan.sequences < best.sequences:
            best = plan
    return best


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, separator: int = 1, seed: int = 23, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``; see the module."""
    pieces = token_pieces(docs, tokenizer_path, capacity, separator, id_col, text_col)
    pieces = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()).withColumn("_key", seeded_key(seed, "doc_id", "piece", "ids_crc32", "_row")).drop("_row"), "pieces")
    # at most `capacity` rows, whatever the corpus
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = np.array(sorted(plan_packing(counts, capacity).rows), np.int64).reshape(-1, 6)
    shift = 46  # a length and a rank in one number
    keys = (rows[:, 0] << shift) | rows[:, 1]
    ranked = with_ranks(pieces, ["length"], "_key", ["doc_id", "piece", "ids_crc32"], bucket_count(max(1, sum(counts.values()))), "_rank", "_of")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            r = rows[np.searchsorted(keys, (length << shift) | rank, side="right") - 1]
            nth = rank - r[:, 1]
            yield batch_of(schema, *b.columns[:5], r[:, 3] + nth // r[:, 4], r[:, 5] + nth % r[:, 4] * length)

    return ranked.select(*columns, "_rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizers.path("word_bpe_49k.json"))
