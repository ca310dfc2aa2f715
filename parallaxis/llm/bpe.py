"""Byte-level BPE by corpus-level merge replay: encoding to ids and decoding back.

The distinct words of a block of documents are laid out once in flat arrays; an inverted
index maps each adjacent token pair to the positions where it stands.  Merges are applied
in rank order over the whole block: the pair of the lowest rank is taken from a heap, all
of its positions are merged, and only the touched neighbours enter the index anew.  A word
is therefore replayed once for the block however often it occurs, and the results are kept
for the next blocks of the same Python worker (bounded, see ``KEEP``).

The block, not the whole table, is the unit of the replay: a table of all distinct words
would have to be joined back to every document, which moves more data than the replay
costs.  Blocks are independent, so a lost executor only repeats its own blocks.

Nulls and empty texts have no ids.  ``doc_id`` may be null or repeated: each row is encoded
by itself.  Columns other than the two named are not read.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import re
import regex
from pyspark.sql import DataFrame, SparkSession

from parallaxis.llm.cluster import batch_of, held, slices, texts_of

#: Chunks and words kept by a Python worker before it forgets them and starts again.
KEEP = 800_000
#: The rank of neighbours that do not join.
NEVER = np.int64(1 << 40)
#: Longer chunks are encoded but not kept.
KEEP_LENGTH = 64

#: A run of white space with the run of other characters behind it.  No word of the
#: pattern crosses the end of such a chunk: the next begins with white space after a
#: character that is none, where every alternative ends and none looks ahead.
CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: The pattern of which that holds (fixed by the tokenizer's family).  Texts of another pattern are one chunk each.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes words by replaying the merges of a rank table over many words at once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.words_of = regex.compile(pattern).findall
        self.chunks_of = CHUNK.findall if pattern == WORDS else lambda text: [text] if text else []
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        keys, ids = [], []
        early = set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ids.append(rank)
                    early.update(t for t in (left, right) if t > rank)
        order = np.argsort(keys)
        #: The pairs that join, sorted, and the rank of the token each makes.
        self.pairs, self.joins = np.array(keys, np.int64)[order], np.array(ids, np.int64)[order]
        #: Tokens that join into one of a lower rank: these must be merged one place at a time.
        self.early = early
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank at which neighbours join; NEVER where they do not."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.joins[at], NEVER)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word; all words together form the corpus that the merges run over."""
        if not words:
            return []
        flat = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        ids = self.byte_id[flat]
        ids[ends] = -1  # no pair crosses a word's end
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1] = n - 1
        rank = np.full(n, NEVER)
        rank[:-1] = self.rank_of(ids[:-1], ids[1:])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places):
            """Put places into the index under the rank at which they now join."""
            r = rank[places]
            places, r = places[r < NEVER], r[r < NEVER]
            if len(r) > 1:
                order = np.argsort(r, kind="stable")
                places, r = places[order], r[order]
                cuts = (np.flatnonzero(r[1:] != r[:-1]) + 1).tolist()
            else:
                cuts = []
            for start, end in zip([0, *cuts], [*cuts, len(r)], strict=True):
                if start < end:
                    key = int(r[start])
                    if key in index:
                        index[key].append(places[start:end])
                    else:
                        index[key] = [places[start:end]]
                        heappush(heap, key)

        enter(np.arange(n))
        while heap:
            new = heappop(heap)
            found = index.pop(new)
            places = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            places = places[rank[places] == new]  # others were merged away meanwhile
            if not len(places):
                continue
            if len(places) > 1:
                places = np.unique(places)
                touch = after[places[:-1]] == places[1:]
                if touch.any():  # of places that overlap, as in a run of one byte, every second counts
                    first = np.concatenate([[True], ~touch])
                    run_start = np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
                    places = places[(np.arange(len(places)) - run_start) % 2 == 0]
                if new in self.early:
                    word = np.searchsorted(ends, places)
                    one = np.concatenate([[True], word[1:] != word[:-1]])
                    if not one.all():
                        index[new] = [places[~one]]
                        heappush(heap, new)
                        places = places[one]
            gone = after[places]
            right = after[gone]
            ids[places] = new
            ids[gone] = -2
            rank[gone] = NEVER
            after[places] = right
            before[right] = places
            rank[places] = self.rank_of(ids[places], ids[right])
            left = before[places]
            left = left[left >= 0]
            left = left[ids[left] >= 0]
            rank[left] = self.rank_of(ids[left], ids[after[left]])
            enter(np.concatenate([places, left]))
        rest = ids >= 0
        upto = np.concatenate([[0], np.cumsum(rest)])
        packed, starts = ids[rest].astype("<u4").tobytes(), np.concatenate([[0], ends[:-1] + 1])
        return [packed[4 * a : 4 * b] for a, b in zip(upto[starts].tolist(), upto[ends].tolist(), strict=True)]

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Packed ids of chunks that are not kept yet; their new words go through one replay."""
        parts = {c: self.words_of(c) for c in chunks}
        words, ranks = self.words, self.ranks
        new: dict[str, bytes] = {}
        hard = []
        for ws in parts.values():
            for w in ws:
                if w not in words and w not in new:
                    whole = ranks.get(raw := w.encode())
                    new[w] = b"" if whole is None else whole.to_bytes(4, "little")
                    if whole is None:
                        hard.append((w, raw))
        new.update(zip([w for w, _ in hard], self.replay([raw for _, raw in hard]), strict=True))
        words.update(new)
        return {c: words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws]) for c, ws in parts.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        kept = self.chunks
        if len(kept) > KEEP or len(self.words) > KEEP:
            kept.clear()
            self.words.clear()
        missing = set()
        for text in texts:
            missing.update(self.chunks_of(text))
        missing = missing.difference(kept)
        kept.update(self.learn(missing))
        get = kept.__getitem__
        out = [b"".join(map(get, self.chunks_of(text))) for text in texts]
        for c in missing:
            if len(c) > KEEP_LENGTH:
                del kept[c]
        for w in [w for w in self.words if len(w) > KEEP_LENGTH] if any(len(c) > KEEP_LENGTH for c in missing) else ():
            del self.words[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(path: str, pattern: str) -> MergeReplay:
    """The coder of a rank file, as this Python worker holds it."""
    return held((MergeReplay, path, pattern), lambda: MergeReplay(read_ranks(path), pattern))


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 4096, block_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, ids`` with ``ids`` packed as little-endian unsigned 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        c = coder(ranks_path, pattern)
        for b in slices(batches, block_rows, block_bytes):
            yield batch_of(schema, b.column(0), c.encode([t or "" for t in b.column(1).to_pylist()]))

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def bpe_decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, raw`` from ``doc_id, ids``: the bytes that the ids stand for (null ids: none)."""
    schema = pa.schema([("doc_id", pa.int64()), ("raw", pa.binary())])

    def run(batches):
        c = coder(ranks_path, pattern)
        for b in slices(batches):
            yield batch_of(schema, b.column(0), [c.decode(x or b"") for x in b.column(1).to_pylist()])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 4096, block_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, then decode those ids, in one pass."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        c, sha = coder(ranks_path, pattern), hashlib.sha256
        for b in slices(batches, block_rows, block_bytes):
            ids = c.encode([t or "" for t in b.column(1).to_pylist()])
            yield batch_of(schema, b.column(0), [len(x) // 4 for x in ids], [sha(x).hexdigest() for x in ids], [sha(c.decode(x)).hexdigest() for x in ids])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
