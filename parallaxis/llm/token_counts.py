"""Exact token counts by prefix dynamic programming.

For a word, ``counts[i]`` is the number of tokens of its first ``i`` bytes and ``last[i]``
the token that ends there.  A token may end at ``i`` exactly if it may follow the last
token of the prefix in front of it, so each position is decided from earlier positions
alone and no prefix is ever encoded.  A text's table joins those of its words: the count at
any byte is the count before the word plus the word's own entry, and the same table answers
how much of the text fits into a budget.

Words repeat, so a worker keeps the tables of words it has seen (bounded by ``KEEP``).  A
text without blanks is one long word with one table, so very long texts take time in
proportion to their length.  Null texts count as empty.  Ids may be null or repeated; each row
is counted by itself.  An empty table has an empty result; only the id and the text are read, so
no other column can clash.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from parallaxis.llm.bpe import CHUNK, KEEP, KEEP_LENGTH, WORDS
from parallaxis.llm.cluster import batch_of, held, slices, texts_of

CONTRACTIONS = {"'re", "'ve", "'ll"}
SPACE = regex.compile(r"\s+").fullmatch


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounts:
    """Prefix tables of a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = skip = {t["content"] for t in spec["added_tokens"]}
        self.id_of = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in skip}
        self.bytes_of = {i: s for s, i in self.id_of.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: The pair of ids -> place in the order of merges; a token -> that place and its two halves.
        self.order: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for k, (a, b) in enumerate(pairs):
            left, right, both = self.id_of[raw(a)], self.id_of[raw(b)], self.id_of[raw(a) + raw(b)]
            self.order[left << 32 | right] = k
            self.halves.setdefault(both, (k, left, right))
        self.longest = max(map(len, self.id_of))
        self.follows: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.tables: dict[str, bytes | list[int]] = {}
        self.sums: dict[str, int] = {}
        self.long: tuple[str, list[int]] = "", [0]  # the latest word that is too long to be kept
        self.words_of = regex.compile(WORDS).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def may_follow(self, left: int, right: int) -> bool:
        """Whether these two tokens, met side by side in bytes, are what merging leaves.

        Undoes the later of the two tokens' last merges, again and again: at each step the
        tokens at the seam stood beside each other until that merge took one of them away,
        so a merge across the seam of an earlier place would have come first.  At equal
        places the one further left comes first.
        """
        key = left << 32 | right
        found = self.follows.get(key)
        if found is not None:
            return found
        order, halves, until, found = self.order, self.halves, 1 << 40, True
        while True:
            across = order.get(left << 32 | right)
            if across is not None and across < until:
                found = False
                break
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                break
            if b is None or (a is not None and a[0] > b[0]):
                until, left = a[0], a[2]
            else:
                until, right = b[0] + 1, b[1]
        if len(self.follows) > KEEP:
            self.follows.clear()
        self.follows[key] = found
        return found

    def stands_alone(self, token: int) -> bool:
        """Whether merging its bytes makes the token: its halves do, and may stand side by side just before."""
        found = self.alone.get(token)
        if found is None:
            raw, ids = self.bytes_of[token], []
            ids = [self.id_of[raw[k : k + 1]] for k in range(len(raw))]
            while len(ids) > 1:
                best = min(((self.order[p], k) for k, p in enumerate([x << 32 | y for x, y in zip(ids, ids[1:], strict=False)]) if p in self.order), default=None)
                if best is None:
                    break
                k = best[1]
                ids[k : k + 2] = [self.id_of[self.bytes_of[ids[k]] + self.bytes_of[ids[k + 1]]]]
            found = self.alone[token] = ids == [token]
        return found

    def table(self, word: str) -> bytes | list[int]:
        """Token counts of the first 0, 1, ... bytes of one word."""
        kept = self.tables.get(word)
        if kept is not None:
            return kept
        if self.long[0] == word:
            return self.long[1]
        raw = word.encode()
        counts, last = [0], [-1]
        get = self.id_of.get
        for end in range(1, len(raw) + 1):
            for start in range(max(0, end - self.longest), end):
                token = get(raw[start:end])
                if token is not None and (self.may_follow(last[start], token) if start else self.stands_alone(token)):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
        if len(word) <= KEEP_LENGTH // 2:
            if len(self.tables) > KEEP:
                self.tables.clear()
            counts = self.tables[word] = bytes(counts)
        else:
            self.long = word, counts
        return counts

    def count_chunk(self, chunk: str) -> int:
        n = sum([self.table(w)[-1] for w in self.words_of(chunk)])
        if len(chunk) <= KEEP_LENGTH:
            if len(self.sums) > KEEP:
                self.sums.clear()
            self.sums[chunk] = n
        return n

    def chunks(self, text: str) -> tuple[list[str], list[int]]:
        """A text's chunks and their token counts; special strings are chunks of one token."""
        parts = self.split_special(text) if self.split_special and any(s in text for s in self.special) else [text]
        names, counts, get = [], [], self.sums.get
        for k, part in enumerate(parts):
            if k % 2:
                names.append(part)
                counts.append(1)
                continue
            found = CHUNK.findall(part)
            got = list(map(get, found))
            if None in got:
                got = [self.count_chunk(c) if n is None else n for c, n in zip(found, got, strict=True)]
            names += found
            counts += got
        return names, counts

    def count(self, text: str) -> int:
        return sum(self.chunks(text)[1])

    def word_prefix(self, before: str, word: str, n_chars: int, n_bytes: int) -> int:
        """Tokens that the first characters of a word add to what stands before it in its chunk.

        They are in the word's table, but for two splits that look ahead: of white space the
        last character goes to what follows, so at the text's end it joins the run before it;
        and a contraction is a mark and letters until it is complete.
        """
        if n_chars == len(word):
            return self.table(word)[-1]
        if n_chars == 1 and before and SPACE(before) and SPACE(word[0]):
            return self.table(before + word[0])[-1] - self.table(before)[-1]
        if n_chars > 1 and word in CONTRACTIONS:
            return self.table("'")[-1] + self.table(word[1:n_chars])[-1]
        return self.table(word)[n_bytes]

    def chunk_prefix(self, chunk: str, n_chars: int) -> int:
        """Tokens of ``chunk[:n_chars]``."""
        total, before = 0, ""
        for word in self.words_of(chunk):
            if n_chars <= len(word):
                # white space that ends here joins the run before it
                return total + (self.word_prefix(before, word, n_chars, len(word[:n_chars].encode())) if not (n_chars == len(word) == 1 and before and SPACE(before) and SPACE(word)) else self.table(before + word)[-1] - self.table(before)[-1])
            total, before, n_chars = total + self.table(word)[-1], word, n_chars - len(word)
        return total

    def chunk_fit(self, chunk: str, budget: int) -> int:
        """Code points of the longest prefix of a chunk within the budget that ends in or before its first word that passes it."""
        chars, before = 0, ""
        for word in self.words_of(chunk):
            n = self.table(word)[-1]
            if n > budget:
                end = len(word.encode())
                for k in range(len(word) - 1, 0, -1):
                    end -= len(word[k].encode())
                    if self.word_prefix(before, word, k, end) <= budget:
                        return chars + k
                return chars
            chars, before, budget = chars + len(word), word, budget - n
        return chars

    def count_prefix(self, text: str, n_chars: int) -> int:
        """Tokens of ``text[:n_chars]``: whole chunks, and the table of the word in which it ends."""
        total, before = 0, ""
        for name, n in zip(*self.chunks(text), strict=True):
            if n_chars < len(name):
                if name in self.special:  # a part of a special string is ordinary text, after what ordinary text there is
                    return total + self.count_chunk(before + name[:n_chars]) - self.count_chunk(before) if n_chars else total
                return total + self.chunk_prefix(name, n_chars) if n_chars else total
            total, before, n_chars = total + n, "" if name in self.special else name, n_chars - len(name)
        return total

    def fit_chunks(self, names: list[str], counts: list[int], budget: int) -> int:
        upto = list(accumulate(counts, initial=0))
        k = bisect_right(upto, budget) - 1
        whole = sum(map(len, names[:k]))
        return whole if k == len(names) or names[k] in self.special else whole + self.chunk_fit(names[k], budget - upto[k])

    def fit(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens that ends in or before the first word that passes it."""
        return self.fit_chunks(*self.chunks(text), budget)


def counter(path: str) -> PrefixCounts:
    return held((PrefixCounts, path), lambda: PrefixCounts(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fit_chars``.

    ``fit_chars``: code points of the longest prefix within ``limit`` tokens that ends in or
    before the first word over the limit (all of the text if it is not over the limit).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64())])

    def run(batches):
        c = counter(path)
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n_tokens, fits = [], []
            for t in texts:
                names, counts = c.chunks(t)
                n = sum(counts)
                n_tokens.append(n)
                fits.append(len(t) if n <= limit else c.fit_chunks(names, counts, limit))
            yield batch_of(schema, b.column(0), [len(t.encode()) for t in texts], n_tokens, [n > limit for n in n_tokens], fits)

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizers.path("byte_bpe_50k.json"))
