"""Encoding, decoding, counting and packing against the libraries themselves."""

import base64
import functools
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parallaxis.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip, coder
from parallaxis.llm.packing import WordIds, configurations, pack, plan_packing
from parallaxis.llm.token_counts import count_tokens, counter

RANKS, JSON, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def once():
    replay = coder(RANKS, P.PATTERN)
    return replay, counter(JSON), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=replay.ranks, special_tokens={})


@given(st.text(alphabet="ab 'sterlmvd\n\t\x1c\x85éß中0 .!?  ", max_size=60))
@settings(max_examples=300, deadline=None)
def test_merge_replay_and_prefix_counts_are_the_librarys(text):
    replay, counts, own = once()
    ids = own.encode_ordinary(text)
    assert replay.encode([text])[0] == np.array(ids, "<u4").tobytes()
    assert counts.count(text) == len(ids)


def test_every_prefix_of_a_word_has_its_exact_count(library):
    c = counter(JSON)
    for word in (" unbelievable", "antidisestablishmentarianism", " Straßenbahn", "aaaaaaaaaaa", "don", "''''", " 1234567890"):
        raw = word.encode()
        table = list(c.table(word))
        for end in range(len(raw) + 1):
            assert table[end] == len(library._encode_single_piece(raw[:end])) if end else table[0] == 0


@given(st.text(alphabet="ab 'srelv\n\t!é中0 ", max_size=24) | st.lists(st.sampled_from(["it're", " we've", "'ll", "  ", "\n\n", " x", "<|endoftext|>", "!", "don't", "über", "中文", "1234", " "]), max_size=8).map("".join))
@settings(max_examples=300, deadline=None)
def test_every_prefix_and_budget_of_a_text(text):
    c, tok = counter(JSON), Tokenizer.from_file(JSON) if not hasattr(test_every_prefix_and_budget_of_a_text, "tok") else test_every_prefix_and_budget_of_a_text.tok
    test_every_prefix_and_budget_of_a_text.tok = tok
    want = [len(tok.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
    assert [c.count_prefix(text, n) for n in range(len(text) + 1)] == want
    for budget in range(want[-1] + 2):
        fit = c.fit(text, budget)
        assert want[fit] <= budget and (fit == len(text) or want[fit + 1] > budget or max(want[fit:]) > budget)


def test_budget_of_texts_without_blanks(documents):
    tok = Tokenizer.from_file(JSON)
    texts = ["漢字" * 3000, "x1y2" * 4000, "ab" * 9000, " " * 9000 + "x", "<|endoftext|>" * 600]
    got = {r.doc_id: r for r in count_tokens(documents(list(enumerate(texts))), JSON, 512).collect()}
    for k, t in enumerate(texts):
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert got[k].n_tokens == n
        fit = got[k].fit_chars
        if n > 512:
            assert 500 <= len(tok.encode(t[:fit], add_special_tokens=False).ids) <= 512
        else:
            assert fit == len(t)


def test_budget_questions():
    c, text = counter(JSON), "The quick brown fox jumps over the lazy dog again and again"
    for budget in range(16):
        fit = c.fit(text, budget)
        assert c.count_prefix(text, fit) <= budget
    assert c.fit(text, 10_000) == len(text)


def test_round_trip(spark, documents, odd_rows, library):
    docs = documents(odd_rows, clash=("ids", "n_tokens"))
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_round_trip(docs, RANKS, P.PATTERN).collect())
    want = []
    for i, t in odd_rows:
        ids = library.encode_ordinary(t or "")
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    back = {r.doc_id: bytes(r.raw).decode() for r in bpe_decode(bpe_encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()}
    assert back == {i: t or "" for i, t in odd_rows}
    assert bpe_round_trip(documents([]), RANKS, P.PATTERN).count() == 0


def test_counts(spark, documents, odd_rows):
    tok = Tokenizer.from_file(JSON)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(documents(odd_rows, clash=("n_bytes",)), JSON, 512).collect())
    want = []
    for i, t in odd_rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i or -1, len((t or "").encode()), n, n > 512))
    assert got == sorted(want)
    assert count_tokens(documents([]), JSON).count() == 0


#: Letters that normalisation takes apart or puts together, marks, contractions, case, other scripts and special tokens.
ODD_PARTS = (
    ["İ", "ı", "ß", "ẞ", "Σ", "ς", "ड़", "क", "়", "\u0301", "\u0308", "A\u030a", "\u212b", "ǅ", "ŉ", "ſ", "ﬁ", "가", "\u1100\u1161", "漢字", "👍🏽", "ª", "½", "٣", "ế"]
    + ["'", "'s", "'ll", "'S", "don't", "I'VE", "<|endoftext|>", "<|", "|>", " ", "\n", "\t", "\x1c", "\x85", "\u2028", "\x00"]
    + [chr(i) for i in range(0x21, 0x180)] + [chr(i) for i in range(0x400, 0x460)]
)


@functools.cache
def word_ids_once():
    return WordIds(WORDS), Tokenizer.from_file(WORDS)


def test_word_ids_are_the_librarys():
    own, tok = word_ids_once()
    rng = random.Random(11)
    texts = ["".join(rng.choices(ODD_PARTS, k=rng.randint(0, 14))) for _ in range(20000)] + ["aİ.", "ड़,", "x" * 5000, "é," * 3000, "漢" * 2000]
    for at in range(0, len(texts), 4096):
        some = texts[at : at + 4096]
        for t, ids, e in zip(some, own.encode(some), tok.encode_batch(some, add_special_tokens=False), strict=True):
            assert ids == np.array(e.ids, "<u4").tobytes(), repr(t)


@given(st.text(max_size=40) | st.lists(st.sampled_from(ODD_PARTS), max_size=20).map("".join))
@settings(max_examples=500, deadline=None)
def test_word_ids_of_any_text(text):
    own, tok = word_ids_once()
    assert own.encode([text])[0] == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def check_packing(rows, packed, capacity, separator=1):
    tok = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, separator]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4").tobytes()
            want[i, k, at, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing(spark, documents, odd_rows):
    rng = random.Random(3)
    rows = odd_rows + [(100 + k, " ".join(rng.choices("alpha beta gamma delta of the".split(), k=rng.choice([3, 9, 25, 40, 60, 61])))) for k in range(300)]
    packed = pack(documents(rows, clash=("length", "offset", "piece")), WORDS, capacity=128).collect()
    n = check_packing(rows, packed, 128)
    total = sum(r.length for r in packed)
    assert n <= 1.05 * -(-total // 128) + 2
    assert pack(documents([]), WORDS, 128).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
@settings(max_examples=200, deadline=None)
def test_plans_place_everything_once(counts):
    plan = plan_packing(counts, 64, tries=((4, 8), (8, 4)))
    used, ranks = defaultdict(list), Counter()
    for length, first, end, sequence, each, offset in plan.rows:
        for r in range(first, end):
            used[sequence + (r - first) // each].append((offset + (r - first) % each * length, length))
        ranks[length] += end - first
    assert ranks == Counter(counts)
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert len(used) == plan.sequences


def test_configurations_meet_the_linear_bound():
    sizes, demand = np.array([60, 45, 30]), np.array([40, 40, 80])
    found = configurations(sizes, demand, 100)
    assert sum(n for _, n in found) <= -(-int(sizes @ demand) // 100) + 10
    assert all(config @ sizes <= 100 for config, _ in found)


def test_merge_replay_with_another_pattern():
    pattern = r"\p{L}+\s\p{L}+|.|\n"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    from parallaxis.llm.bpe import MergeReplay

    replay = MergeReplay(ranks, pattern)
    texts = ["new york new york", "a b c d", "", "x\ny z", "of the of the 12"]
    assert replay.encode(texts) == [np.array(own.encode_ordinary(t), "<u4").tobytes() for t in texts]
