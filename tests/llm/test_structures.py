"""The prefix trie, license scans and collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parallaxis.llm import trie
from parallaxis.llm.licenses import PHRASES, TEMPLATES, license_scan, op12_licenses
from parallaxis.llm.trie import op11_prefix_trie, prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            said = (role or "", text or "")
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(said[0])}:{said[0]}{said[1]}".encode()).digest(), said))
    own = {c: [v[-1] for v in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h, group = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(group, [])[:h] + turns[h:]
    members, below = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    for path in members:
        if path:
            below[path[:-1]].append(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[p] for p in below[path]) or 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[p] for p in below[path])
        ends = ",".join(str(c) for c in members[path] if len(built[c]) == len(path))
        above = members[path[:-1]][0] if path else None
        out.append((members[path][0], len(path), above, len(members[path]), len(below[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_trie_of_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(op11_prefix_trie(spark, sf)) == brute_trie(rows)


@pytest.mark.parametrize("fan", [2, 64])
def test_trie_of_odd_conversations(spark, monkeypatch, fan):
    """Nulls, ties, repeated rows, copies across every border, deep and turnless conversations; small pieces and fans."""
    monkeypatch.setattr(trie, "FAN", fan)
    monkeypatch.setattr(trie, "PIECE", 3)
    monkeypatch.setattr(trie, "ROWS", 5)
    pick, rows = random.Random(5), []
    for c in range(-30, 160):
        for t in range(pick.choice([0, 1, 1, 2, 3, 5])):
            rows.append((c, t, pick.choice(["user", "assistant", None]), pick.choice(["a b", "c\td  e", "", None, "f"])))
    for c in range(1000, 1090):  # copies, a third of all
        rows += [(c, 0, "user", "the same"), (c, 1, "assistant", "thing again"), (c, 2, "user", "and on"), (c, 3, "user", "and on")]
    rows += [(2000, t, "user", f"turn {t}") for t in range(300)] + [(2001, t, "user", f"turn {t}") for t in range(300)]
    rows += [(None, 1, "user", "of none"), (7, None, "user", "first"), (7, None, "user", "first"), (7, 2, None, None), (7, 2, "x", "y"), (5000, 1, "user", "w " * 30000)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("clash")).withColumn("words", F.lit("clash"))
    assert trie_rows(prefix_trie(df)) == brute_trie(rows)


def test_trie_without_conversations(spark):
    assert prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], TURNS)).count() == 0
    assert trie_rows(prefix_trie(spark.createDataFrame([(3, 0, "user", "x")], TURNS))) == brute_trie([(3, 0, "user", "x")])


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def brute_blocks(text, templates, percent):
    w, out = words(text), []
    for label, template in templates.items():
        own, size = set(words(template)), len(words(template))
        step = 16
        while step < size:
            step *= 2
        for start in range(0, len(w), step):
            shared = len(own & set(w[start : start + 2 * step]))
            if 100 * shared >= percent * len(own):
                out.append((label, start, min(len(w), start + 2 * step), shared, len(own)))
    return sorted(out)


def brute_base(text):
    w = words(text)
    return sorted((i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())


def license_texts():
    pick, texts = random.Random(3), ["", None, "MIT", "mit license mit LICENSE, cc-by/cc by; gnu general public license apache\x00license", "MİT license ümit license", "gnu general public license " * 400]
    notices = [words(t) for t in TEMPLATES.values()]
    vocabulary = sorted({w for n in notices for w in n}) + ["lorem", "ipsum", "中文", "é"] * 20
    for k in range(150):
        notice = list(pick.choice(notices))
        for _ in range(pick.choice([0, 0, 2, 5, 12, 20, 40])):
            at = pick.randrange(len(notice))
            notice[at : at + 1] = pick.choice([[], ["changed"], [notice[at], "more"]])
        around = lambda: [pick.choice(vocabulary) for _ in range(pick.choice([0, 3, 40, 200]))]  # noqa: B023, E731
        texts.append(pick.choice([" ", "\n", ", "]).join(around() + notice + around()).title())
    return texts


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_license_blocks_are_all_that_meet_the_threshold(documents, percent):
    texts = license_texts()
    got = {r.doc_id: r for r in license_scan(documents(list(enumerate(texts)), clash=("base", "n_words")), percent=percent).collect()}
    assert len(got) == len(texts)
    found = 0
    for k, text in enumerate(texts):
        r = got[k]
        assert r.n_words == len(words(text))
        assert sorted((b.word, b.label) for b in r.base) == brute_base(text)
        want = brute_blocks(text, TEMPLATES, percent)
        assert sorted((b.label, b.first, b.end, b.shared, b.size) for b in r.blocks) == want
        found += len(want)
    assert found > 50


def test_licenses_of_odd_rows(spark, documents, odd_rows):
    assert license_scan(documents([])).count() == 0
    assert license_scan(documents(odd_rows)).count() == len(odd_rows)


def test_license_digest(spark, documents, tmp_path):
    notice = {k: v for k, v in TEMPLATES.items()}
    rows = [(1, notice["mit"]), (2, "Released under the MIT License. And CC BY 4.0, MIT license"), (3, "nothing to see"), (4, notice["lgpl"]), (5, notice["mit"] + "\n\n" + notice["lgpl"]), (6, None), (7, "a " * (3 << 20) + "mit license")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op12_licenses(spark, str(tmp_path)).collect()}
    of = lambda k: (got[k].n_base, got[k].first_word, got[k].last_word, got[k].base_labels, got[k].labels, got[k].score)
    assert of(1) == (0, None, None, "", "mit", 1.0)
    assert of(2) == (3, 3, 10, "cc-by,mit", "cc-by,mit", 1.0)
    assert of(3) == of(6) == (0, None, None, "", "", 0.0)
    assert of(4) == (0, None, None, "", "lgpl", 1.0)  # the general notice meets the threshold too, and is the worse one
    assert of(5)[4] == "lgpl,mit"
    assert (got[7].n_words, *of(7)[:3]) == ((3 << 20) + 2, 1, 3 << 20, 3 << 20)


def brute_collocations(rows, least, top):
    f, n = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        phrases = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        around = defaultdict(int)
        for p, a in phrases.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        around[p[i:j]] = max(around[p[i:j]], a)
        found = []
        for p, a in phrases.items():
            if 100 * around[p] < 80 * a:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def collocation_texts():
    pick, rows = random.Random(11), []
    vocabulary = ["new", "york", "New", "city", "of", "the", "ümlaut", "Ümlaut", "naïve", "a b", "x\x00y", "中文", "rare", "\x1c"]
    for k in range(400):
        size = pick.choice([0, 1, 5, 30])
        text = "".join(pick.choice(vocabulary) + pick.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", "\x0b"]) for _ in range(size))
        rows.append((pick.choice(["en", "en", "en", "de", None, ""]), pick.choice([text, text, "New York City of the", None, f"only{k} once{k}"])))
    rows.append(("en", "the new york city " * 3000 + "end"))
    rows.append(("long", "word" * 5000 + " " + "word" * 5000))
    return rows


@pytest.mark.parametrize("block,piece,reach", [(16 << 20, 1 << 20, 1 << 21), (700, 50, 64)])
def test_collocations(spark, monkeypatch, block, piece, reach):
    from parallaxis.llm import collocations as C

    for name, value in (("BLOCK", block), ("AT_ONCE", piece), ("RANGE", reach)):
        monkeypatch.setattr(C, name, value)
    rows = collocation_texts()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumns({c: F.lit("clash") for c in ("n", "a", "word", "block")})
    for least, top in ((12, 7), (5, 2000)):
        got = sorted(tuple(r) for r in C.collocations(df, least=least, top=top).collect())
        assert got == brute_collocations(rows, least, top)
    assert len(got) > 20 and {r[0] for r in got} >= {"en", "de", "und"}


def test_collocations_of_little(spark, documents, odd_rows):
    from parallaxis.llm.collocations import collocations

    assert collocations(documents([])).count() == 0
    assert collocations(documents([(1, "not enough of it"), (2, None), (3, "")])).count() == 0
    rows = [("en", t) for _, t in odd_rows]
    assert sorted(tuple(r) for r in collocations(documents(odd_rows)).collect()) == brute_collocations(rows, 30, 2000)


def test_collocation_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    from parallaxis.llm import collocations as C

    big = 7 * 10**12 + 1
    grams = spark.createDataFrame([(1 << 32 | 2, 0, big)], "high long, low long, a long")
    words = spark.createDataFrame([(1, "en", "p", big + 5), (2, "en", "q", big + 9)], "id long, lang string, word string, f long")
    monkeypatch.setattr(C, "phrase_counts", lambda *a: (grams, words, spark.createDataFrame([("en", 3 * big)], "lang string, n long")))
    (got,) = C.collocations(spark.range(0)).collect()
    assert tuple(got) == ("en", 1, "p q", big, big + 5, big + 9, 3 * big, 2000000 * big // (2 * big + 14))


def test_radix_order():
    import numpy as np

    from parallaxis.llm.collocations import cuts_at, radix_order, run_lengths

    keys = np.random.default_rng(3).integers(0, 1 << 63, (2, 3000)).astype(np.uint64) >> np.uint64(55)
    order = radix_order(keys)
    assert (keys[:, order] == keys[:, np.lexsort((keys[1], keys[0]))]).all()
    unique, n = run_lengths(keys)
    assert (unique == np.unique(keys, axis=1)).all() and n.sum() == 3000
    bounds = unique[:, ::7]
    assert cuts_at(unique, bounds).tolist() == list(range(0, unique.shape[1], 7))
