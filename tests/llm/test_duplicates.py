"""MinHash and embedding near-duplicates, fingerprints and components, against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.llm import embeddings
from parallaxis.llm.components import components, merged_components, star_components
from parallaxis.llm.embeddings import embedding_duplicates
from parallaxis.llm.fingerprints import Fingerprint, compare_with_next, fingerprint
from parallaxis.llm.minhash import near_duplicates
from parallaxis.llm.shingles import shingle_sets


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingled(text, k):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, percent):
    sets = [(i, shingled(t, k)) for i, t in rows]
    g = Groups()
    for n, (i, a) in enumerate(sets):
        g.find(i)
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                g.join(i, j)
    return {i: (len(s), g.find(i)) for i, s in sets}


def copies(seed, texts=60, near=4):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(texts):
        words = rng.choices(vocabulary, k=rng.choice([2, 5, 40, 120, 300]))
        for _ in range(rng.choice([1, 1, near])):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((n, " ".join(own)))
            n += 1
    return rows


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_are_those_of_brute_force(documents, words):
    rows = copies(words)
    want = brute(rows, words, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(rows), words=words).collect()}
    assert got == want


def test_near_duplicates_of_odd_rows(documents, odd_rows):
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id or -1, r.kept) for r in near_duplicates(documents(odd_rows, clash=("kept", "component_id", "n_shingles")), words=4).collect())
    by = {g[0]: g for g in got}
    assert len(got) == len(odd_rows)
    assert by[2] == (2, 0, 2, True) and by[3] == (3, 0, 3, True) and by[4] == (4, 0, 4, True)
    assert [g for g in got if g[0] == 6] == [(6, 6, 1, False)] * 2
    assert by[7][1] == 1 and by[-1][3] is False
    assert near_duplicates(documents([])).count() == 0


def test_a_crowd_of_near_copies_is_one_component(documents):
    rng = random.Random(5)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for n in range(600):
        own = list(words)
        own[n % 200] = f"x{n}"
        rows.append((n, " ".join(own)))
    assert {r.component_id for r in near_duplicates(documents(rows), words=4).collect()} == {0}


def test_partners_in_a_crowd_below_the_limit_are_found(documents, monkeypatch):
    from parallaxis.llm import minhash

    monkeypatch.setattr(minhash, "TILE", 64)  # runs of several tiles and cells
    monkeypatch.setattr(minhash, "CELL", 40)
    rng = random.Random(8)
    rows = []
    for family in range(2):
        shared = [f"f{family}w{k}" for k in range(300)]
        own = [[f"f{family}m{m}w{k}" for k in range(rng.randrange(42, 48))] for m in range(320)]
        for m in range(40):  # at 0.82 with one that stands far off; all others are at 0.75 to 0.79
            own[m][:13] = own[m + 200][:13]
        rows += [(1000 * family + m, " ".join(shared + w)) for m, w in enumerate(own)]
    want = brute(rows, 4, 80)
    assert len({c for _, c in want.values()}) == 560
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(rows), words=4).collect()}
    assert got == want


def test_shingles_fold_ascii_only():
    a, b, c = shingle_sets(["A b C d", "a B c D", "É b c d"], 4)
    assert (a == b).all() and not (a == c).all()


def test_components(spark):
    rng = random.Random(1)
    pairs = [(n, n + 1) for n in range(300)] + [(1000, k) for k in range(1001, 1200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(200)]
    g = Groups()
    for a, b in pairs:
        g.join(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: g.find(i) for a, b in pairs if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    some, more = spark.createDataFrame(pairs[:350], "a long, b long"), spark.createDataFrame(pairs[350:] + [(299, 1000), (5000, 5001)], "a long, b long")
    g.join(299, 1000)
    g.join(5000, 5001)
    got = {r.id: r.component for r in merged_components(components(some), more).collect()}
    assert got == {i: g.find(i) for a, b in [*pairs, (299, 1000), (5000, 5001)] if a != b for i in (a, b)}
    stars = {(a, b) for a in range(600) for b in rng.sample([x for x in range(0, 600, 7) if x % 3 == a % 3], 2) if b < a}
    g = Groups()
    for a, b in stars:
        g.join(a, b)
    got = {r.id: r.component for r in star_components(spark.createDataFrame(sorted(stars), "a long, b long")).collect()}
    assert got == {i: g.find(i) for p in stars for i in p}
    assert star_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(40):
            v = rng.standard_normal(16)
            for _ in range(int(rng.choice([1, 1, 3, 8]))):
                rows.append((n, (v + 0.03 * rng.standard_normal(16)).tolist(), label))
                n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 2, [0.0] * 16, 0), (n + 3, None, 0), (n + 4, [float("nan")] * 16, 0), (n + 5, [1.0, None] * 8, 0), (n + 6, [3 * x for x in rows[0][1]], 0), (n + 7, rows[0][1], 1)]
    return rows


def brute_links(rows):
    """Number of links and component of each row position, by comparing all."""
    fine = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    g, links = Groups(), defaultdict(int)
    for key in {(rows[k][2], len(rows[k][1])) for k in fine}:
        at = [k for k in fine if (rows[k][2], len(rows[k][1])) == key]
        x = np.array([rows[k][1] for k in at], float)
        x /= np.abs(x).max(axis=1)[:, None]
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1)), strict=True):
            g.join(rows[at[i]][0], rows[at[j]][0])
            links[at[i]] += 1
            links[at[j]] += 1
    return links, g


def check_links(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("component_id", "n_links", "id", "key", "vector", "dim", "recall"):
        df = df.withColumn(name, F.lit("clash"))
    links, g = brute_links(rows)
    got = embedding_duplicates(df).collect()
    want = [(i, links[k], g.find(i), g.find(i) == i) for k, (i, _, _) in enumerate(rows)]
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted(want)
    assert all(r.recall >= 0.995 for r in got)


def test_embedding_links_are_those_of_brute_force(spark):
    rows = vectors(2) + [(9000, [1.0] * 8, 0), (9001, [1.0] * 8, 0), (9002, [1.0] * 16, 0), (9003, [1e300] * 8, 0), (9004, [1e-300] * 8, 0)]
    check_links(spark, rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert embedding_duplicates(df.where("false")).count() == 0


def test_null_and_repeated_vector_ids(spark):
    v, far = [1.0, 0.0, 0.0, 0.2], [0.0, 1.0, 0.3, 0.0]
    rows = [(1, v, 0), (1, v, 0), (1, far, 0), (2, v, 0), (None, v, 0), (None, far, 0)]
    got = embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 0, 0), (1, 0, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_one_label_of_thousands_with_groups_beyond_runs_and_tiles(spark, monkeypatch):
    """Tight groups joined just above the limit, a large group that is no clique, a chain, and strangers."""
    monkeypatch.setattr(embeddings, "TILE", 160)
    rng, d = np.random.default_rng(4), 24

    def near(v, cosine):
        w = rng.standard_normal(d)
        w -= w @ v * v
        return cosine * v + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)

    def start():
        v = rng.standard_normal(d)
        return v / np.linalg.norm(v)

    x = [start() for _ in range(1500)]
    for _ in range(6):  # two groups each: every link between them is further than all links inside
        a = start()
        b = near(a, 0.985)
        x += [near(c, 0.9999) for c in (a, b) for _ in range(40)]
    centre = start()
    x += [near(centre, c) for c in rng.uniform(0.988, 0.999, 900)]
    for _ in range(3):
        v = start()
        for _ in range(150):  # each is a link of the one before only
            v = near(v, 0.985)
            x.append(v)
    order = rng.permutation(len(x))
    check_links(spark, [(int(i), x[k].tolist(), 5) for i, k in enumerate(order)])


def test_fingerprints_are_sums():
    a, b, c = Fingerprint.of("one two\nthree four five"), Fingerprint.of("one two"), Fingerprint.of("three four five")
    assert a == b + c and a - b == c and a == Fingerprint.of("three four five\none two")
    assert not a == Fingerprint.of("one two\nthree four fiv") and Fingerprint.parse(str(a)) == a
    assert a.likeness(a) == 1.0 and Fingerprint.of("").likeness(Fingerprint.of("x y")) == 0.0


def test_likeness_reads_words_to_their_end_and_text_without_blanks():
    rng = random.Random(2)
    han = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(20000)) for _ in range(2)]
    half = han[0][:10000] + han[1][:10000]
    a, b, c = (Fingerprint.of(t) for t in (han[0], half, han[1]))
    assert 0.3 < a.likeness(b) < 0.7 and a.likeness(c) < 0.3
    long = [f"commonbeginning{rng.randrange(10**8)}" for _ in range(400)]
    other = [f"commonbeginning{rng.randrange(10**8)}" for _ in range(400)]
    x, y, z = (Fingerprint.of(" ".join(w)) for w in (long, other, long[:200] + other[:200]))
    assert x.likeness(z) > x.likeness(y) + 0.1
    assert Fingerprint.of("same line\n" * 40000).likeness(Fingerprint.of("same line\n" * 39999)) > 0.99
    assert Fingerprint.of("a b\nc d") == Fingerprint.of("a b") + Fingerprint.of("c d")


def test_edited_texts(documents, odd_rows):
    import hashlib

    rows = [(i, t or "") for i, t in odd_rows]
    named = sorted((i, t) for i, t in rows if i is not None)
    want = []
    for k, (i, t) in enumerate(named):
        after, half = named[(k + 1) % len(named)][1], len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    got = compare_with_next(documents(odd_rows, clash=("fingerprint", "run", "head"))).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got if r.doc_id is not None) == sorted(want)
    assert len(got) == len(rows)
    same = [r.fingerprint for r in got if r.doc_id in (1, 6)]
    assert len(set(same)) == 1
    assert all(0 <= r.near_edited <= 1 for r in got)
    assert {r.fingerprint for r in fingerprint(documents(odd_rows)).collect()} == {r.fingerprint for r in got}
    assert compare_with_next(documents([])).count() == 0


def test_halves_are_likelier_than_strangers(spark, sf):
    got = compare_with_next(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    long = [r for r in got if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


def thue_morse(n: int, a: str = "a", b: str = "b") -> str:
    """A word of 2**n letters whose polynomial hashes modulo powers of two meet those of its complement."""
    out = a
    for _ in range(n):
        out += out.translate(str.maketrans(a + b, b + a))
    return out


def test_structured_words_are_told_apart(documents):
    import zlib

    from parallaxis.llm.language_model import score_documents
    from parallaxis.llm.minhash import near_duplicates
    from parallaxis.llm.shingles import word_hashes

    for n in (2, 3, 4, 10, 11):
        one, other = thue_morse(n), thue_morse(n, "b", "a")
        words, ends = word_hashes([one, other, one.upper(), f"{one} {other}"])
        assert words[0] == words[2] == words[3] != words[1] == words[4] and ends.tolist() == [1, 2, 3, 5]
    odd = ["a", "a\x00", "a\x00\x00", "\x00a", "b" * 8, "b" * 9, "b" * 16, "b" * 17, "b" * 16 + "\x00"]
    assert len(set(word_hashes([" ".join(odd)])[0].tolist())) == len(odd)
    one, other = thue_morse(11), thue_morse(11, "b", "a")
    got = {r.doc_id: r.component_id for r in near_duplicates(documents([(1, one), (2, other), (3, one)])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    learned, held = next(i for i in range(100) if fold(i) != 2), next(i for i in range(100) if fold(i) == 2)
    scored = {r.doc_id: (r.n_tokens, r.n_known) for r in score_documents(documents([(learned, one), (held, other)])).collect()}
    assert scored == {learned: (2, 2), held: (2, 1)}  # of the held-out text only the end is known


def test_recall_is_of_links_between_classes(spark, monkeypatch):
    """Copies are no evidence of a search, and without links there is no recall."""
    from parallaxis.llm import embeddings as E

    rng = np.random.default_rng(9)
    far = rng.standard_normal((40, 16))
    table = lambda rows: spark.createDataFrame([(k, "x", [float(v) for v in r]) for k, r in enumerate(rows)], "vec_id long, label string, embedding array<double>")
    copies = E.embedding_duplicates(table([*far, *far])).collect()
    assert {r.recall for r in copies} == {None} and all(r.n_links == 1 and r.component_id == r.vec_id % 40 for r in copies)
    near = E.embedding_duplicates(table([*far, *(far[:5] + 0.001)])).collect()
    assert {r.recall for r in near} == {1.0} and sum(r.n_links for r in near) == 10
    # what is not counted shows, however many copies there are
    classes = spark.createDataFrame([(k, "x", bytearray(np.asarray(v, np.float64).tobytes()), 16, 1000) for k, v in enumerate([*far[:5], *(far[:5] + 0.001)])], "id long, label string, vector binary, dim int, copies long")
    nothing = spark.createDataFrame([], "id long, n long")
    assert E.audit(classes, nothing, 0.98) == 0.0
    half = spark.createDataFrame([(k, 1999) for k in range(5)], "id long, n long")
    assert E.audit(classes, half, 0.98) == 0.5


def test_what_a_worker_holds_for_another_operator_is_dropped():
    import numpy as np
    import pyarrow as pa

    from parallaxis.llm import cluster, minhash

    class Rows:
        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b c d e"])], names=["doc_id", "text"])
            return list(run([batch]))

    cluster.held("words of another operator", lambda: np.zeros(9))
    minhash.signature_rows(Rows(), 4)
    assert not cluster._held
