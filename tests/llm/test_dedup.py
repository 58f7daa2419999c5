"""Near-duplicate and repeat removal against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.llm import embeddings, jaccard, recompress
from rastermill.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def test_components(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(None, 3)]
    u = Union(range(600))
    for a, b in edges:
        if a is not None:
            u.join(a, b)
    got = {x["node"]: x["component_id"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: u.find(n) for a, b in edges if a is not None and a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (1, 50, 100)])
def test_jaccard(spark, docs, rows, k, num, den):
    sets = {i: shingles(t, k) for i, t, *_ in rows if i is not None}
    u, ids = Union(sets), sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and sets[x] and den * both >= num * len(sets[x] | sets[y]) and both:
                u.join(x, y)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(docs, width=k, numerator=num, denominator=den).collect()]
    assert sorted(g for g in got if g[0] is not None) == sorted((i, len(sets[i]), u.find(i)) for i, *_ in rows if i is not None)
    assert [g[2] for g in got if g[0] is None] == [None]


def test_jaccard_with_a_large_group(spark):
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(150):
        w = list(base)
        w[(7 * i) % 200] = f"n{i}"
        texts.append((i, " ".join(w)))
    texts += [(1000 + i, " ".join(base[:30] + [f"o{i}_{j}" for j in range(100)])) for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(spark.createDataFrame(texts, "doc_id long, text string"), width=4, numerator=85, denominator=100).collect()}
    assert {got[i] for i in range(150)} == {0}
    assert all(got[1000 + i] == 1000 + i for i in range(60))


def test_a_group_of_many_blocks(spark):
    """Chains whose neighbours alone link, in one group that no tree holds: blocks meet until all is joined."""
    texts = []
    for i in range(40):
        texts.append((i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 100))))
    texts += [(1000 + i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 100)) + f" own{i}") for i in range(0, 40, 10)]
    sets = {i: shingles(t, 4) for i, t in texts}
    u = Union(sets)
    for x in sets:
        for y in sets:
            if x < y and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                u.join(x, y)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(spark.createDataFrame(texts, "doc_id long, text string"), width=4, numerator=85, denominator=100, cell=5000).collect()}
    assert got == {i: u.find(i) for i in sets}
    assert len(set(got.values())) < 20


@pytest.mark.parametrize(("num", "den"), [(85, 100), (50, 100), (30, 100)])
def test_trees_lose_nothing(num, den):
    r = np.random.default_rng(num)
    base = r.integers(1, 1 << 63, 6000, dtype=np.uint64)
    sets = []
    for size in (1, 2, 5, 9, 40, 70, 300, 900, 5000):
        for change in (0, 0.02, 0.05, 0.08, 0.1, 0.2, 0.5):
            own = base[:size].copy()
            own[r.random(size) < change] = r.integers(1, 1 << 63, dtype=np.uint64)
            sets += [np.unique(own), np.unique(np.append(own, r.integers(1, 1 << 63, size // 9, dtype=np.uint64)))]
    side = r.integers(0, 2, len(sets))
    for sides in (None, side):
        u, mine = Union(range(len(sets))), Union(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both) and (sides is None or sides[i] != sides[j]):
                    u.join(i, j)
        found = jaccard.links_of(sets, np.arange(len(sets)), sides, num, den)
        assert len(found) < len(sets)
        for i, j in found:
            mine.join(i, j)
        assert [u.find(i) for i in range(len(sets))] == [mine.find(i) for i in range(len(sets))]


def test_words_of_long_texts():
    from rastermill.llm import words

    r = np.random.default_rng(1)
    text = bytes(r.choice(np.frombuffer(b"ab  \n\tAZ\xc3\xa9", np.uint8), 5000)) + b"x" * 700 + b" end"
    want = words.words([text], True)[0]
    assert len(want) == len(text.split())
    for stretch in (1, 7, 64, 333, 5000):
        assert (words.long_text(text, True, stretch) == want).all()
    assert len(words.long_text(b"", True)) == len(words.long_text(b"  ", True)) == 0
    short = [b"a b", b"", b" c", text, b"a"]
    hashes, bounds = words.words(short)
    assert np.diff(bounds).tolist() == [len(t.split()) for t in short]
    assert hashes[0] == hashes[-1]


def test_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    got = jaccard.similar_documents(spark.createDataFrame([(5, a), (5, b), (7, a), (9, b)], "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {5}
    assert len(got) == 4


def test_keep_one(spark, docs):
    kept = jaccard.keep_one(docs.withColumn("place", F.lit(9)).withColumnRenamed("key", "KEY"))
    assert kept.select("place", "KEY").distinct().collect() == [(9, 1)]
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert 44 in ids
    assert not {45, 46, 47} & set(ids)
    assert ids.count(10) == 1
    assert None in ids


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert jaccard.similar_documents(none).count() == 0
    assert recompress.remove_repeats(none).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize(("width", "piece"), [(50, 1 << 17), (5, 1 << 17), (50, 61), (5, 7)])
def test_repeats(spark, docs, rows, width, piece, monkeypatch):
    monkeypatch.setattr(recompress, "PIECE", piece)  # goes along with the functions that the workers get
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    first: dict[tuple, int] = {}
    for i, w in sorted((i, w) for i, w in words.items() if i is not None):
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    want = []
    for i, *_ in rows:
        w, gone = words[i], set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = recompress.remove_repeats(docs, width=width, keep=("lang",))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == sorted(want)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "lang"]
    assert sum(w[2] for w in want) > 0


def test_anchors_depend_on_the_window_alone():
    from rastermill.llm.words import BASE, rolling

    r = np.random.default_rng(5)
    vocabulary = r.integers(1, 1 << 63, 40, dtype=np.uint64)
    passage = vocabulary[r.integers(0, 40, 90)]
    parts = [np.concatenate((vocabulary[r.integers(0, 40, n)], passage, np.full(60, vocabulary[0]), vocabulary[r.integers(0, 40, m)])) for n, m in ((13, 70), (0, 5), (200, 0))]
    names, bounds = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    doc, start, count, key, _ = recompress.segments(names, bounds)
    seen: dict[int, set] = {}
    windows = rolling(names, 50, BASE)
    for d, s, n, k in zip(doc, start, count, key, strict=True):
        for w in range(n):
            seen.setdefault(int(windows[bounds[d] + s + w]), set()).add(int(k))
    assert all(len(v) == 1 for v in seen.values())
    assert int(count.sum()) == sum(max(0, len(p) - 49) for p in parts)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    r = np.random.default_rng(7)
    rows, centre = [], r.standard_normal(24)
    for i in range(60):
        rows.append((i, (centre + 0.12 * r.standard_normal(24)).tolist(), 1))
    rows += [(100 + i, r.standard_normal(24).tolist(), int(i % 3)) for i in range(60)]
    rows += [(200, centre.tolist(), 2), (201, centre.tolist(), None), (202, None, 1), (203, [0.0] * 24, 1), (204, [float("nan")] * 24, 1), (205, [None] * 24, 1), (206, (2 * centre).tolist(), 1), (207, [1.0, 2.0], 1), (None, centre.tolist(), 1), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("t", F.lit(1)).withColumn("n", F.lit(2))
    good = {i: (np.array(v) / np.linalg.norm(v), y) for i, v, y in rows if i is not None and y is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted({i for i, *_ in rows if i is not None})
    u, links = Union(ids), dict.fromkeys(ids, 0)
    for a in ids:
        for b in ids:
            if a < b and a in good and b in good and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= 0.93:
                u.join(a, b)
                links[a] += 1
                links[b] += 1
    got = {x["vec_id"]: tuple(x)[1:] for x in embeddings.near_duplicates(df, recall=0.99999999).collect()}
    assert got.pop(None) == (0, None, False)
    assert got == {i: (links[i], u.find(i), u.find(i) == i) for i in ids}
    assert max(links.values()) > 16


def test_recall_at_production_parameters(spark):
    """Pairs just over the threshold, where sign hashing finds least; each pair in a direction of its own."""
    r = np.random.default_rng(12)
    n, dim, rows, pairs = 1000, 64, [], []
    for i in range(n):
        a, b = r.standard_normal((2, dim))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        c = 0.93 + 0.01 * r.random() + 1e-9
        rows += [(2 * i, (3 * a).tolist(), 1), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist(), 1)]
        pairs.append(2 * i)
    got = {x["vec_id"]: x["component_id"] for x in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    assert np.mean([got[i + 1] == i for i in pairs]) >= 0.99


def test_equal_vectors_are_one_point(spark):
    """A vector that a third of the rows have is compared once, and its links are counted in full."""
    r = np.random.default_rng(13)
    base = r.standard_normal(16)
    near = base + 0.05 * r.standard_normal(16)
    rows = [(i, base.tolist(), 1) for i in range(5, 205)] + [(1000 + i, near.tolist(), 1) for i in range(3)] + [(2000 + i, r.standard_normal(16).tolist(), 1) for i in range(200)] + [(3000, base.tolist(), 2)]
    got = {x["vec_id"]: tuple(x)[1:] for x in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i] == (202, 5, i == 5) for i in range(5, 205))
    assert all(got[1000 + i] == (202, 5, False) for i in range(3))
    assert got[3000] == (0, 3000, True)
