"""Classifiers, mixing, media and the pipeline."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.llm import media, mixing, quality, toxicity
from rastermill.llm.common import documents
from rastermill.llm.queries import labels

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize(("module", "column", "mod", "out", "least"), [(quality, "quality", 5, 0, 0.97), (toxicity, "toxic", 4, 2, 0.93)])
def test_held_out_accuracy(spark, module, column, mod, out, least):
    known = labels(spark, SF)
    got = module.classify(documents(spark, SF), known).join(known.select("doc_id", column), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == out) for r in got)
    assert np.mean([r["predicted"] == r[column] for r in held]) >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


@pytest.mark.parametrize(("module", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows_and_labels(spark, docs, rows, module, column):
    known = spark.createDataFrame([(i, i % 2) for i in range(0, 60)] + [(3, 0), (None, 1), (4, None), (999, 1)], f"doc_id long, {column} int")
    got = module.classify(docs, known).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    for few in (known.limit(0), known.where(F.col(column) == 1)):
        assert len({r["score"] for r in module.classify(docs, few).collect()}) == 1
    assert module.classify(docs.limit(0), known).count() == 0


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    got = mixing.targets([10, 500, 90], [3, 1, 2])
    assert got[0] == 30
    assert got[1:] == [300, 270] or sum(got) == pytest.approx(600)
    assert all(t <= 3 * s for t, s in zip(got, [10, 500, 90], strict=True))
    assert mixing.targets([0, 0], [1, 2]) == [0, 0]


def test_mix(spark, docs, rows):
    got = mixing.mix(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((i is None, i or 0, size(t)) for i, t, *_ in rows)
    sources = {s: sum(size(t) for _, t, _, x, _ in rows if x == s) for s in {r[3] for r in rows}}
    names = [*sorted(s for s in sources if s is not None), None]
    want = dict(zip(names, mixing.targets([sources[s] for s in names], [1 + k % 3 for k in range(len(names))]), strict=True))
    of = {i: s for i, _, _, s, _ in rows}
    taken = dict.fromkeys(names, 0)
    for r in got:
        s = of[r["doc_id"]]
        assert r["source_size"] == sources[s]
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] % max(1, r["size"]) == 0
        taken[s] += r["taken"]
    largest = max(size(t) for _, t, *_ in rows)
    assert all(abs(taken[s] - want[s]) <= largest for s in names)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_flow_over_overlapping_sources(spark):
    plan = mixing.solve({("a",): 100, ("a", "b"): 100, ("b",): 20}, {"a": 1.0, "b": 1.0})
    assert all(plan.words[p] <= 3 * n for p, n in {("a",): 100, ("a", "b"): 100, ("b",): 20}.items())
    alone = mixing.solve({("a",): 100, ("b",): 900, (None,): 0}, {"a": 3.0, "b": 1.0, None: 2.0})
    assert alone.words == {("a",): 300, ("b",): 700, (None,): 0}
    assert plan.words["a",] + plan.routed[("a", "b"), "a"] == round(plan.sources["a"][1])
    df = spark.createDataFrame([(i, "w " * (1 + i % 9), [["a"], ["a", "b"], ["b", "a"], ["b"], [], None][i % 6]) for i in range(120)], "doc_id long, text string, source array<string>")
    assert mixing.mix(df).count() == 120


def test_flow_costs_the_least():
    """Against every way to route whole words, on small networks."""
    from itertools import product

    r = np.random.default_rng(6)
    for _ in range(12):
        patterns = {p: int(r.integers(1, 4)) for p in [("a",), ("a", "b"), ("b",), ("b", "c"), ("c",)] if r.random() < 0.8} or {("a", "b"): 2}
        weights = {s: float(r.integers(1, 4)) for s in sorted({s for p in patterns for s in p})}
        plan = mixing.solve(patterns, weights)
        quota = {s: round(w) for s, (_, w) in plan.sources.items()}
        best = None
        ways = [(p, s) for p in patterns for s in p]
        for flow in product(*(range(min(3 * patterns[p], quota[s]) + 1) for p, s in ways)):
            out, into = dict.fromkeys(patterns, 0), dict.fromkeys(weights, 0)
            for (p, s), n in zip(ways, flow, strict=True):
                out[p] += n
                into[s] += n
            if all(out[p] <= 3 * n for p, n in patterns.items()) and all(into[s] <= quota[s] for s in weights):
                cost = sum(max(0, out[p] - n) + 3 * max(0, out[p] - 2 * n) for p, n in patterns.items())
                best = min(best or (1, 0), (-sum(flow), cost))
        words = sum(plan.words.values())
        cost = sum(max(0, plan.words[p] - n) + 3 * max(0, plan.words[p] - 2 * n) for p, n in patterns.items())
        assert (-words, cost) == best


def test_targets_of_many_sources():
    r = np.random.default_rng(8)
    sizes, weights = r.integers(0, 1000, 5000).tolist(), [1 + k % 3 for k in range(5000)]
    got = mixing.targets(sizes, weights)
    assert sum(got) == pytest.approx(sum(sizes))
    level = max(g / w for g, w in zip(got, weights, strict=True))
    assert all(g == 3 * s or g == pytest.approx(level * w) for g, s, w in zip(got, sizes, weights, strict=True))
    assert all(g <= 3 * s for g, s in zip(got, sizes, strict=True))


def test_discriminant_equals_plain(spark, docs, rows):
    """The quality score of every row against a quadratic discriminant written out in numpy."""
    known = {i: int(i % 3 == 0) for i in range(0, 56)}
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, spark.createDataFrame(list(known.items()), "doc_id long, quality int")).collect()}
    texts = [(i, t or "") for i, t, *_ in rows]
    x = {i: np.array(quality.statistics(t)) for i, t in texts}
    train = [(x[i], known[i]) for i, _ in texts if i in known and zlib.crc32(str(i).encode()) % 5]
    cov = {k: np.cov(np.array([v for v, y in train if y == k]).T, bias=True) for k in (0, 1)}
    mean = {k: np.mean([v for v, y in train if y == k], 0) for k in (0, 1)}
    share = {k: np.mean([y == k for _, y in train]) for k in (0, 1)}
    pooled = sum(share[k] * cov[k] for k in (0, 1))

    def density(v, k):
        c = 0.95 * cov[k] + 0.05 * pooled
        c = 0.95 * c + 0.05 * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        d = v - mean[k]
        return np.log(share[k]) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * d @ np.linalg.solve(c, d)

    def damped(v):
        d = density(v, 1) - density(v, 0)
        return np.sign(d) * np.log1p(abs(d))

    a, b = quality.curve(np.array([damped(v) for v, _ in train]), np.array([y for _, y in train]))
    for i, v in x.items():
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(a * damped(v) + b))), abs=1e-6)


def test_log_count_ratios_equal_plain(spark):
    """The toxicity model's features and ratios against counts of character n-grams in plain Python."""
    r = np.random.default_rng(9)
    words = {0: ["good", "calm", "\xc4pfel", "day"], 1: ["vile", "calm", "\xc4PFEL", "rot"]}
    texts = [(i, " ".join(r.choice(words[i % 2], 6))) for i in range(120)]
    texts[4] = (4, None)
    docs, known = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    train = [(f" {(t or '').lower()} ", i % 2) for i, t in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    counts: dict[str, list[int]] = {}
    for t, y in train:
        for g in {t[k : k + n] for n in toxicity.SIZES for k in range(len(t) - n + 1)}:
            counts.setdefault(g, [0, 0])[y] += 1
    total = [sum(y == c for _, y in train) for c in (0, 1)]
    often = {g: c for g, c in counts.items() if sum(c) >= 4}
    assert len(model.keys) == min(toxicity.FEATURES, len(often))
    for t, _ in train[:20]:
        grams = {t[k : k + n] for n in toxicity.SIZES for k in range(len(t) - n + 1)} & set(often)
        assert len(model.present(t[1:-1])) == len(grams)
    score = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    assert all((score[i] > 0.5) == (i % 2 == 1) for i, t in texts if t and ({*t.split()} & {"good", "day", "vile", "rot"}))
    names = {int(next(k for k in toxicity.ngrams(g) if len(k))[0]) for g in ()}
    assert not names
    ratio = lambda c: np.log(((c[1] + 1) / (total[1] + 2)) / ((c[0] + 1) / (total[0] + 2)))
    for g in ("vile", "good"):
        assert np.sign(ratio(often[g])) == (1 if g == "vile" else -1)
    assert {"\xe4pfel", "calm"} <= set(often)


def test_media(spark, docs, rows):
    got = media.store_and_describe(docs, "text").collect()
    assert len(got) == len(rows)
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    for r in got:
        raw = texts[r["doc_id"]]
        data = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        parts = media.chunks(data)
        form = b"CDC1" + len(parts).to_bytes(4, "little") + b"".join(len(c).to_bytes(4, "little") for c in parts) + b"".join(hashlib.sha256(c).digest() for c in parts)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(form), hashlib.sha256(form).hexdigest())
    assert media.store_and_describe(docs.limit(0), "text").count() == 0


def test_a_full_filter_changes_no_result(spark, docs, monkeypatch):
    want = sorted(map(str, media.store_and_describe(docs, "text").collect()))
    monkeypatch.setattr(media, "filter_of", lambda digests: np.full(media.FILTER_BITS // 64, ~np.uint64(0)))  # the driver broadcasts it
    assert sorted(map(str, media.store_and_describe(docs, "text").collect())) == want


def test_damage_is_found(spark, tmp_path):
    from rastermill.llm.common import scratch

    df = spark.createDataFrame([(1, b"abc" * 3000)], "doc_id long, payload binary")
    for column, change in (("bytes", F.concat(F.lit(b"X"), F.expr("substring(bytes, 2)"))), ("form", F.concat(F.lit(b"CDC0"), F.expr("substring(form, 5)")))):
        path, bad = scratch(spark, "media-test"), scratch(spark, "media-test")
        media.write_media(df, "payload", path)
        spark.read.parquet(path).withColumn(column, change).write.parquet(bad)
        with pytest.raises(Exception, match="damaged|differs"):
            media.read_media(spark, bad).collect()


def test_media_chunks_are_shared(spark):
    r = np.random.default_rng(2)
    common = r.integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    rows = [(1, b"start" + common), (2, r.integers(0, 256, 5000, dtype=np.uint8).tobytes() + common + b"x"), (3, common + common), (4, b"\0" * 50_000), (5, b"start" + common), (None, b"q"), (7, None)]
    from rastermill.llm.common import scratch

    path = scratch(spark, "media-test")
    listed = media.write_media(spark.createDataFrame(rows, "doc_id long, payload binary"), "payload", path)
    stored = spark.read.parquet(path)
    assert stored.agg(F.sum(F.length("bytes"))).first()[0] < 1.6 * len(common) + 60_000
    whole = {bytes(x["payload_sha"]): x["payload_sha256"] for x in media.read_media(spark, path).collect()}
    assert {bytes(x["payload_sha"]).hex() for x in listed.collect()} == set(whole.values())
    data = media.padded(rows[1][1])
    assert b"".join(media.chunks(data)) == data
    hashes = media.gear_hashes(data)
    slow = 0
    for k in range(3000 - media.WINDOW, 3000):
        slow = (slow << 1) + int(media.GEAR[data[k]]) & 0xFFFFFFFF
    assert int(hashes[2999]) == slow


def shingles(text: str, k: int = 5) -> set:
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def copies_left(rows: list) -> set:
    """Ids that stand for their groups, by comparing all with all."""
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    home = {i: i for i in sets}

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    ids = sorted(sets)
    for k, x in enumerate(ids):
        for y in ids[k + 1 :]:
            if sets[x] and sets[y] and 0.8 <= len(sets[x]) / len(sets[y]) <= 1.25 and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                home[b] = a
    return {i for i in ids if find(i) == i}


def without_repeats(rows: list) -> dict:
    """Texts without the words under a window of 50 that starts in a smaller document too."""
    first: dict[tuple, int] = {}
    words = {r["doc_id"]: WORD.findall(r["text"] or "") for r in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    out = {}
    for r in rows:
        i, gone = r["doc_id"], set()
        for k in range(len(words[i]) - 49):
            if first[tuple(words[i][k : k + 50])] < i:
                gone.update(range(k, k + 50))
        out[i] = " ".join(w for k, w in enumerate(words[i]) if k not in gone) if gone else r["text"] or ""
    return out


def test_pipeline(spark, tmp_path):
    """Every stage against plain Python, on the smallest tables with odd rows added."""
    import os

    import corpus_pipeline
    from tokenizers import Tokenizer

    from rastermill.llm.queries import tokenizer

    sf = str(tmp_path)
    source = "/root/testdata/sf0.001"
    every = spark.read.parquet(f"{source}/documents.parquet")
    odd = [(9_000_000, None, "en", "src", 0), (9_000_001, "", "en", None, 0), (9_000_002, "word", None, "src", 4)]
    every = every.unionByName(spark.createDataFrame(odd, every.schema)).unionByName(every.where("doc_id = 7"))
    every.write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{source}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "mixing sources", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/stage{k}")
        docs = spark.read.parquet(f"{sf}/stage{k}")
        seen.append(docs.collect())
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    good, one, cut, mixed, packed = seen
    before = spark.read.parquet(f"{sf}/documents.parquet").collect()
    score = {r["doc_id"]: r["score"] for r in quality.classify(spark.createDataFrame(before, every.schema), labels(spark, sf)).collect()}
    assert sorted(r["doc_id"] for r in good) == sorted(r["doc_id"] for r in before if score[r["doc_id"]] >= 0.3)
    known = {r["doc_id"]: r["quality"] for r in labels(spark, sf).collect()}
    kept = {r["doc_id"] for r in good}
    assert np.mean([(i in kept) == (q == 1) for i, q in known.items() if i in score]) > 0.95
    assert sorted(r["doc_id"] for r in one) == sorted(copies_left(good))
    texts = without_repeats(one)
    assert {r["doc_id"]: r["text"] for r in cut} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in cut)
    count = lambda text: len(WORD.findall(text or ""))
    size: dict = {}
    for r in cut:
        size[r["source"]] = size.get(r["source"], 0) + count(r["text"])
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    wanted = dict(zip(names, mixing.targets([size[s] for s in names], [1 + k % 3 for k in range(len(names))]), strict=True))
    taken = dict.fromkeys(names, 0)
    times: dict = {}
    for r in mixed:
        taken[r["source"]] += count(r["text"])
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    largest = max(count(r["text"]) for r in cut)
    assert all(abs(taken[s] - wanted[s]) <= largest for s in names)
    assert max(times.values()) <= 3
    assert {(r["doc_id"], r["text"]) for r in mixed} <= {(r["doc_id"], r["text"]) for r in cut}
    plain = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    pieces: dict = {}
    for r in packed:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    for r in mixed:
        ids = np.array([*plain.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        want = [(s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for s in range(0, len(ids), 2048)]
        assert sorted(pieces[r["doc_id"]]) == sorted(want * times[r["doc_id"]])
    spans: dict = {}
    for r in packed:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in spans.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 2048
    want = sorted(tuple(r) for r in packed)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == want
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert not [d for d in os.listdir(f"{shared}/rastermill") if d.startswith(("points", "segments", "reps", "members", "quality-"))]


def test_registered_queries(spark, tmp_path):
    """The columns of every registered query, on a small table with odd rows."""
    from rastermill.llm import queries

    sf = str(tmp_path)
    every = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    odd = [(9_000_000, None, "en", "src", 0), (9_000_001, "", "en", None, 0), (9_000_002, "A<|endoftext|>b.", None, "src", 4)]
    every = every.unionByName(spark.createDataFrame(odd, every.schema))
    every.write.parquet(f"{sf}/documents.parquet")
    for t in ("labels", "embeddings"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{sf}/{t}.parquet")
    want = {
        "op1_repair": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
        "op2_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op3_embeddings": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
        "op4_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
        "op5_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
        "op6_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
        "op8_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    }
    ids = sorted(r["doc_id"] for r in every.select("doc_id").collect())
    for name, columns in want.items():
        got = queries.QUERIES[name](spark, sf)
        types = dict(got.dtypes)
        assert {c: types[c] for c in columns} == columns
        rows = got.collect()
        if name not in ("op3_embeddings", "op5_packing"):
            assert sorted(r["doc_id"] for r in rows) == ids
        assert not any(r[c] is None for r in rows for c in columns)
