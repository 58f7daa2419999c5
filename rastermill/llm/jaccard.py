"""Near-duplicate documents by Jaccard similarity of word shingles: a forest of count-vector R-trees.

Where the trees stand. In a common order of shingles, rare ones first, two documents that reach the
threshold share one of the first n - ceil(threshold * n) + 1 shingles of either: their roots. All
documents that share a root and whose sizes are near enough to link are put under the least of them,
their lead; as copies share many roots but few leads, a document goes into a few groups however
many roots it shares.

A tree. The tokens of a document, its shingles' hashes, are dealt into groups by hash, and the counts
of the groups are its point. Points are packed by size into leaves and nodes with the coordinates'
maxima; the overlap of a document with a point, leaf or node is at most the sum of the coordinate
minima, and what can't reach the threshold is pruned. What survives is held against a second,
finer grouping, of whose counts only the parities are kept: where they differ the two counts
differ, which bounds the overlap again, near the truth. Pairs that survive both are verified at
once on the whole sets, but only while the two are not in one component yet, so a tree gives a
spanning forest of true links: fewer rows than it has points.

Trees are built twice. The first ones, of points from small sketches that are made with the roots, tell
which documents of a group have any partner there; only these documents' texts are moved, and their sets
fill the second ones. Documents that share a root by chance, more and more as a corpus grows, go no further.

A group of more than CELL bytes is dealt at random into blocks, one tree each. Blocks that
are not one component by then meet two by two, at growing distances, until no two blocks of different
components are left: copies are joined after a round or two, and no pair goes unverified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch, fresh, materialize, parts, prepare, release, slices
from .components import components
from .words import distinct, mixed, runs, words

WIDTH, NUMERATOR, DENOMINATOR = 5, 80, 100
#: A point of 2^k shingles or more has 2^k / SPREAD groups, LEAST_GROUPS at least, and PARITIES * 2^k of the finer ones: for sketches, and for sets.
LEAST_GROUPS, SKETCH, FULL = 8, (16, 1), (8, 8)
LEAF = 32
#: Bytes of text hashed at once.
SLICE = 1 << 19
#: Bytes of text in a tree at most, unless one text alone is longer; a document counts as so many more.
CELL, EXTRA = 8 << 20, 256
#: Bytes of a root's name for so many roots; two that share a name cost a needless comparison at worst.
SPARE_BITS = 16
#: A shingle that a slice's documents hold so often is reported as common; the COMMON most frequent are ordered last. Any order gives the same links.
OFTEN, COMMON = 4, 50_000
#: Values in one array or pairs in one step, to bound memory.
STEP = 1 << 21
ONE = np.uint64(0x243F6A8885A308D3)

POINTS = "doc_id long, n long, set_a long, set_b long, bytes long, keys array<long>, counts binary, parity binary"


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each UTF-8 text, A-Z folded; fewer words than `width` are one shingle, none give none."""
    out: list[np.ndarray] = []
    for lo, hi in slices(texts, SLICE):
        hashes, bounds = words(texts[lo:hi], fold_case=True)
        every = runs(hashes, width)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(distinct(every[a : b - width + 1]))
            elif b > a:
                short = np.full(1, b - a, np.uint64) * ONE
                for k in range(a, b):
                    short = mixed(short * np.uint64(3) + hashes[k : k + 1])
                out.append(short)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def needed(a: np.ndarray | int, b: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """The least overlap of sets of a and b elements at the threshold: ceil(num * (a + b) / (num + den))."""
    return -(-num * (a + b) // (num + den))


def common_shingles(texts: DataFrame, width: int) -> tuple[list[tuple[int, int]], int]:
    """(shingle, documents) of frequent shingles, at most COMMON, and how many shingles all documents have together."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("every", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            key, n = np.unique(np.concatenate(shingle_sets(b.column(0).to_pylist(), width)), return_counts=True)
            every = int(n.sum())
            key, n = key[n >= OFTEN], n[n >= OFTEN]
            yield batch(schema, [[None, *key.view(np.int64).tolist()], [0, *n.tolist()], [every] + [0] * len(key)])

    found = materialize(texts.select("text").mapInArrow(count, "key long, n long, every long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("every").alias("every")), "common")
    total = found.where("key is null").select("every").collect()
    often = [tuple(r) for r in found.where("key is not null").select("key", "n").orderBy(F.desc("n"), "key").limit(COMMON).collect()]
    release(found)
    return often, total[0][0] if total else 0


def key_bytes(roots: int) -> int:
    return min(8, -(-(max(1, roots).bit_length() + SPARE_BITS) // 8))


def points(texts: DataFrame, width: int, num: int, den: int, common: list[tuple[int, int]], size: int) -> DataFrame:
    """POINTS of every document: set size, the set's 128-bit name, the text's length, the roots and the sketch."""
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n", "set_a", "set_b", "bytes")), ("keys", pa.list_(pa.int64())), ("counts", pa.binary()), ("parity", pa.binary())])
    keys = np.array([k for k, _ in common], np.int64).view(np.uint64)
    order = np.argsort(keys)
    shared = texts.sparkSession.sparkContext.broadcast((keys[order], np.array([n for _, n in common], np.int64)[order]))  # COMMON rows of 16 bytes at most
    cut = np.uint64(64 - 8 * min(size, 7))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = shared.value
        for b in parts(batches):
            raw, rows, roots, marks = b.column(1).to_pylist(), [], [], []
            for t, s in zip(raw, shingle_sets(raw, width), strict=True):
                n = len(s)
                first = n - -(-num * n // den) + 1 if n else 0
                if n and len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    rank = np.where(often[at] == s, times[at], 0)
                    roots.append(s[np.lexsort((s, rank))[:first]])
                else:
                    roots.append(s[:first])
                rows.append((n, *set_name(s), len(t)))
                marks.append([x.tobytes() for x in point(s, *SKETCH)] if n else [None, None])
            ends = np.cumsum([0, *map(len, roots)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((np.concatenate(roots) >> cut).view(np.int64)))
            yield batch(schema, [b.column(0), *zip(*rows, strict=True), lists, *zip(*marks, strict=True)])

    return texts.mapInArrow(make, POINTS)


def set_name(s: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit name as two signed numbers."""
    name = (int(mixed(s).sum(dtype=np.uint64)), int(mixed(s ^ ONE).sum(dtype=np.uint64)))
    return tuple(x - (1 << 64) if x >> 63 else x for x in name)


def point(s: np.ndarray, spread: int, parities: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's point: the counts of its groups, a byte each, and the parities of the finer groups' counts, 64 to a word.

    A shingle's group is its hash modulo the number of groups, a power of two: so fewer groups are sums of
    more, or exclusive ors. Groups double where a count passes a byte.
    """
    band = len(s).bit_length() - 1
    groups = max(LEAST_GROUPS, (1 << band) // spread)
    at = (s >> np.uint64(7)).astype(np.int64)
    while (counts := np.bincount(at & (groups - 1), minlength=groups)).max() > 255:
        groups *= 2
    fine = max(64, parities << band)
    odd = np.bincount((s >> np.uint64(9)).astype(np.int64) & (fine - 1), minlength=fine) & 1
    return counts.astype(np.uint8), np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fewer(a: np.ndarray, n: int, combine: np.ufunc) -> np.ndarray:
    """A point's counts, or parities, for n groups, or words."""
    return a if len(a) == n else combine.reduce(a.reshape(-1, n), axis=0)


def may_link(p: tuple[np.ndarray, np.ndarray], q: tuple[np.ndarray, np.ndarray], a: int, b: int, num: int, den: int) -> bool:
    """Whether points of sets of a and b shingles don't rule out a link."""
    if num * max(a, b) > den * min(a, b):
        return False
    least, groups, n = needed(a, b, num, den), min(len(p[0]), len(q[0])), min(len(p[1]), len(q[1]))
    if int(np.minimum(fewer(p[0].astype(np.int64), groups, np.add), fewer(q[0].astype(np.int64), groups, np.add)).sum()) < least:
        return False
    return a + b - int(np.bitwise_count(fewer(p[1], n, np.bitwise_xor) ^ fewer(q[1], n, np.bitwise_xor)).sum()) >= 2 * least


class Tree:
    """Points of one cell whose sizes are near enough to link, packed by size, with the nodes' maxima.

    order: the cell's documents in the tree, by size; finer: which of them have a tree of their own among larger ones.
    """

    def __init__(self, points: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray, order: np.ndarray, finer: np.ndarray):
        self.order, self.finer, self.sizes = order, finer, sizes[order]
        groups, n = (min(len(points[i][k]) for i in order) for k in (0, 1))
        self.counts = np.stack([fewer(points[i][0].astype(np.uint16), groups, np.add) for i in order])
        self.parity = np.stack([fewer(points[i][1], n, np.bitwise_xor) for i in order])
        self.leaves = np.arange(0, len(order), LEAF)
        self.high = np.maximum.reduceat(self.counts, self.leaves)

    def near(self, rows: np.ndarray, high: np.ndarray, least: int, most: int, num: int, den: int) -> np.ndarray:
        """Those of rows that may link with a document of `least` to `most` shingles under a node of these maxima."""
        rows = rows[den * most >= num * self.sizes[rows]]
        found, step = [rows[:0]], max(1, STEP // len(high))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            found.append(part[np.minimum(self.counts[part], high).sum(1, dtype=np.int64) >= needed(self.sizes[part], least, num, den)])
        return np.concatenate(found)

    def pairs(self, label: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Surviving pairs of the cell's documents, leaf by leaf. label: each document's component, which the caller brings up to date."""
        n = len(self.order)
        for top in range(0, len(self.leaves), LEAF):
            leaves = range(top, min(top + LEAF, len(self.leaves)))
            under = np.arange(top * LEAF, n)
            if len(leaves) > 1:
                under = self.near(under, self.high[leaves.start : leaves.stop].max(0), int(self.sizes[top * LEAF]), int(self.sizes[min(n, (top + LEAF) * LEAF) - 1]), num, den)
            for k in leaves:
                inner = np.arange(self.leaves[k], min(self.leaves[k] + LEAF, n))
                own = label[self.order[inner]]
                rows = under[under >= inner[0]]
                if (own == own[0]).all():
                    rows = rows[label[self.order[rows]] != own[0]]
                rows = self.near(rows, self.high[k], int(self.sizes[inner[0]]), int(self.sizes[inner[-1]]), num, den)
                step = max(1, STEP // (len(inner) * max(self.parity.shape[1], self.counts.shape[1])))
                for lo in range(0, len(rows), step):
                    part = rows[lo : lo + step]
                    least = needed(self.sizes[part][:, None], self.sizes[inner][None, :], num, den)
                    ok = np.minimum(self.counts[part][:, None, :], self.counts[inner][None, :, :]).sum(2, dtype=np.int64) >= least
                    ok &= (inner[None, :] < part[:, None]) & ~(self.finer[part][:, None] & self.finer[inner][None, :])
                    a, b = np.nonzero(ok)
                    a, b = part[a], inner[b]
                    apart = np.bitwise_count(self.parity[a] ^ self.parity[b]).sum(1, dtype=np.int64)
                    keep = self.sizes[a] + self.sizes[b] - apart >= 2 * needed(self.sizes[a], self.sizes[b], num, den)
                    yield self.order[a[keep]], self.order[b[keep]]


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = y.searchsorted(x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def trees(points: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray, label: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a cell's documents, of different labels as these now are, that survive: from a tree for each band of sizes, with the bands that link into it."""
    bands = np.array([n.bit_length() - 1 for n in sizes.tolist()])
    span = (den // num).bit_length()  # sizes within den / num are of bands within this
    for band in np.unique(bands).tolist():
        own = np.flatnonzero((bands >= band) & (bands <= band + span))
        if len(own) > 1 and (label[own] != label[own[0]]).any():
            own = own[np.argsort(sizes[own], kind="stable")]
            yield from Tree(points, sizes, own, bands[own] > band).pairs(label, num, den)


def partnered(points: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which documents of a cell have a partner that survives."""
    seen = np.zeros(len(sizes), bool)
    if len(sizes) == 2:
        seen[:] = may_link(*points, *sizes.tolist(), num, den)
        return seen
    for a, b in trees(points, sizes, np.arange(len(sizes)), num, den):
        seen[a] = seen[b] = True
    return seen


def links_of(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray | None, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the true links between documents of different labels, and of different sides where sides are given."""
    label, out = np.unique(label, return_inverse=True)[1], []
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))

    def true(a: int, b: int) -> bool:
        both = overlap(sets[a], sets[b])
        return den * both >= num * (int(sizes[a]) + int(sizes[b]) - both)

    points = [point(s, *FULL) for s in sets]
    if len(sets) == 2:
        return [(0, 1)] if label[0] != label[1] and (side is None or side[0] != side[1]) and may_link(*points, *sizes.tolist(), num, den) and true(0, 1) else []
    for a, b in trees(points, sizes, label, num, den):
        if side is not None:
            a, b = a[side[a] != side[b]], b[side[a] != side[b]]
        tries = 1
        while True:  # pairs of different components, `tries` of each two components at a time
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
            if not len(a):
                break
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            by = np.lexsort((high, low))
            a, b, low, high = a[by], b[by], low[by], high[by]
            first = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
            place = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
            now = place < tries
            for i, j in zip(a[now].tolist(), b[now].tolist(), strict=True):
                if label[i] != label[j] and true(i, j):
                    out.append((i, j))
                    label[label == max(label[i], label[j])] = min(label[i], label[j])
            a, b, tries = a[~now], b[~now], 4 * tries
    return out


def with_partners(groups: DataFrame, num: int, den: int) -> DataFrame:
    """(lead, node, bytes) of the documents that have a partner in their group by their sketches. groups: (lead, node, n, bytes, counts, parity), a group in one task."""
    schema = pa.schema([("lead", pa.int64()), ("node", pa.int64()), ("bytes", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, [], []

        def close() -> None:
            rows = list({(r[0], r[1], r[3], r[4]): r for r in held}.values())  # a repeated row is one document; an id may have several texts
            if len({r[0] for r in rows}) > 1:
                seen = partnered([(np.frombuffer(r[3], np.uint8), np.frombuffer(r[4], np.uint64)) for r in rows], np.array([r[1] for r in rows]), num, den)
                found.extend((now, r[0], r[2]) for r, s in zip(rows, seen.tolist(), strict=True) if s)

        for b in parts(batches):
            for lead, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if lead != now:
                    close()
                    now, held = lead, []
                held.append(row)
            if found:
                yield batch(schema, list(zip(*found, strict=True)))
                found.clear()
        close()
        if found:
            yield batch(schema, list(zip(*found, strict=True)))

    return groups.repartition("lead").sortWithinPartitions("lead").mapInArrow(find, "lead long, node long, bytes long")


def find_links(cells: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b): true links of each cell, at most one for each of its documents. cells: (lead, low, high, node, own, label, packed), a cell in one task."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        now, held, found = None, [], []

        def close() -> None:
            if len(held) < 2:
                return
            node, own, label, sets = zip(*held, strict=True)
            side = np.array(own) if now[1] != now[2] else None
            found.extend((node[i], node[j]) for i, j in links_of(list(sets), np.array(label), side, num, den))

        for b in parts(batches, 256):
            lead, low, high, node, own, label, packed = (c.to_pylist() for c in b.columns)
            sets = shingle_sets([expand(p) for p in packed], width)
            for key, row in zip(zip(lead, low, high, strict=True), zip(node, own, label, sets, strict=True), strict=True):
                if key != now:
                    close()
                    now, held = key, []
                if len(row[3]):
                    held.append(row)
            if len(found) > 10_000:
                yield batch(schema, list(zip(*found, strict=True)))
                found.clear()
        close()
        if found:
            yield batch(schema, list(zip(*found, strict=True)))

    return cells.repartition("lead", "low", "high").sortWithinPartitions("lead", "low", "high").mapInArrow(find, "a long, b long")


def packed_texts(texts: DataFrame) -> DataFrame:
    """(node, packed): texts compressed, as they are moved."""
    schema = pa.schema([("node", pa.int64()), ("packed", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in parts(batches):
            yield batch(schema, [b.column(0), [squeeze(t) for t in b.column(1).to_pylist()]])

    return texts.where("doc_id is not null").mapInArrow(send, "node long, packed binary")


def linked(reps: DataFrame, texts: DataFrame, width: int, num: int, den: int, cell: int) -> DataFrame:
    """(a, b): true links that join what can be joined. reps: (rep, n, bytes, keys, counts, parity) of documents that stand for their sets."""
    roots = reps.where("keys is not null").select(F.col("rep").alias("node"), "n", "bytes", F.explode("keys").alias("key"))
    crowds = materialize(roots.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("key"), "crowds")
    # Sizes that can link are in one band or in neighbouring ones, and two such bands are one slot of either kind.
    size = F.floor(F.log("n") / (1.0001 * math.log(den / num))) if num < den else F.col("n")
    crowded = roots.join(crowds, "key").select("key", "node", "bytes", F.explode(F.array(2 * F.floor(size / 2), 2 * F.floor((size + 1) / 2) + 1)).alias("slot"))
    crowded = materialize(crowded, "crowded")
    near = crowded.groupBy("key", "slot").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").drop("last")
    near = materialize(near, "near")
    members = materialize(crowded.join(near, ["key", "slot"]).groupBy("lead", "node").agg(F.max("bytes").alias("bytes")), "members")
    release(crowds, crowded, near)
    weighed = members.groupBy("lead").agg((F.sum(F.col("bytes") + EXTRA) / cell).alias("cells"))
    groups = materialize(weighed.select("lead", F.greatest(F.lit(1), F.ceil("cells")).alias("blocks")).where("blocks > 1"), "large")
    small = members.join(groups, "lead", "left_anti").join(reps.where("keys is not null").select(F.col("rep").alias("node"), "n", "counts", "parity"), "node")
    small = with_partners(small.select("lead", "node", "n", "bytes", "counts", "parity"), num, den)
    chosen = materialize(small.select("lead", "node", F.lit(1).cast("long").alias("blocks")).unionByName(members.join(groups, "lead").select("lead", "node", "blocks")), "chosen")
    release(members)
    members = chosen
    members = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    packed = packed_texts(texts)
    cells = members.join(packed, "node").select("lead", F.col("own").alias("low"), F.col("own").alias("high"), "node", "own", F.col("node").alias("label"), "packed")
    links = [materialize(find_links(cells, width, num, den), "links")]
    reach = 1
    if not groups.isEmpty():
        large = materialize(members.where("blocks > 1"), "blocks")
        most = large.agg(F.max("blocks")).first()[0]
        held = materialize(packed.join(large.select("node").distinct(), "node", "left_semi"), "block-texts")
        while reach < most:
            joined = components(every(links))
            labelled = materialize(large.join(joined, "node", "left").select("lead", "node", "blocks", "own", F.coalesce("component_id", "node").alias("label")), "labels")
            release(joined)
            block = labelled.groupBy("lead", "blocks", "own").agg(F.min("label").alias("least"), F.max("label").alias("most"))
            far = F.explode(F.sequence(F.col("own") + reach, F.least(F.col("own") + 2 * reach, F.col("blocks")) - 1))
            near = block.where(F.col("own") + reach < F.col("blocks")).select("lead", F.col("own").alias("low"), F.col("least").alias("a"), F.col("most").alias("b"), far.alias("high"))
            other = block.select("lead", F.col("own").alias("high"), F.col("least").alias("c"), F.col("most").alias("d"))
            two = materialize(near.join(other, ["lead", "high"]).where("a != b or c != d or a != c").select("lead", "low", "high"), "meetings")
            if not two.isEmpty():
                sides = two.select("lead", "low", "high", F.explode(F.array("low", "high")).alias("own"))
                cells = sides.join(labelled.drop("blocks"), ["lead", "own"]).join(held, "node").select("lead", "low", "high", "node", "own", "label", "packed")
                links.append(materialize(find_links(cells, width, num, den), "links"))
            release(labelled, two)
            reach *= 2
        release(large, held)
    release(groups, chosen)
    return links


def every(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, cell: int = CELL) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: components of documents linked at the threshold or more.

    Documents without words, null texts included, have no shingles and link with nothing. Rows with
    one id are one document, which links as any of its texts does: they share a component. A row
    without an id links with nothing and has no component. An empty table gives no rows.
    """
    spark = prepare(df.sparkSession)
    texts = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).cast("binary").alias("text"))
    num, den = numerator, denominator
    common, total = common_shingles(texts, width)
    found = materialize(points(texts, width, num, den, common, key_bytes(total)), "points")
    name = ["set_a", "set_b", "n"]
    twins = found.where("n > 0 and doc_id is not null").groupBy(*name).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last")
    twins = materialize(twins, "twins")  # a table of its own, so that a set which very many documents have is a skewed join that Spark can split
    rep = F.when(F.col("doc_id").isNotNull(), F.coalesce("owner", "doc_id"))
    reps = materialize(found.join(twins, name, "left").select("doc_id", "n", rep.alias("rep"), "bytes", *(F.when(rep == F.col("doc_id"), F.col(c)).alias(c) for c in ("keys", "counts", "parity"))), "reps")
    release(found, twins)
    links = linked(reps, texts, width, num, den, cell)

    # An id with several sets ties what stands for them.
    split = reps.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id")
    ties = reps.join(split, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comp = components(every([*links, ties]))
    release(*links)
    out = reps.select("doc_id", F.col("n").alias("n_shingles"), "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df, all columns kept, that stand for their components: those with the least id, one row for each id. Rows without an id stay."""
    kept = similar_documents(df, id_col, text_col, **options).where("doc_id = component_id").select("doc_id").distinct()
    key, place = fresh(df, "key"), fresh(df, "place")
    rows = df.withColumn(key, df[id_col].cast("long"))
    stay = rows.join(kept.withColumnRenamed("doc_id", key), key, "left_semi")
    stay = stay.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(text_col)))).where(F.col(place) == 1)
    return stay.select(*df.columns).unionByName(df.where(df[id_col].isNull()))
