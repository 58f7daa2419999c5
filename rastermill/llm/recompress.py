"""Removal of repeated passages, found by recompression.

A document's words are named by content, then runs of one word, then, in ROUNDS rounds, pairs: each
symbol is left or right by a bit of its name, and a left one followed by a right one becomes a new
symbol, named by the two. Whether two symbols join depends on these two alone, so equal passages
get equal symbols but near their ends; and as a name is a hash of what it stands for, rounds agree
over all documents without exchanging anything. With every symbol goes its reach: the stretch of
words that its existence depends on.

A window of WIDTH words takes as its anchor the highest symbol whose reach lies within it (a single
word at least), the first of several. Equal windows have equal anchors at equal places, wherever
they occur: so a window can repeat only where its anchor's name occurs in another document. Windows
in a row with one anchor form a segment. Spark counts the anchors' documents; only segments with a
shared anchor go on. A segment whose whole content also occurs in a smaller document is covered;
windows of the others, at the edges of passages, are compared one by one, where two documents still
share an anchor. Windows are compared by two independent 64-bit hashes of the words themselves,
segments by one and their anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, materialize, parts, prepare, release, slices
from .words import ALL, BASE, OTHER_VALUES, mixed, powers, rolling, words

WIDTH = 50
ROUNDS = 12
OTHER_BASE = 0xC2B2AE3D27D4EB4F | 1
FAR = 1 << 40
#: Bytes of text hashed at once, and words for which symbols are named at once; a longer text is taken in pieces that overlap by a window.
SLICE, PIECE = 1 << 20, 1 << 17

SEGMENTS = "row long, doc_id long, key long, content long, start int, count int"
CLEANED = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def symbols(names: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(name, from, to) of the new symbols of each level, in order of place; from and to: the reach in words.

    doc: which document each word is of; symbols never cross documents, and what depends on a
    document's end reaches beyond any window.
    """
    n = len(names)
    at = np.arange(n)
    levels = [(names, at, at + 1)]
    if n < 2:
        return levels
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    last = np.concatenate((first[1:], [True]))
    new = first | np.concatenate(([True], names[1:] != names[:-1]))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    length = ends - starts
    name = np.where(length > 1, mixed(names[starts] + mixed(length.astype(np.uint64))), names[starts])
    low = np.where(first[starts], -FAR, starts - 1)
    high = np.where(last[ends - 1], FAR, ends + 1)
    owner = doc[starts]
    ran = length > 1
    levels.append((name[ran], low[ran], high[ran]))
    for r in range(ROUNDS):
        if len(name) < 2:
            break
        right = (mixed(name + np.uint64((r + 1) * BASE & ALL)) >> np.uint64(40)) & np.uint64(1) == 1
        meet = ~right[:-1] & right[1:] & (owner[:-1] == owner[1:])
        # An unjoined left symbol depends on the one after it, an unjoined right one on the one before.
        edge = owner[:-1] != owner[1:]
        after = np.append(np.where(edge, FAR, high[1:]), FAR)
        before = np.concatenate(([-FAR], np.where(edge, -FAR, low[:-1])))
        joined = np.append(meet, False)
        absorbed = np.concatenate(([False], meet))
        up = np.where(joined, np.append(high[1:], FAR), np.where(right, high, np.maximum(high, after)))
        down = np.where(~joined & right, np.minimum(low, before), low)
        named = name.copy()
        i = np.flatnonzero(meet)
        named[i] = mixed(name[i] * np.uint64(OTHER_BASE) + name[i + 1] + np.uint64(r))
        levels.append((named[i], low[i], high[i + 1]))
        keep = ~absorbed
        name, low, high, owner = named[keep], down[keep], up[keep], owner[keep]
    return levels


def segments(names: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor, content) of each segment; windows are numbered by their first word in the batch."""
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(names))
    windows = at[at + width <= bounds[1:][doc]] if len(names) else at
    key, place = np.zeros(len(windows), np.uint64), np.zeros(len(windows), np.int64)
    open_ = np.arange(len(windows))
    levels = symbols(names, doc)
    for level in range(len(levels) - 1, -1, -1):
        name, low, high = levels[level]
        if not len(open_) or not len(name):
            continue
        s = windows[open_]
        if level:  # reaches move to the right with their symbols; those beyond a document can't be anchors
            fits = (low > -FAR) & (high < FAR)
            name, low, high = name[fits], low[fits], high[fits]
            if not len(name):
                continue
        i = np.searchsorted(low, s)
        found = i < len(low)
        i = np.minimum(i, len(low) - 1)
        found &= high[i] <= s + width
        key[open_[found]] = mixed(name[i[found]] + np.uint64(level * OTHER_BASE & ALL))
        place[open_[found]] = low[i[found]]
        open_ = open_[~found]
    if not len(windows):
        return (windows,) * 3 + (key, key)
    cut = np.concatenate(([True], (np.diff(windows) != 1) | (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (doc[windows][1:] != doc[windows][:-1])))
    first = np.flatnonzero(cut)
    count = np.diff(np.append(first, len(windows)))
    start = windows[first]
    sums = np.concatenate(([np.uint64(0)], np.cumsum(names * powers(BASE, len(names)), dtype=np.uint64)))
    stop = start + count - 1 + width
    content = mixed((sums[stop] - sums[start]) * powers(pow(BASE, -1, 1 << 64), len(names))[start] + (count.astype(np.uint64) << np.uint64(32)) + (place[first] - start).astype(np.uint64))
    return doc[start], start - bounds[doc[start]], count, key[first], content


def pieces(bounds: np.ndarray, width: int, most: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (document, from, to) of about `most` words together; each window of a document lies in exactly one piece."""
    now, size = [], 0
    for d, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for at in range(lo, max(lo + 1, hi - width + 1), most):
            stop = min(hi, at + most + width - 1)
            if now and size + stop - at > most + width:
                yield now
                now, size = [], 0
            now.append((d, at, stop))
            size += stop - at
    if now:
        yield now


def find_segments(texts: DataFrame, width: int) -> DataFrame:
    """SEGMENTS of rows (doc_id, text, row)."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("count", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            ids, texts_, rows = (b.column(i).to_pylist() for i in range(3))
            for lo, hi in slices(texts_, SLICE):
                names, bounds = words(texts_[lo:hi])
                rows_, ids_ = np.array(rows[lo:hi]), np.array(ids[lo:hi])
                for some in pieces(bounds, width, PIECE):
                    which, begin = np.array([p[0] for p in some]), np.array([p[1] for p in some])
                    own = np.concatenate([names[x:y] for _, x, y in some])
                    piece, start, count, key, content = segments(own, np.cumsum([0, *(y - x for _, x, y in some)]), width)
                    if len(piece):
                        doc = which[piece]
                        start = start + begin[piece] - bounds[doc]
                        yield batch(schema, [rows_[doc], ids_[doc], key.view(np.int64), content.view(np.int64), start.astype(np.int32), count.astype(np.int32)])

    return texts.where("doc_id is not null").select("doc_id", F.col("text").cast("binary"), "row").mapInArrow(find, SEGMENTS)


def window_names(owned: DataFrame, width: int) -> DataFrame:
    """(row, doc_id, one, two, start) of each window of rows (row, doc_id, text, spans): spans are (start, count)."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("start", pa.int32())])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 64):
            for row, doc, text, spans in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                hashes = words([text])[0], words([text], values=OTHER_VALUES)[0]
                first = np.array([s["start"] for s in spans])
                last = first + np.array([s["count"] for s in spans])  # the window after the last
                order = np.argsort(first, kind="stable")
                first, last = first[order], np.maximum.accumulate(last[order])
                new = np.concatenate(([True], first[1:] > last[:-1]))  # spans that touch are one stretch of windows
                begin, stop = first[new], last[np.append(np.flatnonzero(new)[1:] - 1, len(new) - 1)]
                for x, y in zip(begin.tolist(), stop.tolist(), strict=True):
                    for at in range(x, y, PIECE):
                        end = min(y, at + PIECE)
                        one, two = (rolling(h[at : end + width - 1], width, base).view(np.int64) for h, base in zip(hashes, (BASE, OTHER_BASE), strict=True))
                        yield batch(schema, [np.full(end - at, row), np.full(end - at, doc), one, two, np.arange(at, end, dtype=np.int32)])

    return owned.select("row", "doc_id", F.col("text").cast("binary"), "spans").mapInArrow(name, "row long, doc_id long, one long, two long, start int")


def clean(texts: DataFrame, width: int) -> DataFrame:
    """CLEANED of rows (doc_id, text, spans, extra): spans (start, count) of windows to remove, or null; extra goes along."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = []
            for doc, text, spans in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own = text.encode("utf-8", "replace").split()
                kept = own
                if spans:
                    edge = np.zeros(len(own) + 1, np.int64)
                    for s in spans:
                        edge[s["start"]] += 1
                        edge[s["start"] + s["count"] - 1 + width] -= 1
                    kept = [own[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                joined = b" ".join(kept)
                rows.append((doc, len(own), len(own) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if len(kept) < len(own) else text))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, b.column(3)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "extra"])

    return texts.mapInArrow(cut, f"{CLEANED}, extra {texts.schema['extra'].dataType.simpleString()}")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """CLEANED, and the columns of `keep`, of each row: words under a window of `width` words that also starts in a document with a smaller id are removed.

    kept is the text itself where nothing is removed, else the kept words joined by one space. A
    null text has no words, nor has an empty one. Rows with equal ids are one document: none is the smaller. A row
    without an id is kept whole and is no source for others. An empty table gives no rows.
    """
    spark = prepare(df.sparkSession)
    carried = F.struct(F.lit(0).alias("_"), *(df[c].alias(f"k{i}") for i, c in enumerate(keep)))
    own = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"), carried.alias("extra"))
    full = own.withColumn("row", F.xxhash64("doc_id", "text"))
    texts = full.select("doc_id", "text", "row")
    found = materialize(find_segments(texts, width), "segments")
    # What is grouped by a key is written before it is joined: a key of very many rows is then a skewed join, which Spark splits.
    shared = materialize(found.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key"), "shared")
    candidates = materialize(found.join(shared, "key", "left_semi"), "candidates")
    release(found, shared)
    least = materialize(candidates.groupBy("key", "content").agg(F.min("doc_id").alias("least")), "least")
    judged = candidates.join(least, ["key", "content"]).withColumn("covered", F.col("least") < F.col("doc_id"))
    judged = materialize(judged.select("row", "doc_id", "key", "start", "count", "covered"), "judged")
    release(candidates, least)
    edges = judged.where("not covered").groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key", F.lit(True).alias("edge"))
    edges = materialize(edges, "edges")
    spans = judged.join(edges, "key", "left").where(F.col("covered") | F.col("edge")).groupBy("row", "doc_id").agg(F.collect_set(F.struct("start", "count", "covered")).alias("spans"))
    spans = materialize(spans, "spans")
    release(judged, edges)

    loose = spans.select("row", "doc_id", F.filter("spans", lambda x: ~x["covered"]).alias("spans")).where(F.size("spans") > 0)
    t, s = texts.alias("t"), loose.alias("s")
    owned = t.join(s, (F.col("t.row") == F.col("s.row")) & (F.col("t.doc_id") == F.col("s.doc_id"))).select("t.row", "t.doc_id", "t.text", "s.spans")
    windows = materialize(window_names(owned.dropDuplicates(["row", "doc_id"]), width), "windows")
    firsts = materialize(windows.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"), "firsts")
    late = windows.join(firsts, ["one", "two"]).where("least < doc_id").select("row", "doc_id", F.struct(F.col("start"), F.lit(1).alias("count")).alias("span"))
    certain = spans.select("row", "doc_id", F.explode("spans").alias("s")).where("s.covered").select("row", "doc_id", F.struct("s.start", "s.count").alias("span"))
    gone = materialize(certain.unionByName(late).groupBy("row", "doc_id").agg(F.collect_set("span").alias("spans")), "gone")
    release(spans, windows, firsts)
    t, g = full.alias("t"), gone.alias("g")
    ready = t.join(g, (F.col("t.row") == F.col("g.row")) & F.col("t.doc_id").eqNullSafe(F.col("g.doc_id")), "left").select("t.doc_id", "t.text", "g.spans", "t.extra")
    return clean(ready, width).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept", *(F.col(f"extra.k{i}").alias(c) for i, c in enumerate(keep)))
