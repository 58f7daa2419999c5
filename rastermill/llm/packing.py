"""Packing tokenised documents into sequences: first-fit decreasing over a tournament tree.

Documents are dealt at random, but repeatably, into groups of about GROUP documents; a group is
packed on its own, so groups are independent tasks of bounded size and no key can be hot. A
document's ids are cut every `capacity` ids; full pieces fill a sequence each, the rest is placed
by first-fit decreasing. A tournament tree over the bins' free space finds the first bin that fits
in logarithmic time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import ChunkEncoder
from .common import batch, id_and_text, parts, prepare, slices

CAPACITY = 2048
#: Documents in a group, on average.
GROUP = 4096

PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


class Tournament:
    """Free space of n bins; the root knows the most, so the first bin with room is found by one descent."""

    def __init__(self, n: int, capacity: int):
        self.size = 1 << max(0, n - 1).bit_length()
        self.tree = [capacity] * (2 * self.size)

    def place(self, need: int) -> tuple[int, int]:
        """The first bin with so much room, and the room it had."""
        tree, at = self.tree, 1
        while at < self.size:
            at *= 2
            if tree[at] < need:
                at += 1
        room = tree[at]
        bin_, tree[at] = at - self.size, room - need
        while at > 1:
            at //= 2
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
        return bin_, room


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to capacity); ties keep the given order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = Tournament(len(lengths), capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i], room = tree.place(int(lengths[i]))
        offsets[i] = capacity - room
    return bins, offsets


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cuts each document's ids (with end_id) every `capacity` ids. ids: little-endian uint32, or null unless asked for.

    A null or empty text has the end id alone. Repeated rows are documents of their own.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(tokenizer_path)
        for b in parts(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in slices(texts, 1 << 22):
                flat, bounds = encoder.encode(texts[lo:hi])
                rows = []
                for k in range(hi - lo):
                    raw = np.append(flat[bounds[k] : bounds[k + 1]], end_id).astype("<u4").tobytes()
                    n = len(raw) // 4
                    for s in range(0, n, capacity):
                        part = raw[4 * s : 4 * (s + capacity)]
                        rows.append((ids[lo + k], s, len(part) // 4, zlib.crc32(part), n, part if with_ids else None))
                yield batch(schema, list(zip(*rows, strict=True)))

    prepare(df.sparkSession)
    return id_and_text(df, id_col, text_col).mapInArrow(cut, PIECES)


def pack(cut: DataFrame, documents: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces(). documents: how many there are, for the number of groups.

    The group comes from a hash of the document's id and its number of tokens, so reruns agree; rows that
    agree in both, such as repeated ones, share a group, and those equal in all columns are interchangeable. Sequence ids are group * 2^32 + bin; each is filled from offset 0
    without gaps. No pieces give no rows.
    """
    groups = max(1, -(-documents // group))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32", "doc_tokens"], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=pdf["grp"].to_numpy(np.int64) * (1 << 32) + bins, offset=offsets).drop(columns="grp")

    seed = F.xxhash64(F.lit(17), "doc_id", "doc_tokens")
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return cut.withColumn("grp", F.pmod(seed, F.lit(groups))).groupBy("grp").applyInPandas(place, schema)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """The padded sequences of pack() over pieces(with_ids=True): (sequence_id, used, ids), ids of 4 * capacity bytes."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    pad = pad_id.to_bytes(4, "little") * capacity
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), joined.alias("ids")).withColumn("ids", F.substring(F.concat("ids", F.lit(pad)), 1, 4 * capacity))


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """pieces() and pack() over whole documents: null and empty texts have the end id alone, repeated rows are packed each, an empty table gives no rows."""
    return pack(pieces(df, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), df.select(id_col).count(), capacity)
