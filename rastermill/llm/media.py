"""Media columns stored as content-defined chunks.

A rolling gear hash over the last WINDOW bytes cuts a payload where its top bits are zero, so equal
passages give equal chunks wherever they stand. Chunks are named by their SHA-256 digests; Spark
joins on digests find one owner for each, and only owners store the bytes. A payload's stored form
is its manifest: the ordered list of lengths and digests, a column of the store. Reading back parses
what was stored, gathers the chunks in order and verifies every digest and the payload's own.

Most payloads share nothing. A Bloom filter of fixed size, over the digests of what is shared, tells
them: a payload that it doesn't know is written where it is read. What it may know is moved once,
compressed, and joined exactly with what other payloads own; a filter that fills up at scale sends more
that way, and changes no result. After that only chunks that several payloads share are shuffled,
each once, however many hold them. Equal payloads are stored once and reconstructed once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, materialize, parts, prepare, release, remove, scratch, write

UNIT = 64
WINDOW = 32
#: Cut where so many top bits are zero; no chunk under LEAST (but the last), none over MOST bytes.
CUT_BITS = 10
LEAST, MOST = 256, 8192
DIGEST = 32
#: Random values for the 256 byte values, from a seeded generator.
GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint32)

#: Bits of the Bloom filter (a power of two) and how many of them a digest sets.
FILTER_BITS, FILTER_HASHES = 1 << 26, 4
MAGIC = b"CDC1"

MANIFEST = "doc_id long, n_bytes long, payload_sha binary, digests binary, lengths binary"
STORED = "payload_sha binary, form binary, owned binary, shared binary, bytes binary"
READ = "payload_sha binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of UNIT."""
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def gear_hashes(data: bytes) -> np.ndarray:
    """At each byte the gear hash of the WINDOW bytes that end there, by doubling."""
    h, n = GEAR[np.frombuffer(data, np.uint8)], 1
    while n < WINDOW:
        older = np.zeros_like(h)
        older[n:] = h[:-n] << np.uint32(n)
        h = h + older
        n *= 2
    return h


def cut(data: bytes) -> list[int]:
    """Where the chunks end."""
    at, ends, start = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - CUT_BITS) == 0) + 1, [], 0
    for end in [*at.tolist(), len(data)]:
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end - start >= LEAST or (end == len(data) and end > start):
            start = end
            ends.append(end)
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cut(data)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def manifest(digests: list[bytes], lengths: list[int]) -> bytes:
    """The stored form: a magic number, the count of chunks, their lengths (little-endian uint32) and digests."""
    return MAGIC + len(lengths).to_bytes(4, "little") + np.array(lengths, "<u4").tobytes() + b"".join(digests)


def parsed(form: bytes) -> tuple[list[bytes], list[int]]:
    """Digests and lengths of a stored form."""
    n = int.from_bytes(form[4:8], "little")
    if form[:4] != MAGIC or len(form) != 8 + (4 + DIGEST) * n:
        raise ValueError("a stored manifest is damaged")
    at = 8 + 4 * n
    return [form[at + DIGEST * k : at + DIGEST * (k + 1)] for k in range(n)], np.frombuffer(form[8:at], "<u4").tolist()


def described(payload: bytes, form: bytes, expected: bytes) -> tuple:
    """A READ row from reconstructed bytes; raises if they aren't what was stored."""
    sha = hashlib.sha256(payload)
    if sha.digest() != expected:
        raise ValueError("a reconstructed payload differs from what was stored")
    data = np.frombuffer(payload, np.uint8)
    low = data < 96
    counts = np.bincount(data, minlength=256)
    mean, square = float(counts @ np.arange(256)) / len(data), float(counts @ np.arange(256) ** 2) / len(data)
    feature = f"chunks={(len(form) - 8) // (4 + DIGEST)};mean={mean:.4f};rms={np.sqrt(square):.4f};peak={int(data.max())};turns={int(np.count_nonzero(low[1:] != low[:-1]))}"
    return expected, len(payload), sha.hexdigest(), zlib.crc32(payload[-UNIT:]), len(form), hashlib.sha256(form).hexdigest(), feature


def payloads(df: DataFrame, payload_col: str | Column, id_col: str) -> DataFrame:
    col = df[payload_col] if isinstance(payload_col, str) else payload_col
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(col.cast("binary"), F.lit(b"")).alias("raw"))


def manifests(df: DataFrame, payload_col: str | Column, id_col: str = "doc_id") -> DataFrame:
    """MANIFEST of each row: its payload's digest, and its chunks' digests and lengths in order."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), *((n, pa.binary()) for n in ("payload_sha", "digests", "lengths"))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = padded(raw)
                pieces = chunks(data)
                rows.append((doc, len(raw), hashlib.sha256(data).digest(), b"".join(hashlib.sha256(p).digest() for p in pieces), np.array([len(p) for p in pieces], "<u4").tobytes()))
            if rows:
                yield batch(schema, list(zip(*rows, strict=True)))

    return payloads(df, payload_col, id_col).mapInArrow(make, MANIFEST)


def exploded(manifest_rows: DataFrame) -> DataFrame:
    """(payload_sha, seq, digest) of each chunk."""
    count = (F.length("digests") / DIGEST).cast("int")
    seqs = manifest_rows.select("payload_sha", "digests", F.explode(F.sequence(F.lit(0), count - 1)).alias("seq"))
    return seqs.select("payload_sha", "seq", F.substring(F.col("digests"), F.col("seq") * DIGEST + 1, F.lit(DIGEST)).alias("digest"))


def places(digest: bytes) -> list[int]:
    """The filter's bits of a digest, which is random already."""
    return [int.from_bytes(digest[8 * k : 8 * k + 8], "little") & (FILTER_BITS - 1) for k in range(FILTER_HASHES)]


def filter_of(digests: DataFrame) -> np.ndarray:
    """The Bloom filter of a column of digests: FILTER_BITS / 8 bytes, however many digests there are."""
    schema = pa.schema([("at", pa.int64()), ("word", pa.int64())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(FILTER_BITS // 64, np.uint64)
        for b in parts(batches):
            for digest in b.column(0).to_pylist():
                for p in places(digest):
                    own[p >> 6] |= np.uint64(1 << (p & 63))
        at = np.flatnonzero(own)
        if len(at):
            yield batch(schema, [at, own[at].view(np.int64)])

    rows = digests.mapInArrow(fill, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out.view(np.uint64)


def may_share(bits: np.ndarray, sha: bytes, digests: list[bytes]) -> bool:
    """Whether the filter knows the payload or one of its chunks."""
    return any(all(int(bits[p >> 6]) >> (p & 63) & 1 for p in places(d)) for d in (sha, *digests))


def write_media(df: DataFrame, payload_col: str | Column, path: str, id_col: str = "doc_id") -> DataFrame:
    """Writes each distinct payload's manifest and the chunks that it owns to path; returns the rows' (doc_id, n_bytes, payload_sha).

    A null payload is empty. Payloads are padded with zeros to a positive multiple of 64 bytes. Rows
    with equal payloads share one stored row; an empty table writes none.
    """
    spark = prepare(df.sparkSession)
    listed = materialize(manifests(df, payload_col, id_col), "manifests")
    first = F.min_by("doc_id", F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), "n_bytes"))
    keepers = materialize(listed.groupBy("payload_sha").agg(first.alias("doc_id"), F.count("*").alias("rows")), "keepers")
    distinct = exploded(listed.select("payload_sha", "digests").dropDuplicates(["payload_sha"]))
    owners = distinct.groupBy("digest").agg(F.min(F.struct("payload_sha", "seq")).alias("owner"), F.count("*").alias("held"))
    owners = materialize(owners.where("held > 1").select("digest", "owner"), "owners")
    # The owner stores a chunk; a payload that has one twice refers to its first.
    mine = (F.col("payload_sha") == F.col("owner.payload_sha")) & (F.col("seq") == F.col("owner.seq"))
    notes = distinct.join(owners, "digest").select("payload_sha", "seq", mine.alias("mine")).groupBy("payload_sha").agg(F.sort_array(F.collect_list(F.struct("seq", "mine"))).alias("notes"))
    plan = materialize(keepers.join(notes, "payload_sha", "left").select("doc_id", "payload_sha", "notes.seq", "notes.mine"), "plan")
    known = spark.sparkContext.broadcast(filter_of(owners.select("digest").unionAll(keepers.where("rows > 1").select("payload_sha"))))
    release(owners, keepers)

    sent = pa.schema([("doc_id", pa.int64()), ("payload_sha", pa.binary()), ("packed", pa.binary())])
    out = pa.schema([(n, pa.binary()) for n in ("payload_sha", "form", "owned", "shared", "bytes")])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in parts(batches):
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = padded(raw)
                pieces = chunks(data)
                digests = [hashlib.sha256(p).digest() for p in pieces]
                yield doc, data, hashlib.sha256(data).digest(), pieces, digests

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, bits = [], 0, known.value
        for _, data, sha, pieces, digests in cut_up(batches):
            if not may_share(bits, sha, digests):
                rows.append((sha, manifest(digests, [len(p) for p in pieces]), b"\1" * len(pieces), b"\0" * len(pieces), data))
                size += len(data)
                if size > 1 << 22:
                    yield batch(out, list(zip(*rows, strict=True)))
                    rows, size = [], 0
        if rows:
            yield batch(out, list(zip(*rows, strict=True)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        rows, size, bits = [], 0, known.value
        for doc, data, sha, _, digests in cut_up(batches):
            if may_share(bits, sha, digests):
                rows.append((doc, sha, squeeze(data)))
                size += len(rows[-1][2])
                if size > 1 << 22:
                    yield batch(sent, list(zip(*rows, strict=True)))
                    rows, size = [], 0
        if rows:
            yield batch(sent, list(zip(*rows, strict=True)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, done = zstandard.ZstdDecompressor().decompress, b""
        for b in parts(batches):
            rows = []
            for sha, packed, seqs, mine in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if sha == done:  # a repeated row
                    continue
                done, pieces = sha, chunks(expand(packed))
                owned, shared = np.ones(len(pieces), np.uint8), np.zeros(len(pieces), np.uint8)
                if seqs:
                    owned[seqs] = np.array(mine, np.uint8)
                    shared[seqs] = np.array(mine, np.uint8)
                form = manifest([hashlib.sha256(p).digest() for p in pieces], [len(p) for p in pieces])
                rows.append((sha, form, owned.tobytes(), shared.tobytes(), b"".join(p for p, o in zip(pieces, owned, strict=True) if o)))
            if rows:
                yield batch(out, list(zip(*rows, strict=True)))

    loads = payloads(df, payload_col, id_col)
    a, p = loads.mapInArrow(send, "doc_id long, payload_sha binary, packed binary").alias("a"), plan.alias("p")
    joined = a.join(p, F.col("a.payload_sha").eqNullSafe(F.col("p.payload_sha")) & F.col("a.doc_id").eqNullSafe(F.col("p.doc_id")))
    joined = joined.select(F.col("a.payload_sha"), "packed", F.col("p.seq"), F.col("p.mine")).sortWithinPartitions("payload_sha")
    write(joined.mapInArrow(keep, STORED), path)
    write(loads.mapInArrow(direct, STORED), path, "append")
    release(plan)
    return listed.select("doc_id", "n_bytes", "payload_sha")


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """READ of each stored payload, from bytes put together again and verified."""
    prepare(spark)
    stored = spark.read.schema(STORED).parquet(path)
    whole = pa.schema([("payload_sha", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    piece = pa.schema([("payload_sha", pa.binary()), ("seq", pa.int32()), ("digest", pa.binary()), ("bytes", pa.binary())])
    absent = pa.schema([("payload_sha", pa.binary()), ("seq", pa.int32()), ("digest", pa.binary())])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = []
            for sha, form, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if [hashlib.sha256(x).digest() for _, _, x in split(form, b"\1" * len(data), data)] != parsed(form)[0]:
                    raise ValueError("a stored chunk is damaged")
                rows.append(described(data, form, sha))
            yield batch(whole, list(zip(*rows, strict=True)))

    def own(shared_only: bool):
        def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts(batches):
                rows = []
                for sha, form, owned, shared, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    rows += [(sha, k, d, x) for k, d, x in split(form, owned, data) if not shared_only or shared[k]]
                if rows:
                    yield batch(piece, list(zip(*rows, strict=True)))

        return give

    def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = [(sha, k, d) for sha, form, owned in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for k, d in enumerate(parsed(form)[0]) if not owned[k]]
            if rows:
                yield batch(absent, list(zip(*rows, strict=True)))

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        form = pdf[pdf["seq"] < 0].iloc[0]["bytes"]
        rest = pdf[pdf["seq"] >= 0].drop_duplicates("seq").sort_values("seq")
        if [hashlib.sha256(x).digest() for x in rest["bytes"]] != parsed(form)[0]:
            raise ValueError("a stored chunk is missing or damaged")
        return pd.DataFrame([described(b"".join(rest["bytes"]), form, key[0])], columns=[f.name for f in whole])

    complete = ~F.col("owned").contains(F.lit(b"\0"))
    direct = stored.where(complete).select("payload_sha", "form", "bytes").mapInArrow(alone, READ)
    partial = stored.where(~complete)
    pieces = "payload_sha binary, seq int, digest binary, bytes binary"
    lent = stored.where(F.col("shared").contains(F.lit(b"\1"))).mapInArrow(own(True), pieces).select("digest", "bytes")
    got = partial.select("payload_sha", "form", "owned").mapInArrow(lacking, "payload_sha binary, seq int, digest binary").join(lent, "digest").select("payload_sha", "seq", "bytes")
    have = partial.mapInArrow(own(False), pieces).select("payload_sha", "seq", "bytes")
    forms = partial.select("payload_sha", F.lit(-1).alias("seq"), F.col("form").alias("bytes"))
    rebuilt = got.unionByName(have).unionByName(forms).groupBy("payload_sha").applyInPandas(join, READ)
    return direct.unionByName(rebuilt)


def split(form: bytes, owned: bytes, data: bytes) -> list[tuple[int, bytes, bytes]]:
    """(seq, digest, bytes) of a stored row's own chunks."""
    out, at = [], 0
    for k, (d, n) in enumerate(zip(*parsed(form), strict=True)):
        if owned[k]:
            out.append((k, d, data[at : at + n]))
            at += n
    return out


def store_and_describe(df: DataFrame, payload_col: str | Column, id_col: str = "doc_id") -> DataFrame:
    """For each row what read_media() says of its payload: (doc_id, n_bytes, payload_bytes, payload_sha256, ...)."""
    path = scratch(df.sparkSession, "media")
    listed = write_media(df, payload_col, path, id_col)
    read = materialize(read_media(df.sparkSession, path).dropDuplicates(["payload_sha"]), "media-read")
    remove(df.sparkSession, path)
    return listed.join(read, "payload_sha").select("doc_id", "n_bytes", *(c for c in read.columns if c != "payload_sha"))
