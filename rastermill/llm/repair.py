"""Token ids in grammar-compressed files: Re-Pair per shard, with random access.

A shard is a run of documents in ascending doc_id order, at most SHARD_IDS ids unless one document
alone is longer. Re-Pair replaces frequent pairs of ids by nonterminals, again and again; each round
takes the most frequent pairs that cannot overlap one another, so that a round is a few array
operations. Pairs never contain a document's end id, so every document starts at a symbol of its
own. Rounds go on until no pair is frequent. Rules and the lengths to which they expand are stored: a document, or a range of its ids, is
decoded without the rest.

The files are Parquet, one row a shard, written and read by Spark: any store works, and a lost
task is redone by Spark's commit protocol. Columns: part, shard (its place), base (ids before it in
its part), n_ids, first_symbol, doc_ids, doc_nulls, doc_at, symbols, rules, expansions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ChunkEncoder
from .common import batch, id_and_text, parts, prepare, slices, write

SHARD_IDS = 1 << 20
END_ID = 2
#: Rules taken in a round, and how often a pair must occur to be worth a rule.
ROUND_RULES = 4096
LEAST = 4
BITS = 18
#: Rounds that look at every place; later ones only at open places.
DENSE = 5

SHARDS = "part long, shard long, base long, n_ids long, first_symbol long, doc_ids binary, doc_nulls binary, doc_at binary, symbols binary, rules binary, expansions binary"


def mixer(k: int) -> np.uint64:
    """An odd multiplier for each round, so that pairs which share a slot once seldom do again."""
    return np.uint64((0x9E3779B97F4A7C15 + 2 * 0x5851F42D4C957F2D * k) & ((1 << 64) - 1))


def counted_pairs(key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stands, counts, slot): the pair (left * 2^32 + right) that stands for each slot, how often it occurs, and each key's slot.

    A pair hidden behind another waits for the next round, which deals the slots anew.
    """
    bits = min(BITS, max(8, len(key).bit_length() + 1))
    slot = ((key.view(np.uint64) * mixer(k)) >> np.uint64(64 - bits)).view(np.int64)
    stands = np.full(1 << bits, -1, np.int64)
    stands[slot] = key
    return stands, np.bincount(slot[stands[slot] == key], minlength=1 << bits), slot


def disjoint_rules(stands: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, slots) of the most frequent pairs of which none ends in a symbol with which another begins."""
    top = np.flatnonzero(counts >= LEAST)
    if len(top) > 2 * ROUND_RULES:
        top = top[np.argpartition(-counts[top], 2 * ROUND_RULES)[: 2 * ROUND_RULES]]
    top = top[np.argsort(-counts[top], kind="stable")]
    left, right, pairs, slots = set(), set(), [], []
    for p, s in zip(stands[top].tolist(), top.tolist(), strict=True):
        x, y = p >> 32, p & 0xFFFFFFFF
        if x in right or y in left or (x == y and x in left):
            continue
        left.add(x)
        right.add(y)
        pairs.append(p)
        slots.append(s)
        if len(pairs) == ROUND_RULES:
            break
    return np.array(pairs, np.int64), np.array(slots, np.int64)


def every_other(at: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Which places in runs of one symbol come second, fourth, ... in their run."""
    start = np.concatenate(([True], follows[:-1] != at[1:]))
    place = np.arange(len(at))
    return np.flatnonzero((place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 1)


def compress(seq: np.ndarray, end_id: int, first_symbol: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule i is the pair that nonterminal first_symbol + i stands for.

    Rounds go on until no pair occurs LEAST times. Only open places are looked at: those whose pair
    may still occur so often. A pair that was counted and is too rare can't become frequent again,
    as replacements only take places from it; new pairs arise at the places of new symbols.
    """
    rules: list[np.ndarray] = [np.zeros(0, np.int64)]
    n_rules = k = 0
    seq = seq.astype(np.int64)
    while k < DENSE and len(seq) > 1:  # at first nearly all places are open, and the gaps are closed in every round
        inside = seq != end_id
        open_ = np.flatnonzero(inside[:-1] & inside[1:])
        key = ((seq[:-1] << 32) | seq[1:])[open_]
        stands, counts, slot = counted_pairs(key, k)
        k += 1
        pairs, slots = disjoint_rules(stands, counts)
        if not len(pairs):
            break
        rule_of = np.full(len(stands), -1, np.int32)
        rule_of[slots] = np.arange(len(pairs))
        hit = np.flatnonzero(rule_of[slot] >= 0)
        hit = hit[stands[slot[hit]] == key[hit]]
        at = open_[hit]
        runs = np.flatnonzero(key[hit] >> 32 == key[hit] & 0xFFFFFFFF)
        if len(runs):
            keep = np.ones(len(at), bool)
            keep[runs[every_other(at[runs], at[runs] + 1)]] = False
            at, hit = at[keep], hit[keep]
        seq[at] = first_symbol + n_rules + rule_of[slot[hit]]
        left = np.ones(len(seq), bool)
        left[at + 1] = False
        seq = seq[left]
        rules.append(pairs)
        n_rules += len(pairs)
    after, before = np.arange(1, len(seq) + 1), np.arange(-1, len(seq) - 1)  # neighbours of places that are left
    open_ = np.flatnonzero((seq[:-1] != end_id) & (seq[1:] != end_id))
    gone = np.zeros(len(seq) + 1, bool)
    while len(open_):
        follows = after[open_]
        first, second = seq[open_], seq[follows]
        key = (first << 32) | second
        stands, counts, slot = counted_pairs(key, k)
        k += 1
        exact = stands[slot] == key
        often = ~exact | (counts[slot] >= LEAST)
        pairs, slots = disjoint_rules(stands, counts)
        if not len(pairs):
            open_ = open_[~exact]
            continue
        rule_of = np.full(len(stands), -1, np.int64)
        rule_of[slots] = np.arange(len(pairs))
        rule = np.where(exact, rule_of[slot], -1)
        hit = rule >= 0
        twin = hit & (first == second)
        if twin.any():  # in a run every other pair counts
            run = np.flatnonzero(twin)
            hit[run[every_other(open_[run], follows[run])]] = False
        at, dropped = open_[hit], follows[hit]
        seq[at] = first_symbol + n_rules + rule[hit]
        gone[dropped] = True
        beyond = after[dropped]
        after[at] = beyond
        inside = beyond < len(seq)
        before[beyond[inside]] = at[inside]
        changed = np.concatenate((at, before[at]))
        stay = np.zeros(len(seq) + 1, bool)  # one more, for the place before the first
        stay[open_[often]] = True
        stay[changed] = True
        stay[-1] = False
        open_ = np.flatnonzero(stay[:-1] & ~gone[:-1])
        open_ = open_[after[open_] < len(seq)]
        open_ = open_[(seq[open_] != end_id) & (seq[after[open_]] != end_id)]
        rules.append(pairs)
        n_rules += len(pairs)
    every = np.concatenate(rules)
    return seq[~gone[:-1]], np.stack((every >> 32, every & 0xFFFFFFFF), 1)


def expand(seq: np.ndarray, rules: np.ndarray, first_symbol: int) -> np.ndarray:
    """The ids that symbols stand for, level by level."""
    while (big := seq >= first_symbol).any():
        out = np.empty(len(seq) + int(big.sum()), np.int64)
        at = np.cumsum(1 + big) - (1 + big)
        out[at] = seq
        pairs = rules[seq[big] - first_symbol]
        out[at[big]], out[at[big] + 1] = pairs[:, 0], pairs[:, 1]
        seq = out
    return seq


def expansions(rules: np.ndarray, first_symbol: int) -> np.ndarray:
    out: list[int] = []
    for x, y in rules.tolist():
        out.append((1 if x < first_symbol else out[x - first_symbol]) + (1 if y < first_symbol else out[y - first_symbol]))
    return np.array(out, np.int64)


class Shard:
    """Random access to one stored shard."""

    def __init__(self, row: dict):
        self.first = row["first_symbol"]
        self.nulls = np.frombuffer(row["doc_nulls"], np.uint8)
        self.doc_ids = [None if z else int(i) for i, z in zip(np.frombuffer(row["doc_ids"], "<i8"), self.nulls, strict=True)]
        self.doc_at = np.frombuffer(row["doc_at"], "<i8")
        self.symbols = np.frombuffer(row["symbols"], "<u4").astype(np.int64)
        self.rules = np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2)
        self.expansions = np.frombuffer(row["expansions"], "<u4").astype(np.int64)

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        big = symbols >= self.first
        out[big] = self.expansions[symbols[big] - self.first]
        return out

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the shard's k-th document; only the symbols that cover them are expanded."""
        own = self.symbols[self.doc_at[k] : self.doc_at[k + 1]]
        ends = np.cumsum(self.lengths(own))
        stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
        lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[lo - 1]) if lo else 0
        return expand(own[lo:hi], self.rules, self.first)[start - before : max(start, stop) - before]

    def documents(self) -> list[np.ndarray]:
        """All documents' ids."""
        lengths = self.lengths(self.symbols)
        reached = np.cumsum(lengths)
        ends = np.concatenate(([0], reached))[self.doc_at]
        # Every rule is expanded once; symbols are then looked up: first the terminals as they are, then what rules stand for.
        big = self.symbols >= self.first
        rule_ids = expand(np.arange(self.first, self.first + len(self.rules)), self.rules, self.first)
        rule_at = np.cumsum(self.expansions) - self.expansions
        ids = np.repeat(self.symbols, lengths)
        own = lengths[big]
        inside = np.repeat(reached[big] - own - (np.cumsum(own) - own), own) + np.arange(own.sum())
        ids[inside] = rule_ids[np.repeat(rule_at[self.symbols[big] - self.first] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def store(parts: list[np.ndarray], doc_ids: list, end_id: int, first_symbol: int) -> dict:
    """A shard's columns from its documents' ids, each with its end id."""
    seq = np.concatenate(parts).astype(np.int64)
    symbols, rules = compress(seq, end_id, first_symbol)
    ends = np.flatnonzero(symbols == end_id)
    if len(ends) != len(parts):  # the end id occurs inside a document too: find the documents by length
        row = {"first_symbol": first_symbol, "doc_ids": b"", "doc_nulls": b"", "doc_at": b"", "symbols": b"", "rules": b"", "expansions": expansions(rules, first_symbol).astype("<u4").tobytes()}
        reached = np.cumsum(Shard(row).lengths(symbols))
        ends = np.searchsorted(reached, np.cumsum([len(p) for p in parts]))
    u4 = lambda x: x.astype("<u4").tobytes()
    return {
        "n_ids": len(seq), "first_symbol": first_symbol, "doc_ids": np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes(), "doc_nulls": np.array([i is None for i in doc_ids], np.uint8).tobytes(),
        "doc_at": np.concatenate(([0], ends + 1)).astype("<i8").tobytes(), "symbols": u4(symbols), "rules": u4(rules.ravel()), "expansions": u4(expansions(rules, first_symbol)),
    }


def write_ids(df: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, ends each document with end_id and writes the shards to path in ascending doc_id order.

    A null or empty text is the end id alone; null ids come first; rows with equal ids follow in the
    order of their texts' hashes, so that they too are dealt over tasks. An empty table writes no shards.
    """
    schema = pa.schema([(n, pa.int64()) for n in ("part", "shard", "base", "n_ids", "first_symbol")] + [(n, pa.binary()) for n in ("doc_ids", "doc_nulls", "doc_at", "symbols", "rules", "expansions")])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(tokenizer_path)
        first_symbol = encoder.tokenizer.get_vocab_size()
        part, shard, base = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        owners: list = []

        def flush() -> pa.RecordBatch:
            nonlocal shard, base, held, owners
            row = {"part": part, "shard": shard, "base": base} | store(held, owners, end_id, first_symbol)
            shard, base, held, owners = shard + 1, base + row["n_ids"], [], []
            return batch(schema, [[row[f.name]] for f in schema])

        size = 0
        for b in parts(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in slices(texts, 1 << 22):
                flat, bounds = encoder.encode(texts[lo:hi])
                for k in range(hi - lo):
                    own = np.append(flat[bounds[k] : bounds[k + 1]], np.int32(end_id))
                    if held and size + len(own) > SHARD_IDS:
                        yield flush()
                        size = 0
                    held.append(own)
                    owners.append(ids[lo + k])
                    size += len(own)
        if held:
            yield flush()

    prepare(df.sparkSession)
    rows = id_and_text(df, id_col, text_col).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    write(ordered.select("doc_id", "text").mapInArrow(encode, SHARDS), path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files; ids: little-endian uint32, or null unless asked for."""
    schema = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):  # rows are whole shards
            for row in b.to_pylist():
                shard, at, rows = Shard(row), row["base"], []
                for doc, ids in zip(shard.doc_ids, shard.documents(), strict=True):
                    raw = ids.astype("<u4").tobytes()
                    rows.append((row["part"], doc, at, len(ids), zlib.crc32(raw), raw if with_ids else None))
                    at += len(ids)
                yield batch(schema, list(zip(*rows, strict=True)))

    prepare(spark)
    stored = spark.read.schema(SHARDS).parquet(path)
    # One row for each part: as many as the range partitioning had partitions, a setting that doesn't grow with the rows.
    totals = sorted(stored.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, starts = 0, []
    for part, n in totals:
        starts.append((part, before))
        before += n
    offsets = spark.createDataFrame(starts, "part long, before long")
    rows = stored.mapInArrow(decode, "part long, doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")
