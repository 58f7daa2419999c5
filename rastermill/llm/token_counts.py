"""Exact token counts of every prefix by dynamic programming.

For byte-level BPE the last token of a prefix's encoding is the only vocabulary entry that ends
there and may follow the last token of the prefix before it ("may follow": the two bytes strings
joined encode as just these two). So last[i] and count[i] = count[i - len(last[i])] + 1 are filled
from left to right, and the count of each prefix is read off. Pieces are independent, so a
document's counts are its chunks' counts, cached, plus the count of all chunks before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunks import ChunkEncoder, distinct_chunks
from .common import batch, id_and_text, parts, prepare, slices

#: White space, and the contractions of three characters that are pieces of their own.
BLANKS = {*map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))}
CONTRACTED = {"'ll", "'ve", "'re"}
#: A word of Latin letters, with or without a space before and punctuation after; here the pieces are the same for every version of Unicode.
SIMPLE = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?*$%&#|]*)")
LIMIT = 512
CACHE_CHUNKS = 500_000

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("fit_chars", T.LongType()), T.StructField("prefix_counts", T.BinaryType())])

_counters: dict[str, PrefixCounter] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else 256 and on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class PrefixCounter:
    """Counts for a byte-level BPE file without normaliser."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = {c: b for b, c in enumerate(byte_symbols())}
        decode = lambda s: bytes(back[c] for c in s)
        plain = {t: i for t, i in model["vocab"].items() if all(c in back for c in t)}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(decode(a), decode(b)): r for r, (a, b) in enumerate(merges)}
        whole = {a + b for a, b in self.rank} | {bytes([b]) for b in range(256)}
        self.tokens = [b for t in plain if (b := decode(t)) in whole]
        self.vocab = {b: i for i, b in enumerate(self.tokens)}
        self.longest = max(map(len, self.vocab))
        self.follows: dict[int, bool] = {}
        self.encoder = ChunkEncoder(path)
        added = sorted((t.content for t in self.encoder.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.clear()

    @classmethod
    def of(cls, path: str) -> PrefixCounter:
        if path not in _counters:
            _counters[path] = cls(path)
        return _counters[path]

    def clear(self) -> None:
        self.table: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(1 << 16, np.int32), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.n = self.used = 0

    def merge(self, data: bytes) -> list[bytes]:
        """Plain BPE, for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        ok = self.follows.get(a << 20 | b)
        if ok is None:
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            x, y = self.tokens[a], self.tokens[b]
            ok = self.follows[a << 20 | b] = self.merge(x + y) == [x, y]
        return ok

    def extend(self, data: bytes, counts: list[int], last: list[int]) -> None:
        """Fills counts and last tokens up to the end of data, from where they stop."""
        vocab, follows = self.vocab, self.follows
        for i in range(len(counts), len(data) + 1):
            for j in range(i - 1, max(-1, i - 1 - self.longest), -1):
                t = vocab.get(data[j:i])
                if t is None:
                    continue
                if j:
                    ok = follows.get(last[j] << 20 | t)
                    if not (self.may_follow(last[j], t) if ok is None else ok):
                        continue
                counts.append(counts[j] + 1)
                last.append(t)
                break
            else:
                raise ValueError("no token ends here; the vocabulary lacks a byte")

    def piece(self, data: bytes) -> list[int]:
        """counts[i]: tokens of data[:i]."""
        counts, last = [0], [0]
        self.extend(data, counts, last)
        return counts

    def chars(self, piece: str) -> list[int]:
        """Tokens of each prefix of a piece, for 1 character and on."""
        counts = self.piece(piece.encode())
        if piece.isascii():
            return counts[1:]
        ends = np.cumsum([len(c.encode()) for c in piece])
        return [counts[e] for e in ends]

    def stretch(self, text: str) -> list[int]:
        """Tokens of each prefix of a text without special strings, in one pass over its pieces.

        A prefix that ends within a piece has the pieces before it and its own part of that piece, which
        is one piece too; but white space at a prefix's end is one piece however it is cut in the
        whole text, and a contraction of three characters is none before its last.
        """
        out: list[int] = []
        base = 0  # tokens of the pieces before this one
        blank: list[int] = []  # prefix counts of the run of white space that we are in
        run = blank_at = blank_base = 0
        for _, (lo, hi) in self.encoder.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            own = text[lo:hi]
            if lo >= run and own[0] in BLANKS:
                run = lo
                while run < len(text) and text[run] in BLANKS:
                    run += 1
                blank, blank_at, blank_base = self.chars(text[lo:run]), lo, base
            counts = self.chars(own)
            shown = [base + c for c in counts]
            if own in CONTRACTED:
                shown[1] = base + counts[0] + self.chars(own[1])[0]
            for k in range(min(len(own), run - lo) if lo < run else 0):
                shown[k] = blank_base + blank[lo - blank_at + k]
            out += shown
            base += counts[-1]
        return out

    def chunk(self, chunk: str, whole: int) -> list[int]:
        """Tokens of each prefix of a chunk. whole: the library's count, which the last must equal; else the library counts each prefix."""
        out: list[int] = []
        at = base = 0
        for m in self.special.finditer(chunk) if self.special else ():
            before = self.stretch(chunk[at : m.end() - 1])
            out += [base + c for c in before]
            base += (before[m.start() - at - 1] if m.start() > at else 0) + 1
            out.append(base)
            at = m.end()
        out += [base + c for c in self.stretch(chunk[at:])]
        if len(out) != len(chunk) or out[-1] != whole:
            out = [len(x) for x in self.encoder._encode([chunk[:k] for k in range(1, len(chunk) + 1)])]
        return out

    def words(self, words: list[str]) -> dict[str, list[int]]:
        """chars() of many pieces in order of their bytes, so that a piece goes on from what it shares with the one before."""
        out, counts, last, before = {}, [0], [0], b""
        for raw, word in sorted((w.encode(), w) for w in words):
            n = min(len(raw), len(before))
            while raw[:n] != before[:n]:
                n -= 1
            del counts[n + 1 :], last[n + 1 :]
            self.extend(raw, counts, last)
            before = raw
            if len(raw) == len(word):
                out[word] = counts[1:]
            else:
                out[word] = [counts[i] for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]
        return out

    def _add(self, chunks: list[str]) -> None:
        known: dict[str, list[int]] = {}
        cut, rest, tails = {}, [], {}
        for c in chunks:
            if m := SIMPLE.fullmatch(c):
                cut[c] = m.groups()
            else:
                rest.append(c)
        whole = dict(zip(rest, map(len, self.encoder._encode(rest)), strict=True)) if rest else {}
        stems = self.words(list({w for w, _ in cut.values()}))
        for c, (w, t) in cut.items():
            if not t:
                known[c] = stems[w]
            else:
                if t not in tails:
                    tails[t] = self.chars(t)
                n = stems[w][-1]
                known[c] = stems[w] + [n + k for k in tails[t]]
        for c, n in whole.items():
            known[c] = self.chunk(c, n)
        lengths = np.fromiter(map(len, known.values()), np.int64, len(known))
        total = int(lengths.sum())
        while self.n + len(known) > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(known.values()), np.int32, total)
        self.lengths[self.n : self.n + len(known)] = lengths
        self.starts[self.n : self.n + len(known)] = self.used + np.cumsum(lengths) - lengths
        self.table.update(zip(known, range(self.n, self.n + len(known)), strict=True))
        self.n, self.used = self.n + len(known), self.used + total

    def prefixes(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the token counts of its prefixes of 1, 2, ... characters."""
        if not texts:
            return []
        chunks, where, per = distinct_chunks(texts, self.encoder.tails)
        if len(self.table) > CACHE_CHUNKS:
            self.clear()
        if new := [c for c in chunks if c not in self.table]:
            self._add(new)
        index = np.fromiter(map(self.table.__getitem__, chunks), np.int64, len(chunks))[where]
        lengths, starts = self.lengths[index], self.starts[index]
        ends = np.cumsum(lengths)
        own = self.flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        totals = self.flat[starts + lengths - 1].astype(np.int64)
        first = np.concatenate(([0], np.cumsum(per)))  # each text's first chunk
        before = np.cumsum(totals) - totals
        at_text = np.append(before, totals.sum())[first[:-1]]
        before -= np.repeat(at_text, np.diff(first))
        counts = (own + np.repeat(before, lengths)).astype(np.int32)
        return np.split(counts, np.concatenate(([0], ends))[first[1:-1]])


def fitting(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most so many tokens (counts may fall as a prefix grows)."""
    fit = np.flatnonzero(counts <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0


def prefix_token_counts(df: DataFrame, tokenizer_path: str, budget: int = LIMIT, keep: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, fit_chars, prefix_counts) for each row.

    prefix_counts holds little-endian int32 counts of the prefixes of 1, 2, ... characters (null
    unless keep); n_tokens is the last of them, fit_chars the longest prefix within the budget. A
    null text counts as empty: 0 tokens, no prefixes. Rows with equal ids are counted each.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("fit_chars", pa.int64()), ("prefix_counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter.of(tokenizer_path)
        for b in parts(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in slices(texts, 1 << 22):
                found = counter.prefixes(texts[lo:hi])
                yield batch(schema, [ids[lo:hi], [len(t.encode()) for t in texts[lo:hi]], [int(c[-1]) if len(c) else 0 for c in found], [fitting(c, budget) for c in found], [c.astype("<i4").tobytes() if keep else None for c in found]])

    prepare(df.sparkSession)
    return id_and_text(df, id_col, text_col).mapInArrow(count, SCHEMA)
