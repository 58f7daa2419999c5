"""Tokenising by the tokenizers library with a bounded cache of white-space-delimited chunks.

Both public BPE files cut a text into pieces before they merge, and a cut always lies where white
space begins after another character, and where punctuation follows a letter. So a text may be encoded
chunk by chunk; most chunks repeat and are looked up. A file whose pre-tokeniser isn't one of the two
known kinds is encoded whole.

The second kind of cut is made after ASCII letters and the letters from U+00C0 to U+00FF only: a normaliser
may split others into a letter and a mark, and a mark goes with the punctuation.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

#: The code points that Unicode calls white space, as the tokenisers' \s has them.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LEADING = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
STEM = re.compile(" ?[^\\W\\d_]+")
CACHE_CHUNKS = 900_000
#: ASCII white space, and the beginnings of what else is white space, in UTF-8.
GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
#: Punctuation that begins a chunk after a letter, ASCII letters, and the second bytes of the letters from U+00C0 to U+00FF.
PUNCTUATION, LETTER, LATIN = (np.zeros(256, bool) for _ in range(3))
PUNCTUATION[list(b".,;:!?*$%&#")] = True
LETTER[65:91] = LETTER[97:123] = True
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False  # the signs of multiplication and division
TAILED = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff][.,;:!?*$%&#]")
RARE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
RARE_SPACE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Words joined into one text for the library, whose cost by call is high.
JOINED = 64

_encoders: dict[str, ChunkEncoder] = {}


def distinct_chunks(texts: list[str], tails: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(chunks, index, counts): the distinct chunks of texts, which of them come one after another, and how many in each text.

    Where white space is ASCII, chunks are cut and told apart in arrays; texts with other white space go
    by LEADING. tails: whether punctuation after a letter is a chunk of its own.
    """
    raw = [t.encode() for t in texts]
    slow = [i for i, (t, r) in enumerate(zip(texts, raw, strict=True)) if not t.isascii() and any(x in r for x in RARE) and RARE_SPACE.search(t)]
    odd = dict.fromkeys(slow)
    data = b"".join(b"" if i in odd else r for i, r in enumerate(raw))
    sizes = np.fromiter((0 if i in odd else len(r) for i, r in enumerate(raw)), np.int64, len(raw))
    codes = np.frombuffer(data, np.uint8)
    gap = GAP[codes]
    ends = np.cumsum(sizes)
    first = np.zeros(len(gap), bool)
    first[1:] = gap[1:] & ~gap[:-1]
    if tails:
        letter = LETTER[codes]
        letter[1:] |= (codes[:-1] == 0xC3) & LATIN[codes[1:]]
        first[1:] |= PUNCTUATION[codes[1:]] & letter[:-1]
    first[(ends - sizes)[sizes > 0]] = True
    starts = np.flatnonzero(first)
    places = np.append(starts, len(data)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data)).dictionary_encode()
    chunks, index = found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.searchsorted(starts, ends) - np.searchsorted(starts, ends - sizes)
    if slow:
        parts = np.split(index, np.cumsum(counts)[:-1])
        known = dict(zip(chunks, range(len(chunks)), strict=True))
        for i in slow:
            own = LEADING.findall(texts[i])
            parts[i] = np.array([known.setdefault(c, len(known)) for c in own], np.int64)
            counts[i] = len(own)
        chunks, index = list(known), np.concatenate(parts)
    return chunks, index, counts


class ChunkEncoder:
    """ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.lead: bool | None = None  # pieces hold the space before them; None: a kind that isn't known
        if pre.get("type") == "ByteLevel" and norm is None and not pre.get("add_prefix_space") and pre.get("use_regex", True):
            self.lead = True
        elif pre.get("type") == "Sequence" and norm and {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} in norm.get("normalizers", []) and any(p.get("behavior") == "Removed" and "[^\\s" in (p.get("pattern") or {}).get("Regex", "") for p in pre["pretokenizers"]):
            self.lead = False
        #: No special string has a cut inside.
        self.tails = not any(TAILED.search(t["content"]) for t in spec.get("added_tokens", []))
        if any(re.search(f"[{SPACE}]", t["content"]) or t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])):
            self.lead = None
        self.marks: np.ndarray | None = None
        self.clear()

    @classmethod
    def of(cls, path: str) -> ChunkEncoder:
        """One for each file in a Python worker, kept from task to task."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def clear(self) -> None:
        self.table: dict[str, int] = {}
        self.starts, self.lengths, self.flat = (np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32))
        self.n = self.used = 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in many(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[list[int]]:
        """ids of words of letters, many to a call: each word is one piece, and its first (or last) token shows where it begins (or ends)."""
        lead = self.lead
        if self.marks is None:
            vocab = self.tokenizer.get_vocab(with_added_tokens=False)
            self.marks = np.zeros(max(vocab.values(), default=0) + 1, bool)
            for t, i in vocab.items():
                self.marks[i] = t.startswith("\u0120") if lead else t.endswith("</w>")
        out: list[list[int]] = []
        for at in range(0, len(words), JOINED * 256):
            groups = [words[i : i + JOINED] for i in range(at, min(len(words), at + JOINED * 256), JOINED)]
            for group, ids in zip(groups, self._encode(["".join(g) if lead else " ".join(w.strip() for w in g) for g in groups]), strict=True):
                where = np.flatnonzero(self.marks[ids])
                if len(where) != len(group) or (lead and where[0] != 0) or (not lead and where[-1] != len(ids) - 1):
                    out += self._encode(group)
                else:
                    cuts = [*where.tolist(), len(ids)] if lead else [0, *(where + 1).tolist()]
                    out += [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _put(self, part: list[str], ids: list[list[int]]) -> None:
        self._place(part, np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), np.int32))

    def _place(self, part: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        while self.n + len(part) > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.lengths[self.n : self.n + len(part)] = lengths
        self.starts[self.n : self.n + len(part)] = self.used + np.cumsum(lengths) - lengths
        self.table.update(zip(part, range(self.n, self.n + len(part)), strict=True))
        self.n, self.used = self.n + len(part), self.used + len(ids)

    def _gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of table entries one after another, and where each ends."""
        lengths = self.lengths[index]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.starts[index] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _add(self, chunks: list[str]) -> None:
        """Puts new chunks into the table."""
        words = [c for c in chunks if STEM.fullmatch(c) and (not self.lead or c[0] == " ")]
        self._put(words, self._words(words))
        rest = list(set(chunks).difference(words))
        for at in range(0, len(rest), 20_000):
            self._put(rest[at : at + 20_000], self._encode(rest[at : at + 20_000]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (one more offset than texts)."""
        if self.lead is None:
            ids = self._encode(texts)
            return np.fromiter((i for x in ids for i in x), np.int32), np.cumsum([0, *map(len, ids)])
        chunks, where, counts = distinct_chunks(texts, self.tails)
        if len(self.table) > CACHE_CHUNKS:
            self.clear()
        if new := [c for c in chunks if c not in self.table]:
            self._add(new)
        index = np.fromiter(map(self.table.__getitem__, chunks), np.int64, len(chunks))[where]
        ids, ends = self._gather(index)
        return ids, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
