"""Token operators: ids, counts, packing, grammar files."""

from __future__ import annotations

import time
import unicodedata
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from rastermill.llm import packing, repair, token_counts
from rastermill.llm.chunks import ChunkEncoder
from rastermill.llm.common import scratch
from rastermill.llm.queries import tokenizer


@cache
def library(name: str) -> Tokenizer:
    return Tokenizer.from_file(tokenizer(name))


def ids(name: str, text: str | None) -> list[int]:
    return library(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_equal_whole_texts(name, rows):
    texts = [r[1] or "" for r in rows] + ["\x1c!\x1d a", "Σσς É é ̀x", " " * 50 + "x", "a b c", "it'S we'll 'tis", "A<|endoftext|>B <|startoftext|>"]
    flat, bounds = ChunkEncoder(tokenizer(name)).encode(texts)
    for i, t in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == ids(name, t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_letter_before_punctuation(name):
    """A normaliser may split a letter into a letter and a mark, which goes with the punctuation."""
    letters = [chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c))[0] in "LM"]
    texts = [f"a{c}. b{c}*x" for c in letters]
    encoder = ChunkEncoder(tokenizer(name))
    want = [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 50_000):
        flat, bounds = encoder.encode(texts[at : at + 50_000])
        for i, own in enumerate(want[at : at + 50_000]):
            assert flat[bounds[i] : bounds[i + 1]].tolist() == own, texts[at + i]


ODD = ["don't", "we'll've", "'ll", "''ll'", "a'lle're", "x\n\n  y", "\n\nIt's", "  \t z'", "a<|endoftext|>b'll", "<|endoftext|", "<|endoftext|><|endoftext|>'s", "\u3000\u2003wide", "d\xe9j\xe0'vu.., 12'34", "e\u0301'll", "\x1c'\x1d", "1'000'000.5%", "\U0001f600'll\U0001f600", "   ", "a  <|endoftext|>  b"]


@pytest.mark.parametrize("text", ODD)
def test_prefixes_of_odd_chunks(text):
    counter = token_counts.PrefixCounter(tokenizer("byte_bpe_50k.json"))
    want = [len(ids("byte_bpe_50k.json", text[: k + 1])) for k in range(len(text))]
    assert counter.prefixes([text])[0].tolist() == want
    for chunk in text.split(" "):
        if chunk:  # the way that takes one pass has to be right by itself, without the library's help
            assert counter.stretch(chunk.replace("<|endoftext|>", "")) == [len(ids("byte_bpe_50k.json", chunk.replace("<|endoftext|>", "")[: k + 1])) for k in range(len(chunk.replace("<|endoftext|>", "")))]


def test_long_chunks_take_linear_time():
    counter = token_counts.PrefixCounter(tokenizer("byte_bpe_50k.json"))
    word = "ab'cd" * 40_000
    counter.encoder.tokenizer.encode(word)
    began = time.perf_counter()
    counts = counter.prefixes([word, word + "<|endoftext|>" + word[:999]])
    assert time.perf_counter() - began < 60
    assert counts[0][-1] == len(ids("byte_bpe_50k.json", word))
    assert counts[1][-1] == len(ids("byte_bpe_50k.json", word + "<|endoftext|>" + word[:999]))


def test_prefix_counts(spark, docs, rows):
    got = token_counts.prefix_token_counts(docs, tokenizer("byte_bpe_50k.json"), budget=20).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((i is None, i or 0, len(ids("byte_bpe_50k.json", t))) for i, t, *_ in rows)
    texts = {i: t or "" for i, t, *_ in rows}
    for r in got:
        text, counts = texts[r["doc_id"]], np.frombuffer(r["prefix_counts"], "<i4")
        assert r["n_bytes"] == len(text.encode())
        assert len(counts) == len(text)
        for k in range(1, min(len(text), 120) + 1):
            assert counts[k - 1] == len(ids("byte_bpe_50k.json", text[:k]))
        assert r["fit_chars"] == max([k + 1 for k in range(len(counts)) if counts[k] <= 20], default=0)
    assert token_counts.prefix_token_counts(docs.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0


def test_packing(spark, docs, rows):
    got = packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), capacity=256, with_ids=True)
    kept = got.collect()
    want = sorted((i is None, i or 0, tuple([*ids("byte_bpe_50k.json", t), 1])) for i, t, *_ in rows)
    parts = defaultdict(list)
    for r in kept:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        assert r["length"] == len(r["ids"]) // 4 <= 256
        parts[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
    for i, t, *_ in rows:
        if i == 10:
            continue  # a repeated row: its pieces come twice
        own = sorted(parts[i])
        assert [x for _, p, _ in own for x in p] == [*ids("byte_bpe_50k.json", t), 1]
        assert {n for *_, n in own} == {sum(len(p) for _, p, _ in own)}
    assert len(want) == len(rows)
    spans = defaultdict(list)
    for r in kept:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in spans.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 256
    full = packing.sequences(got, capacity=256).collect()
    assert all(len(r["ids"]) == 1024 for r in full)
    assert sum(r["used"] for r in full) == sum(len(w[2]) for w in want)
    assert packing.pack_documents(docs.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0


def test_first_fit_decreasing_equals_plain():
    lengths = np.random.default_rng(1).integers(1, 101, 500)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(100)
        assert (bins[i], offsets[i]) == (k, 100 - room[k])
        room[k] -= lengths[i]


def test_grammar_files(spark, docs, rows, monkeypatch):
    path = scratch(spark, "ids")
    repair.write_ids(docs, path, tokenizer("word_bpe_49k.json"))
    got = repair.read_ids(spark, path).orderBy("start").collect()
    want = sorted(((i is not None, i or 0, t or "") for i, t, *_ in rows))  # rows with equal ids have equal texts here
    at = 0
    for r, (_, i, t) in zip(got, want, strict=True):
        own = [*ids("word_bpe_49k.json", t), 2]
        assert (r["doc_id"] or 0, r["start"], r["n_tokens"]) == (i, at, len(own))
        assert np.frombuffer(r["ids"], "<u4").tolist() == own
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        at += len(own)
    empty = scratch(spark, "ids")
    repair.write_ids(docs.limit(0), empty, tokenizer("word_bpe_49k.json"))
    assert repair.read_ids(spark, empty).count() == 0


@pytest.mark.parametrize("seq", [[7] * 50 + [2], [2], [5, 2, 5, 2, 2], list(range(3, 20)) * 9 + [2], [4, 4, 4, 5, 4, 4, 4, 5, 4, 4, 4, 5, 4, 4, 4, 5, 2]])
def test_grammar_round_trip_and_random_access(seq):
    row = repair.store([np.array(seq)], [None], 2, 100)
    shard = repair.Shard(row)
    assert shard.documents()[0].tolist() == seq
    for a in range(len(seq)):
        for b in range(a, len(seq) + 1, 3):
            assert shard.document(0, a, b).tolist() == seq[a:b]
    assert len(row["symbols"]) <= 4 * len(seq)


def test_grammar_goes_on_to_the_end():
    r = np.random.default_rng(4)
    words = [r.integers(5, 300, r.integers(2, 9)) for _ in range(200)]
    seq = np.concatenate([np.append(np.concatenate([words[i] for i in r.integers(0, 200, 60)]), 2) for _ in range(150)] + [np.full(777, 9), np.array([2])])
    symbols, rules = repair.compress(seq, 2, 1000)
    assert (repair.expand(symbols, rules, 1000) == seq).all()
    left: dict[tuple, int] = {}
    before = None
    for k, pair in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True)):
        if 2 not in pair and not (pair[0] == pair[1] and before == (pair, k - 1)):
            left[pair] = left.get(pair, 0) + 1
            before = (pair, k)
    assert max(left.values()) < repair.LEAST
    assert len(np.unique(rules, axis=0)) == len(rules)
    assert 2 not in rules
