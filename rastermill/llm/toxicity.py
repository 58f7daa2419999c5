"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

The n-grams are of SIZES characters of the lower-cased text, each named by a 64-bit hash of its
code points. On a bounded sample of labelled rows, Spark counts in how many texts of each class an
n-gram occurs; the FEATURES with the largest chi-square statistics are kept. A text's feature is
its n-gram's log-count ratio where the n-gram is present, else 0, and a regularised logistic
regression weighs them. Scoring looks up every n-gram of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, crc_mod, id_and_text, materialize, parts, prepare, release
from .words import distinct

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
SIZES = (3, 4, 5, 6)
#: Labelled rows of each class to learn from, at most: those with the lowest hashes of their ids.
SAMPLE_ROWS = 4096
FEATURES = 2048
RIDGE = 1.0

BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
WHITE = str.maketrans("\t\n\v\f\r", "     ")


def ngrams(text: str) -> Iterator[np.ndarray]:
    """For each size the names of a text's n-grams, with a space before and after it."""
    codes = np.frombuffer(f" {text.lower().translate(WHITE)} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1)
    key = codes
    for n in range(2, max(SIZES) + 1):
        if len(codes) < n:
            return
        key = key[:-1] * BASE + codes[n - 1 :]
        if n in SIZES:
            yield ((key ^ (key >> np.uint64(31))) * SPREAD).view(np.int64)


@dataclass
class Linear:
    """Features in a table without collisions, their weights (ratio included) and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.bits = 20
        keys = self.keys.view(np.uint64)
        for k in range(10_000):
            self.mixer = np.uint64((0x9E3779B97F4A7C15 + 2 * 0xD1B54A32D192ED03 * k) & (2**64 - 1))
            slots = (keys * self.mixer) >> np.uint64(64 - self.bits)
            if len(np.unique(slots)) == len(keys):
                break
        else:
            raise ValueError("no table without collisions found")
        self.table = np.full(1 << self.bits, -1, np.int16)
        self.table[slots.astype(np.int64)] = np.arange(len(keys))

    def present(self, text: str) -> np.ndarray:
        """Indices of the features that a text has."""
        seen = np.zeros(len(self.keys), bool)
        for key in ngrams(text):
            at = self.table[((key.view(np.uint64) * self.mixer) >> np.uint64(64 - self.bits)).view(np.int64)]
            hit = at >= 0
            at, key = at[hit], key[hit]
            seen[at[self.keys[at] == key]] = True
        return np.flatnonzero(seen)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[self.present(text)].sum() + self.bias, -30, 30))))


def regress(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = RIDGE, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a regularised logistic regression by accelerated gradient steps; w: each row's weight."""
    d = x.shape[1]
    theta, bias = np.zeros(d, np.float32), 0.0
    ahead, ahead_bias, t = theta, bias, 1.0
    v = np.full(d, 1 / np.sqrt(max(1, d)), np.float32)
    for _ in range(20):  # the largest curvature, by power iteration
        u = x.T @ (w.astype(np.float32) * (x @ v))
        v = u / max(1e-9, float(np.linalg.norm(u)))
    step = 1 / (0.3 * (float(np.linalg.norm(u)) + float(w.sum())) + ridge)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead + ahead_bias, -30, 30)))
        g = (w * (p - y)).astype(np.float32)
        new, new_bias = ahead - step * (x.T @ g + ridge * ahead), ahead_bias - step * float(g.sum())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = (t - 1) / t_new
        ahead, ahead_bias = new + np.float32(k) * (new - theta), new_bias + k * (new_bias - bias)
        theta, bias, t = new, new_bias, t_new
    return theta, bias


def fit(df: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Linear:
    """Learns from labelled rows whose crc32(doc_id as text) mod FOLDS isn't HELD_OUT. A document with several labels counts with the highest.

    Without rows of both classes there are no features and the bias alone gives the share of class 1,
    with one row of each class added.
    """
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.join(df.select(df[id_col].cast("long").alias("doc_id")), "doc_id", "left_semi")
    totals = dict(known.groupBy("y").count().collect())
    prior = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    bias = float(np.log(prior / (1 - prior)))
    if len(totals) < 2:
        return Linear(np.zeros(0, np.int64), np.zeros(0), bias)
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS) for y in (0, 1)]
    few = chosen[0].unionAll(chosen[1])  # 2 * SAMPLE_ROWS rows of two numbers at most
    sample = materialize(id_and_text(df, id_col, text_col).join(F.broadcast(few), "doc_id"), "toxic-sample")

    counted = pa.schema([("gram", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            for y in (0, 1):
                texts = [t for t, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) if c == y]
                own = [distinct(np.concatenate([*ngrams(t), np.zeros(0, np.int64)])) for t in texts]
                if own:
                    gram, n = np.unique(np.concatenate(own), return_counts=True)
                    yield batch(counted, [gram, *((n * 0, n) if y else (n, n * 0))])

    prepare(df.sparkSession)
    rows = dict(sample.groupBy("y").count().collect())
    r0, r1 = F.lit(float(rows.get(0, 0))), F.lit(float(rows.get(1, 0)))
    grams = sample.mapInArrow(count, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n0, n1 = F.col("n0"), F.col("n1")
    chi = (n1 * (r0 - n0) - n0 * (r1 - n1)) ** 2 / ((n0 + n1) * (r0 + r1 - n0 - n1 + 1.0))
    best = grams.where(n0 + n1 >= 4).orderBy(chi.desc(), "gram").limit(FEATURES).collect()
    keys = np.array([g[0] for g in best], np.int64)
    ratio = np.log(((np.array([g[2] for g in best]) + 1) / (rows.get(1, 0) + 2)) / ((np.array([g[1] for g in best]) + 1) / (rows.get(0, 0) + 2)))
    blank = Linear(keys, ratio, bias)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield batch(pa.schema([("y", pa.int64()), ("at", pa.binary())]), [b.column(2).cast(pa.int64()), [blank.present(t).astype("<u2").tobytes() for t in b.column(1).to_pylist()]])

    got = sample.mapInArrow(read, "y long, at binary").collect()  # 2 * SAMPLE_ROWS rows of 2 * FEATURES bytes at most
    x, y = np.zeros((len(got), len(keys)), np.float32), np.array([g[0] for g in got])
    for i, g in enumerate(got):
        at = np.frombuffer(g[1], "<u2")
        x[i, at] = ratio[at]
    release(sample)
    share = np.array([totals[c] / rows[c] for c in (0, 1)])
    theta, bias = regress(x, y, (share / share.min())[y])
    return Linear(keys, theta * ratio, bias)


def score(df: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row, over whole texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield batch(schema, [b.column(0), [model.score(t) for t in b.column(1).to_pylist()]])

    prepare(df.sparkSession)
    return id_and_text(df, id_col, text_col).mapInArrow(apply, "doc_id long, score double")


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row.

    Null texts count as empty, a null id is not held out, rows that repeat are scored each, and an
    empty table gives no rows. Ties in the sample and the features are broken by hash and name.
    """
    scored = score(df, fit(df, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    held = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
