"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

Each text is reduced to DIMS numbers. For each class the mean and covariance of the labelled
training rows are computed by one Spark aggregation over all of them; covariances are shrunk
towards the pooled one and towards its diagonal. A score comes from the difference of the two
Gaussian log densities, whose Mahalanobis terms use Cholesky factors computed once. A logistic
curve, fitted on a bounded sample of training rows, turns the difference into a probability.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, crc_mod, fresh, id_and_text, materialize, parts, prepare

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
SHRINK_POOLED, SHRINK_DIAGONAL = 0.05, 0.05
#: Training rows for the logistic curve, at most.
CALIBRATION_ROWS = 20_000

NAMES = ("words", "word_length", "upper", "symbols", "repeats", "distinct", "top_word", "compression", "digits", "ends", "bars", "line_words", "same_lines", "odd_tails")
DIMS = len(NAMES)
UPPER, LOWER, DIGIT, SPACES = (np.zeros(256, bool) for _ in range(4))
UPPER[65:91] = LOWER[97:123] = DIGIT[48:58] = True
SPACES[[9, 10, 11, 12, 13, 32]] = True


def logit(share: float) -> float:
    return float(np.log((share + 0.005) / (1.005 - share)))


def statistics(text: str) -> list[float]:
    """DIMS transformed statistics of a whole text; of an empty one too."""
    raw = text.encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, size = len(words), max(1, len(data))
    counts = np.bincount(data, minlength=256)
    upper, lower = int(counts[UPPER].sum()), int(counts[LOWER].sum())
    space, digit, high = int(counts[SPACES].sum()), int(counts[DIGIT].sum()), int(counts[128:].sum())
    symbols = len(data) - upper - lower - space - digit - high
    common = Counter(words)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    tails = sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words)
    one = max(1, n)
    return [
        float(np.log1p(n)), float(np.log1p(len(text) / one)), logit(upper / max(1, upper + lower)), logit(symbols / size), logit(repeats / one), float(np.log((len(common) + 1) / (n + 1) ** 0.8)), logit(max(common.values(), default=0) / one),
        float(np.log((len(zlib.compress(raw, 1)) + 1) / (size + 1))), logit(digit / size), logit(sum(w[-1] in ".,;:" for w in words) / one), logit(common["|"] / one), float(np.log1p(n / max(1, len(lines)))), logit(1 - len(set(lines)) / max(1, len(lines))), logit(tails / one),
    ]


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0, f1, ...) for each row."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"f{i}", pa.float64()) for i in range(DIMS))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            if b.num_rows:
                yield batch(schema, [b.column(0), *np.array([statistics(t) for t in b.column(1).to_pylist()]).T])

    prepare(df.sparkSession)
    return id_and_text(df, id_col, text_col).mapInArrow(measure, "doc_id long, " + ", ".join(f"f{i} double" for i in range(DIMS)))


@dataclass
class Discriminant:
    """Two Gaussians with the inverses of their Cholesky factors, and the logistic curve; or a constant where a class has no rows."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 minus that under class 0, damped far out."""
        dense = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        d = dense[1] - dense[0]
        return np.sign(d) * np.log1p(np.abs(d))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -30, 30)))


def curve(d: np.ndarray, y: np.ndarray, weight: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * d).sum() + weight * a, (p - y).sum() + weight * b])
        h = np.array([[(w * d * d).sum() + weight, (w * d).sum()], [(w * d).sum(), w.sum() + weight]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def discriminant(moments: dict[int, tuple[int, np.ndarray, np.ndarray]], pooled_weight: float = SHRINK_POOLED, diagonal_weight: float = SHRINK_DIAGONAL) -> Discriminant:
    """From each class's rows, sums and sums of products."""
    means, covs = {}, {}
    for k, (n, s, ss) in moments.items():
        means[k] = s / n
        covs[k] = ss / n - np.outer(means[k], means[k])
    total = sum(m[0] for m in moments.values())
    pooled = sum(moments[k][0] * covs[k] for k in covs) / total
    factors, constants = [], []
    for k in (0, 1):
        c = (1 - pooled_weight) * covs[k] + pooled_weight * pooled
        c = (1 - diagonal_weight) * c + diagonal_weight * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        constants.append(np.log(moments[k][0] / total) - np.log(np.diag(low)).sum())
    return Discriminant(np.array([means[0], means[1]]), np.array(factors), np.array(constants))


def fit(measured: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Discriminant:
    """Learns from the rows whose crc32(doc_id as text) mod FOLDS isn't HELD_OUT. A document with several labels counts with the highest.

    Without rows of both classes the score is a constant: the share of class 1 with one row of each added.
    """
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = measured.join(known, "doc_id")
    cols = [F.col(f"f{i}") for i in range(DIMS)]
    sums = rows.groupBy("y").agg(F.count("*"), *(F.sum(c) for c in cols), *(F.sum(cols[i] * cols[j]) for i in range(DIMS) for j in range(i + 1))).collect()
    moments = {}
    for r in sums:
        n, s, ss = r[1], np.array(r[2 : 2 + DIMS]), np.zeros((DIMS, DIMS))
        ss[np.tril_indices(DIMS)] = r[2 + DIMS :]
        moments[r[0]] = (n, s, ss + np.tril(ss, -1).T)
    if set(moments) != {0, 1}:
        ones = moments.get(1, (0,))[0]
        empty = np.zeros((0, 0))
        return Discriminant(empty, empty, empty, constant=(ones + 1) / (sum(m[0] for m in moments.values()) + 2))
    model = discriminant(moments)
    some = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS).select("y", *cols).toPandas().to_numpy(float)
    if len(set(some[:, 0])) == 2:
        model.slope, model.offset = curve(model.difference(some[:, 1:]), some[:, 0])
    return model


def score(measured: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) for each row of features()."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            if b.num_rows:
                yield batch(schema, [b.column(0), model.scores(np.stack([c.to_numpy() for c in b.columns[1:]], 1))])

    return measured.mapInArrow(apply, "doc_id long, score double")


def accept(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, all columns kept, whose texts score the threshold or more.

    Statistics are taken once and written beside the rows. Null texts count as empty, repeated rows
    are judged alike, a row without an id is judged and learned from by none.
    """
    prepare(df.sparkSession)
    column = fresh(df, "statistics")

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    wide = materialize(df.withColumn(column, measure(F.coalesce(df[text_col], F.lit("")))), "quality")
    measured = wide.select(wide[id_col].cast("long").alias("doc_id"), *(F.col(column)[i].alias(f"f{i}") for i in range(DIMS)))
    model = fit(measured, labels)

    @F.pandas_udf("double")
    def rate(rows: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(rows.to_numpy()).reshape(-1, DIMS)) if len(rows) else [], dtype="float64")

    return wide.where(rate(column) >= threshold).select(*df.columns)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row.

    Null texts count as empty, a null id is held out of nothing (false), rows that repeat are scored
    each, and an empty table gives no rows.
    """
    measured = materialize(features(df, id_col, text_col), "quality")
    scored = score(measured, fit(measured, labels))
    held = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
