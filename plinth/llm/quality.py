"""Quality scores by a regularised quadratic discriminant over statistics of whole texts.

Each text gives a vector of transformed statistics (shares of character
classes, word lengths, repetition of words and lines, compressibility).  Class
means and covariances come from partial sums over all labelled training rows;
each covariance is shrunk towards the pooled one and that towards a multiple of
the identity.  The score is the logistic of the difference of the two classes'
log densities, from Mahalanobis distances by the Cholesky factors, which are
made once and sent along with the task.

Nulls are scored as the empty text, very long texts whole, in blocks of bytes.
Repeated rows are scored each on its own, an empty table gives an empty result,
and other columns are not read, whatever their names.
A training label that is null or not 0 or 1 is ignored; of several labels for
one id the largest counts.  If a class has no training rows, scores are the
share of label 1 among the rows there are, 0.5 if there are none.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.session import checkpointed

FEATURES = ("length", "upper", "lower", "digit", "blank", "newline", "non_ascii", "stop", "shout", "symbol", "bar", "other_punct", "word_length", "word_spread", "long_words", "distinct_words", "distinct_lines", "short_lines", "caps_words", "ragged_words", "compressed")
SHRINK_TO_POOLED, SHRINK_TO_IDENTITY = 0.2, 0.05

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(("", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n\r\v\f", "", ".,;:?", "!", "#$%&*@\\/<>{}=+~^_", "|", "\"'()[]-`")):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
_CLASS[128:] = 6
_BLOCK = 1 << 20


def _logit(p: float, n: float) -> float:
    """Log odds of a share of n things, kept finite."""
    return math.log((p * n + 0.5) / ((1 - p) * n + 0.5)) if n else 0.0


def text_statistics(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    by_byte = np.zeros(256, np.int64)
    packer, packed = zlib.compressobj(1), 0
    for at in range(0, n, _BLOCK):
        part = data[at : at + _BLOCK]
        by_byte += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        packed += len(packer.compress(part))
    packed += len(packer.flush())
    classes = np.bincount(_CLASS, weights=by_byte, minlength=12)
    out = [math.log1p(n), *(_logit(classes[k] / n if n else 0.0, n) for k in range(1, 12))]
    words = data.split()
    m = len(words)
    lengths = np.fromiter(map(len, words), np.int64, m)
    mean = float(lengths.mean()) if m else 0.0
    lines = [x for x in data.split(b"\n") if x.strip()]
    caps = sum(map(bytes.isupper, words))
    ragged = m - sum(map(bytes.isalpha, (w.strip(b".,;:?!\"'()") or b"a" for w in (words if n == len(text) else text.translate(_FOLD).encode("ascii", "replace").split()))))
    out += [
        math.log1p(mean),
        math.log1p(float(lengths.std())) if m else 0.0,
        _logit(float((lengths > 16).mean()) if m else 0.0, m),
        math.log((len(set(words)) + 1) / (m + 1)) / math.log(m + 2),
        math.log((len(set(lines)) + 0.5) / (len(lines) + 0.5)),
        _logit(sum(len(x) < 40 for x in lines) / len(lines) if lines else 0.0, len(lines)),
        _logit(caps / m if m else 0.0, m),
        _logit(min(1.0, max(0.0, ragged / m)) if m else 0.0, m),
        math.log((packed + 8) / (n + 16)),
    ]
    return out


class _Fold(dict):
    """Letters beyond ASCII count as a letter, everything else stays."""

    def __missing__(self, k):
        c = chr(k)
        self[k] = v = "a" if k > 127 and c.isalpha() else c
        return v


_FOLD = _Fold()


def statistics(text: str | Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: text_statistics(t or ""))

    return of(text)


@dataclass
class Discriminant:
    """Two Gaussian classes; ``constant`` is the score where one has no training rows."""

    means: list | None = None
    whiten: list | None = None  # inverse Cholesky factors
    offset: float = 0.0
    constant: float = 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.constant)
        z = [((x - m) @ w.T) for m, w in zip(self.means, self.whiten)]
        gap = self.offset + 0.5 * ((z[0] ** 2).sum(1) - (z[1] ** 2).sum(1))
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def moments(labelled: DataFrame) -> DataFrame:
    """``label, i, j, v``: sums of products of (1, statistics) for each class, from partial sums of each partition."""

    def partial(batches):
        d = len(FEATURES) + 1
        sums = np.zeros((2, d, d))
        for b in batches:
            if b.num_rows:
                x = np.column_stack([np.ones(b.num_rows), np.stack(b.column(0).to_numpy(zero_copy_only=False))])
                y = b.column(1).to_numpy(zero_copy_only=False)
                for c in (0, 1):
                    sums[c] += x[y == c].T @ x[y == c]
        c, i, j = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.reshape(-1)) for v in (c, i, j, sums)], names=["label", "i", "j", "v"])

    rows = labelled.select("stats", F.col("label").cast("long").alias("label"))
    return rows.mapInArrow(partial, "label long, i long, j long, v double").groupBy("label", "i", "j").agg(F.sum("v").alias("v"))


def fit(labelled: DataFrame) -> Discriminant:
    """From ``stats, label`` rows.  What comes to the driver is two small matrices, whatever the number of rows."""
    d = len(FEATURES) + 1
    m = np.zeros((2, d, d))
    for r in moments(labelled).collect():
        m[r.label, r.i, r.j] = r.v
    n = m[:, 0, 0]
    if min(n) < 2:
        return Discriminant(constant=float(n[1] / n.sum()) if n.sum() else 0.5)
    means = m[:, 0, 1:] / n[:, None]
    cov = [m[c, 1:, 1:] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))  # identity in units of each statistic
    factors, logdet = [], []
    for c in (0, 1):
        lam = min(1.0, max(SHRINK_TO_POOLED, 2 * d / n[c]))
        s = (1 - lam) * cov[c] + lam * pooled
        s = (1 - SHRINK_TO_IDENTITY) * s + SHRINK_TO_IDENTITY * np.diag(scale**2)
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        logdet.append(2 * np.log(np.diag(low)).sum())
    return Discriminant([*means], factors, float(0.5 * (logdet[0] - logdet[1]) + np.log(n[1] / n[0])))


def score_column(model: Discriminant, stats: Column) -> Column:
    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(s.to_numpy())) if len(s) else [], dtype="float64")

    return score(stats)


def held_out(id_col: str, folds: int = 3, out: int = 1) -> Column:
    """True for the ids whose labels are never learned from; a null id isn't held out and has no label."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == out, F.lit(False))


def training_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id", folds: int = 3, out: int = 1) -> DataFrame:
    """One 0 or 1 for each id that may be learned from."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col, folds, out))
    return rows.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id_col, held_out, score, predicted`` for each row."""
    stats = checkpointed(docs.select(id_col, statistics(text_col).alias("stats")))
    model = fit(stats.join(training_labels(labels, label_col, id_col), id_col))
    scored = stats.select(id_col, held_out(id_col).alias("held_out"), score_column(model, F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their columns."""
    stats = docs.select(id_col, statistics(text_col).alias("stats"))
    model = fit(stats.join(training_labels(labels, label_col, id_col), id_col))
    return docs.where(score_column(model, statistics(F.col(text_col))) >= 0.5)
