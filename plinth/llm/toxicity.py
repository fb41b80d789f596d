"""Toxicity by multiple-instance learning: sentences scored, documents labelled.

A document is a bag of sentences.  A sentence is toxic with the logistic of the
weights of its words' shapes (a word whole, its beginnings and its endings, so
that compounds and inflected forms share weights); a document is toxic if one
of its sentences is, or by a leak that stands for labels no sentence explains:
a noisy-or.  Only document labels are known, and the sentence weights are what
makes them likeliest.

Training uses at most ``max_docs`` labelled rows, those whose hashed ids are
least (a documented bound; a scoring pass has none).  Spark counts in how many
toxic and other training documents each shape occurs and keeps the
``max_shapes`` that tell them apart best; what is fitted on the driver is only
these shapes' places in the training sentences.  A fifth of the training rows
first stays out of the fit and, if it has enough of both classes, sets the odds
at which a score is 0.5, where F1 is best there; then all are fitted.

Nulls are scored as the empty text: its score comes from the leak alone.  Very
long texts are scored whole, sentence by sentence.  Repeated rows are scored
each on its own, an empty table gives an empty result, and other columns are
not read, whatever their names.  Labels that are null or not 0 or 1 are
ignored.  With one class missing, scores are the share of label 1, or 0 without
any labels.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.quality import held_out, training_labels
from plinth.session import checkpointed

MAX_DOCS, MAX_SHAPES, MIN_DOCS, MIN_RATIO, MIN_CALIBRATION = 12_000, 1024, 3, 10.8, 25
#: Letters of the beginnings and endings that count.
BEGINNINGS, ENDINGS = range(4, 11), range(4, 9)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shapes_of(word: str) -> list[str]:
    """The word whole, its beginnings and its endings; bars mark where it stops."""
    n = len(word)
    return [f"|{word}|", *(f"|{word[:k]}" for k in BEGINNINGS if k < n), *(f"{word[-k:]}|" for k in ENDINGS if k < n)]


class Lexicon(dict):
    """For each word seen, the distinct numbers of its shapes; one for each batch of texts, so it stays small."""

    def __init__(self, index: dict[str, int]):
        self.index = index

    def __missing__(self, word: str) -> tuple:
        self[word] = found = tuple(self.index[x] for x in shapes_of(word) if x in self.index)
        return found


def lexical_sentences(text: str, lexicon: Lexicon):
    """Spans of the sentences that hold words of the lexicon, with their shapes' distinct numbers."""
    if not any(map(lexicon.__getitem__, set(words_of(text)))):
        return []
    out = []
    for m in _SENTENCE.finditer(text):
        found = sorted({k for w in words_of(m[0]) for k in lexicon[w]})
        if found:
            out.append((m.start(), m.end(), found))
    return out


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class NoisyOr:
    """Shape weights, the bias of a sentence that holds such a word, the leak, and the log odds of a document that count as even."""

    index: dict = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    leak: float = 0.0
    even: float = 0.0

    def sentences(self, text: str, lexicon: Lexicon | None = None) -> list[tuple[int, int, float]]:
        lexicon = Lexicon(self.index) if lexicon is None else lexicon
        return [(a, b, float(_logistic(self.bias + self.weights[w].sum()))) for a, b, w in lexical_sentences(text, lexicon)]

    def combine(self, scores: list[float]) -> float:
        """Noisy-or of sentence scores, moved on the log-odds scale so that 0.5 is where F1 was best; the order stays."""
        clean = (1 - self.leak) * np.prod(1 - np.array(scores, float))
        if not self.even:
            return float(1 - clean)
        return float(_logistic(np.log(max(1 - clean, 1e-12)) - np.log(max(clean, 1e-12)) - self.even))


def fit_noisy_or(bags: list[list[list[int]]], labels: np.ndarray, n_words: int, steps: int = 400, ridge: float = 2e-3):
    """Weights, bias and leak that make the labels of bags of sentences of words likeliest; Adam on all rows at once."""
    doc = np.array([d for d, bag in enumerate(bags) for _ in bag], np.int64)
    words = [w for bag in bags for w in bag]
    row = np.repeat(np.arange(len(words)), [len(w) for w in words]) if words else np.zeros(0, np.int64)
    col = np.array([k for w in words for k in w], np.int64)
    y, n = labels.astype(float), len(bags)
    theta = np.concatenate([np.ones(n_words), [-2.0, -4.0]])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = theta[-2] + np.bincount(row, theta[col], minlength=len(words))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        leak = 1 / (1 + np.exp(-theta[-1]))
        clean = np.bincount(doc, -np.log1p(np.exp(np.clip(z, -30, 30))), minlength=n) + np.log1p(-leak)  # log chance that nothing is toxic
        toxic = -np.expm1(clean)
        # derivative of the log likelihood by the log chance of a clean document
        g = (1 - y) - y * np.exp(clean) / np.maximum(toxic, 1e-9)
        dz = -g[doc] * p
        grad = np.concatenate([np.bincount(col, dz[row], minlength=n_words), [dz.sum(), -(g * leak).sum()]]) / n
        grad[:n_words] -= ridge / 10 * theta[:n_words]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta += 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return theta[:n_words], float(theta[-2]), float(1 / (1 + np.exp(-theta[-1])))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on rows count as toxic with the highest F1; halfway to the next one below."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    last = np.append(np.diff(p[order]) < 0, True)  # equal scores fall on one side
    f1 = np.where(last, 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum())), -1)
    k = int(f1.argmax())
    low = p[order][k + 1] if k + 1 < len(y) else 0.0
    return float(np.clip((p[order][k] + low) / 2, 0.05, 0.95))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS, max_shapes: int = MAX_SHAPES) -> NoisyOr:
    known = checkpointed(training_labels(labels, label_col, id_col, 5, 0).withColumn("h", F.pmod(F.xxhash64(id_col), F.lit(1 << 40))))
    # hashes are uniform, so about 1.5 max_docs rows lie below the cut, and not max_docs of every task are sorted
    cut = int(min(1.0, 1.5 * max_docs / max(1, known.count())) * (1 << 40))
    chosen = known.where(F.col("h") <= cut).orderBy("h", id_col).limit(max_docs).select(id_col, "label", "h")
    chosen = checkpointed(chosen)  # at most max_docs rows of three numbers, so small enough to broadcast
    rows = docs.where(F.col(id_col).isNotNull()).select(id_col, F.coalesce(text_col, F.lit("")).alias("text"))
    train = checkpointed(rows.join(F.broadcast(chosen), id_col).select("text", "label", "h"))
    by_class = {r.label: r.n for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = by_class.get(0, 0), by_class.get(1, 0)
    if not n0 or not n1:
        return NoisyOr(leak=n1 / (n0 + n1) if n0 + n1 else 0.0)

    def distinct_shapes(batches):
        for b in batches:
            seen = (Counter(), Counter())
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[y].update({x for w in set(words_of(t)) for x in shapes_of(w)})
            shapes = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(shapes, pa.string()), *(pa.array([seen[y][x] for x in shapes], pa.int64()) for y in (1, 0))], names=["shape", "a", "b"])

    seen = train.mapInArrow(distinct_shapes, "shape string, a long, b long").groupBy("shape").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # log-likelihood ratio of the 2 x 2 table of shape and class; shapes that toxic documents have more often
    n = float(n0 + n1)
    told = lambda seen_in, of_class: F.when(seen_in > 0, seen_in * F.log(seen_in * n / ((F.col("a") + F.col("b")) * of_class))).otherwise(0.0)
    missed = lambda seen_in, of_class: F.when(seen_in < of_class, (of_class - seen_in) * F.log((of_class - seen_in) * n / ((n - F.col("a") - F.col("b")) * of_class))).otherwise(0.0)
    ratio = 2 * (told(F.col("a"), n1) + told(F.col("b"), n0) + missed(F.col("a"), n1) + missed(F.col("b"), n0))
    more = F.col("a") * n0 > F.col("b") * n1
    best = seen.where((F.col("a") >= MIN_DOCS) & more).select("shape", F.round(ratio, 6).alias("g")).where(F.col("g") > MIN_RATIO).orderBy(F.desc("g"), "shape").limit(max_shapes)
    index = {r.shape: k for k, r in enumerate(best.collect())}
    if not index:
        return NoisyOr(leak=n1 / (n0 + n1))

    def bags_of(batches):
        for b in batches:
            lexicon = Lexicon(index)
            bags = [[w for _, _, w in lexical_sentences(t, lexicon)] for t in b.column(0).to_pylist()]
            flat = [np.array([k for w in bag for k in w], np.int16).tobytes() for bag in bags]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array([np.array([len(w) for w in bag], np.int16).tobytes() for bag in bags], pa.binary()), pa.array(flat, pa.binary())], names=["h", "label", "sizes", "flat"])

    # in an order of its own, so that the model doesn't depend on partitions
    found = sorted(tuple(r) for r in train.mapInArrow(bags_of, "h long, label int, sizes binary, flat binary").collect())
    bags = [[w.tolist() for w in np.split(np.frombuffer(flat, np.int16), np.cumsum(np.frombuffer(sizes, np.int16))[:-1])] if sizes else [] for _, _, sizes, flat in found]
    y = np.array([r[1] for r in found])
    out = np.arange(len(y)) % 5 == 0
    even = 0.5
    if min(y[out].sum(), (1 - y[out]).sum(), y[~out].sum(), (1 - y[~out]).sum()) >= MIN_CALIBRATION:
        part = NoisyOr(index, *fit_noisy_or([x for x, o in zip(bags, out) if not o], y[~out], len(index)))
        even = best_threshold(np.array([part.combine(_logistic(np.array([part.bias + part.weights[w].sum() for w in x]))) for x, o in zip(bags, out) if o]), y[out])
    weights, bias, leak = fit_noisy_or(bags, y, len(index))
    return NoisyOr(index, weights, bias, leak, float(np.log(even / (1 - even))))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", model: NoisyOr | None = None) -> DataFrame:
    """``id_col, held_out, score, predicted, offending`` for each row; ``offending`` has the spans (code points, end exclusive) and scores of sentences of at least 0.5."""
    model = model or fit(docs, labels, id_col, text_col, label_col)
    kind = docs.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            scores, offending = [], []
            lexicon = Lexicon(model.index)
            for t in b.column(1):
                found = model.sentences(t.as_py(), lexicon)
                scores.append(model.combine([s for _, _, s in found]))
                offending.append([{"start": x, "end": y, "score": s} for x, y, s in found if s >= 0.5])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(offending, spans)], names=[id_col, "score", "offending"])

    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text"))
    out = rows.mapInArrow(run, f"`{id_col}` {kind}, score double, offending array<struct<start:int,end:int,score:double>>")
    return out.select(id_col, held_out(id_col, 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
