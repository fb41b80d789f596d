"""Language identification by string kernels.

The kernel of two texts is blended-spectrum: for each order of n-grams the
number of n-grams present in both, over the root of the product of how many
each has, averaged over the orders.  N-grams are taken of lower-case letters,
with one space in place of whatever stands between words, and are packed into
integers without collisions.

Kernel ridge regression, one language against the rest, is fitted through
Nyström features: kernels with a set of landmark texts, times the inverse root
of the landmarks' own kernel matrix.  Each task sums its products of features;
the driver adds numbers whose count depends on the landmarks only, and solves.
Scoring multiplies, for a batch of texts, presence by landmark weights.

Training uses about ``max_rows`` rows of each language, those with the least
hashes, and of these ``landmarks`` in all, shared out among languages (both
are documented bounds; scoring has none).  Rows count by the inverse of their
language's number, so that a frequent one isn't preferred.

Texts are read whole, very long ones window by window.  Null texts, empty ones
and those without a letter are ``und``, score 0; so are all texts if there is
nothing to learn from.  Rows whose language is null aren't learned from.
Repeated rows are each scored alike, an empty table gives an empty result, and
columns other than those named aren't read, whatever their names.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.llm.quality import held_out
from plinth.session import checkpointed

#: Rows of each language that are learned from, about, and landmarks of all languages together.
MAX_ROWS, LANDMARKS = 2000, 128
#: Lengths of n-grams; a character takes 21 bits of 63.
ORDERS = (1, 2, 3)
RIDGE = 1e-4
#: Code points read at once, and n-grams of texts scored by one product, about.
WINDOW, BATCH_GRAMS = 1 << 18, 1 << 17


@functools.lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point its lower case if it is a letter, else the space."""
    out = np.full(0x110000, 32, np.int64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def grams(text: str) -> list[np.ndarray]:
    """The distinct n-grams of a text by order, sorted; empty lists if it has no letter."""
    table, out, carry = letter_table(), [np.zeros(0, np.int64) for _ in ORDERS], np.array([32], np.int64)
    parts: list[list[np.ndarray]] = [[] for _ in ORDERS]
    for at in range(0, len(text) + 1, WINDOW):  # the last window may be empty and closes the text
        last = at + WINDOW > len(text)
        points = np.frombuffer(text[at : at + WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.concatenate([carry, table[points], [32] if last else []]).astype(np.int64)
        x = x[np.append(True, (x[1:] != 32) | (x[:-1] != 32))]
        for k, n in enumerate(ORDERS):
            g = np.zeros(max(0, len(x) - n + 1), np.int64)
            for j in range(n):
                g = g << 21 | x[j : j + len(g)]
            parts[k].append(np.unique(g))
        carry = x[-(ORDERS[-1] - 1) :]
    out = [np.unique(np.concatenate(p)) if len(p) > 1 else p[0] for p in parts]
    out[0] = out[0][out[0] != 32]
    return out if len(out[0]) else [x[:0] for x in out]


@dataclass
class Kernel:
    """Landmarks by order: their n-grams, and for each n-gram the landmarks that have it, each over the root of its number of n-grams."""

    known: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def of(landmarks: list[list[np.ndarray]]) -> Kernel:
        out = Kernel()
        for k in range(len(ORDERS)):
            known = np.unique(np.concatenate([x[k] for x in landmarks]))
            w = np.zeros((len(known), len(landmarks)), np.float32)
            for j, x in enumerate(landmarks):
                w[np.searchsorted(known, x[k]), j] = 1 / np.sqrt(max(1, len(x[k])))
            out.known.append(known)
            out.weights.append(w)
        return out

    def times(self, right: np.ndarray) -> Kernel:
        """The same with each n-gram's weights multiplied by a matrix: kernels times ``right`` then come from one product."""
        return Kernel(self.known, [(w @ right).astype(np.float32) for w in self.weights])

    def rows(self, texts: list[list[np.ndarray]]) -> np.ndarray:
        """Kernels of texts with the landmarks (or these times a matrix), a batch of texts by products of presence and weights."""
        total = np.zeros((len(texts), self.weights[0].shape[1]))
        for k, (known, w) in enumerate(zip(self.known, self.weights)):
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi][k]) <= BATCH_GRAMS) and hi - lo < 256:
                    size += len(texts[hi][k])
                    hi += 1
                flat = np.concatenate([x[k] for x in texts[lo:hi]])
                row = np.repeat(np.arange(hi - lo), [len(x[k]) for x in texts[lo:hi]])
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                hit = known[at] == flat
                # columns that the batch has at all, so that the product is no larger than it must be
                held, col = np.unique(at[hit], return_inverse=True)
                presence = np.zeros((hi - lo, len(held)), np.float32)
                presence[row[hit], col] = 1
                norms = np.sqrt(np.maximum(1, [len(x[k]) for x in texts[lo:hi]]))
                total[lo:hi] += (presence @ w[held]) / norms[:, None]
                lo = hi
        return total / len(ORDERS)


@dataclass
class LanguageModel:
    """Languages, kernel times regression weights (a column for each language) and constants."""

    languages: list[str] = field(default_factory=list)
    kernel: Kernel | None = None
    constant: np.ndarray | None = None

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [grams(t or "") for t in texts]
        some = [k for k, g in enumerate(found) if len(g[0])] if self.kernel else []
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if some:
            values = self.kernel.rows([found[k] for k in some]) + self.constant
            for k, best, v in zip(some, values.argmax(axis=1).tolist(), values.max(axis=1).tolist()):
                names[k], scores[k] = self.languages[best], float(np.clip((v + 1) / 2, 0, 1))
        return names, scores


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_rows: int) -> DataFrame:
    """``lang, text, h``: about ``max_rows`` labelled rows of each language outside the held-out fifth, those whose hashes are least."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 5, 0))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit("language"), id_col), F.lit(1 << 40)).alias("h"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # the classes of the model
    if not sizes:
        return known
    cut = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, max_rows / n) * (1 << 40)))))
    return known.where(F.col("h") < cut[F.col("lang")])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    train = checkpointed(training_rows(docs, id_col, text_col, lang_col, max_rows).where(F.col("text").rlike(r"\p{L}")))
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel()
    names = sorted(sizes)
    each = max(1, landmarks // len(names))
    # copies aren't landmarks of their own; the sample is bounded, so are its hashes
    texts = train.groupBy("lang", F.xxhash64("text").alias("t")).agg(F.min("h").alias("h"))
    chosen = texts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).where(F.col("r") <= each)
    marks = train.withColumn("t", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "t", "h"]).dropDuplicates(["lang", "t"]).select("lang", "h", "t", "text")

    def listed(batches):
        for b in batches:
            found = [grams(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([[x.tobytes() for x in g] for g in found], pa.list_(pa.binary()))], names=["lang", "h", "t", "grams"])

    # distinct n-grams of a bounded number of texts
    found = sorted((r.lang, r.h, r.t, r.grams) for r in marks.mapInArrow(listed, "lang string, h long, t long, grams array<binary>").collect())
    kernel = Kernel.of([[np.frombuffer(x, np.int64) for x in g] for *_, g in found if len(g[0])])
    own = kernel.rows([[np.frombuffer(x, np.int64) for x in g] for *_, g in found if len(g[0])])
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    mapped, m, c = kernel.times(root), int(keep.sum()), len(names)
    at = {x: k for k, x in enumerate(names)}

    def sums(batches):
        left, right = np.zeros((m + 1, m + 1)), np.zeros((m + 1, c))
        for b in batches:
            langs, found = b.column(0).to_pylist(), [grams(t) for t in b.column(1).to_pylist()]
            phi = np.hstack([mapped.rows(found), np.ones((len(found), 1))])
            weight = np.array([1 / sizes[x] for x in langs])
            y = np.where(np.array([at[x] for x in langs])[:, None] == np.arange(c), 1.0, -1.0)
            left += (phi * weight[:, None]).T @ phi
            right += (phi * weight[:, None]).T @ y
        flat = np.concatenate([left.ravel(), right.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["k", "v"])

    total = np.zeros((m + 1) * (m + 1 + c))
    for r in train.mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # a number for each pair of landmarks
        total[r.k] = r.v
    left, right = total[: (m + 1) ** 2].reshape(m + 1, m + 1), total[(m + 1) ** 2 :].reshape(m + 1, c)
    beta = np.linalg.solve(left + ridge * c * np.eye(m + 1), right)
    return LanguageModel(names, mapped.times(beta[:-1]), beta[-1])


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: LanguageModel | None = None) -> DataFrame:
    """``id_col, held_out, lang_pred, score`` for each row."""
    model = model or fit(docs, id_col, text_col, lang_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            names, scores = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    out = docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
    return out.select(id_col, held_out(id_col, 5, 0).alias("held_out"), "lang_pred", "score")
