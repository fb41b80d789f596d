"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a mask of ten word places of which six count; the others may
hold anything.  The four masks below are chosen so that of any 20 aligned words
with at most four substitutions at least one mask, at some place, sees only
equal words.  Two smaller masks do the same for items of 10 to 15 words, so
that for every item of 10 words or more any stretch that counts as a leak is
hit (a test enumerates all cases).  Items of fewer words are hashed whole, and
must then occur word for word.

1.  The benchmark's seeds are a table of hashes.  A Bloom filter of them, whose
    size has a fixed upper bound, goes to all tasks.
2.  One pass over the documents hashes every place under every mask and keeps
    the places that pass the filter, with the words around them: one row for
    each stretch of such places.
3.  An equality join of the distinct hashes of a stretch with those of the
    items gives pairs of stretch and item, each once however many hits it has.
    Where the filter lets too much through the join is larger, and the result
    the same.
4.  Each pair is verified in one go over all shifts that a hit names: a
    document leaks an item if, of ``min(20, item's words)`` consecutive aligned
    words, at least 80 % are equal.  The best stretch is that with most equal
    words, then the first one.

Null texts are empty, and very long ones are read whole.  Repeated ids are one
document in the result of ``leaks``, where null ids take no part; in
``remove_leaking`` rows are decided by their texts, whatever their ids.  Items
without words match nothing, and empty tables give empty results.  Other
columns are not read, or carried along, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.memory import giving_back
from plinth.llm.similarity import unused
from plinth.session import broadcast_if_small, checkpointed

#: Fixed masks: places that count, of a span of ten words; and those for items of 10 to 15 words.
SPAN = 10
MASKS = ("1101010011", "1000101111", "1111100001", "1010110011")
SMALL_MASKS, SMALL_ITEMS = ("11111", "1110011"), range(10, 16)
STRETCH, SHARE = 20, 0.8
#: Bits of the filter: at least so many for each seed, and never more than this power of two.
BITS_PER_SEED, MAX_BITS = 64, 28
#: Stretches further apart than this many words get rows of their own.
APART = 32
#: Places compared at once.
PLACES = 1 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's lower-case words."""
    from xxhash import xxh64_digest

    data = b"".join([xxh64_digest(w) for w in _WORD.findall(text.lower().encode("utf-8", "surrogatepass"))])
    return np.frombuffer(data, "<u8")


def seed_hashes(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """A hash for each place at which the mask fits."""
    n = max(0, len(words) - len(mask) + 1)
    out = np.full(n, np.uint64(0x2545F4914F6CDD1D + salt))
    k = 0
    for at, counts in enumerate(mask):
        if counts == "1":
            out = (out ^ words[at : at + n]) * _MIX[k % len(_MIX)]
            out ^= out >> np.uint64(29)
            k += 1
    return out


def masks_for(sizes) -> list[tuple[str, int]]:
    """(mask, salt) of the masks that items of these numbers of words need."""
    return [
        *((m, k) for k, m in enumerate(MASKS)),
        *((m, 50 + k) for k, m in enumerate(SMALL_MASKS) if any(n in SMALL_ITEMS for n in sizes)),
        *(("1" * n, 100 + n) for n in sorted({n for n in sizes if 0 < n < SPAN})),
    ]


def _seed_places(words: np.ndarray, masks):
    """Hashes of all places under the masks, and the places."""
    found = [seed_hashes(words, m, salt) for m, salt in masks]
    return np.concatenate(found), np.concatenate([np.arange(len(h)) for h in found])


def _probes(h: np.ndarray, bits: int):
    top = np.uint64((1 << bits) - 1)
    return h & top, (h >> np.uint64(64 - bits)) & top


def _shifts(words_seed, words_at, item_seed, item_at, n_words: int, n_item: int) -> np.ndarray:
    """Distinct differences of places at which both have one seed."""
    mark = np.zeros(n_words + n_item + 1, bool)
    order = np.argsort(words_seed, kind="stable")
    words_seed, words_at = words_seed[order], words_at[order]
    lo, hi = np.searchsorted(words_seed, item_seed, "left"), np.searchsorted(words_seed, item_seed, "right")
    for k in np.nonzero(hi > lo)[0]:
        mark[words_at[lo[k] : hi[k]] - item_at[k] + n_item] = True
    return np.nonzero(mark)[0] - n_item


def best_stretch(words: np.ndarray, item: np.ndarray, shifts: np.ndarray):
    """(equal words, of how many, first word) of the best aligned stretch over the given shifts, the first of the best; None if none counts."""
    need = min(STRETCH, len(item))
    least = need if need < SPAN else int(np.ceil(SHARE * need - 1e-9))
    best = None
    step = max(1, PLACES // len(item))
    place = np.arange(len(item))
    for at in range(0, len(shifts), step):
        part = shifts[at : at + step]
        where = place[None, :] + part[:, None]
        inside = (where >= 0) & (where < len(words))
        equal = inside & (words[np.where(inside, where, 0)] == item[None, :])
        sums = np.concatenate([np.zeros((len(part), 1), np.int32), np.cumsum(equal, axis=1, dtype=np.int32)], axis=1)
        runs = sums[:, need:] - sums[:, :-need]
        runs[(where[:, : runs.shape[1]] < 0) | (where[:, need - 1 :] >= len(words))] = -1
        most = int(runs.max())
        if most >= least and (best is None or most >= best[0]):
            i, j = np.nonzero(runs == most)
            first = int((part[i] + j).min())
            if best is None or (-most, first) < (-best[0], best[2]):
                best = (most, need, first)
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id_col, item_col, matched, item_words, first_word, last_word``: documents that hold an item, with the best aligned stretch.

    ``matched`` is the share of equal words in that stretch, which reaches
    from word ``first_word`` to ``last_word`` of the document, counted from 0.
    """
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    found = _found(texts, benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")))
    return found.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "matched", "item_words", "first_word", "last_word")


def _found(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc, item, matched, item_words, first_word, last_word`` from rows of ``doc, text`` and of ``item, text``."""
    spark = texts.sparkSession
    kind, item_kind = texts.schema["doc"].dataType.simpleString(), benchmark.schema["item"].dataType.simpleString()

    def item_words(batches):
        for b in batches:
            words = [word_hashes(t).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.int64()))], names=["item", "words"])

    def item_seeds(batches):
        for b in batches:
            for item, words in zip(b.column(0), b.column(1).to_pylist()):
                h = np.unique(_seed_places(np.array(words, np.int64).view(np.uint64), masks_for([len(words)]))[0])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([item.as_py()] * len(h), b.column(0).type)], names=["seed", "item"])

    source = benchmark.where(F.col("text").isNotNull())
    items = checkpointed(source.mapInArrow(giving_back(item_words), f"item {item_kind}, words array<long>").where(F.size("words") > 0))
    seeds = checkpointed(items.mapInArrow(giving_back(item_seeds), f"seed long, item {item_kind}"))
    sizes = [r.n for r in items.select(F.size("words").alias("n")).where(F.col("n") < SMALL_ITEMS.stop).distinct().collect()]  # fifteen values at most
    masks = masks_for(sizes)
    bits = min(MAX_BITS, max(16, int(np.ceil(np.log2(BITS_PER_SEED * (seeds.count() + 1))))))
    bloom = spark.sparkContext.broadcast(_bloom(seeds, bits))

    def stretches(batches):
        filled = bloom.value
        for b in batches:
            rows = {"doc": [], "base": [], "words": [], "seed": [], "at": []}
            for doc, text in zip(b.column(0), b.column(1)):
                w = word_hashes(text.as_py())
                at, seed = [], []
                for m, salt in masks:
                    h = seed_hashes(w, m, salt)
                    ok = np.ones(len(h), bool)
                    for p in _probes(h, bits):
                        ok &= (filled[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    (k,) = np.nonzero(ok)
                    at.append(k)
                    seed.append(h[k])
                at = np.concatenate(at)
                if not len(at):
                    continue
                seed = np.concatenate(seed).view(np.int64)
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                for part in np.split(np.arange(len(at)), np.nonzero(np.diff(at) > APART)[0] + 1):
                    lo, hi = max(0, int(at[part[0]]) - STRETCH), int(at[part[-1]]) + SPAN + STRETCH
                    for key, v in (("doc", doc.as_py()), ("base", lo), ("words", w[lo:hi].view(np.int64)), ("seed", seed[part]), ("at", (at[part] - lo).astype(np.int32))):
                        rows[key].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc"], b.column(0).type), pa.array(rows["base"], pa.int32()), pa.array(rows["words"], pa.list_(pa.int64())), pa.array(rows["seed"], pa.list_(pa.int64())), pa.array(rows["at"], pa.list_(pa.int32()))], names=["doc", "base", "words", "seed", "at"])

    found = checkpointed(texts.mapInArrow(giving_back(stretches), f"doc {kind}, base int, words array<long>, seed array<long>, at array<int>").withColumn("stretch", F.monotonically_increasing_id()))
    pairs = found.select("stretch", F.explode(F.array_distinct("seed")).alias("seed")).join(broadcast_if_small(seeds), "seed").select("stretch", "item").distinct()

    def verify(batches):
        held: dict = {}  # the seeds of the items of this batch
        for b in batches:
            out = []
            held.clear()
            for doc, item, base, words, seed, at, item_words in zip(*(b.column(k) for k in range(7))):
                key = item.as_py()
                if key not in held:
                    w = np.asarray(item_words.values.to_numpy(zero_copy_only=False), np.int64)
                    held[key] = w, *_seed_places(w.view(np.uint64), masks_for([len(w)]))
                w, item_seed, item_at = held[key]
                words = np.asarray(words.values.to_numpy(zero_copy_only=False), np.int64)
                shifts = _shifts(np.asarray(seed.values.to_numpy(zero_copy_only=False), np.int64), np.asarray(at.values.to_numpy(zero_copy_only=False), np.int64), item_seed.view(np.int64), item_at, len(words), len(w))
                best = best_stretch(words, w, shifts) if len(shifts) else None
                if best:
                    first = base.as_py() + best[2]
                    out.append((doc.as_py(), key, best[0] / best[1], len(w), first, first + best[1] - 1))
            kinds = (b.schema.field("doc").type, b.schema.field("item").type, pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=["doc", "item", "matched", "item_words", "first_word", "last_word"])

    cases = pairs.join(found, "stretch").join(items.withColumnRenamed("words", "item_words"), "item")
    verified = cases.select("doc", "item", "base", "words", "seed", "at", "item_words").mapInArrow(giving_back(verify), f"doc {kind}, item {item_kind}, matched double, item_words int, first_word int, last_word int")
    best = verified.groupBy("doc", "item").agg(F.min(F.struct((-F.col("matched")).alias("m"), "first_word", "last_word", "item_words")).alias("b"))
    return best.select("doc", "item", (-F.col("b.m")).alias("matched"), "b.item_words", "b.first_word", "b.last_word")


def _bloom(seeds: DataFrame, bits: int) -> np.ndarray:
    """Two bits for each seed, as bytes.  What is gathered is at most 2 ** (bits - 6) numbers."""

    def probes(batches):
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            p = np.concatenate(_probes(h, bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(p >> 6), pa.array(np.left_shift(np.uint64(1), (p & 63).astype(np.uint64)).view(np.int64))], names=["at", "bits"])

    out = np.zeros(1 << (bits - 6), np.int64)
    gathered = seeds.select("seed").mapInArrow(giving_back(probes), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out[gathered["at"].to_numpy(np.int64)] = gathered["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def remove_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text leaks no item, with their columns."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.md5(text_col).alias("doc"), F.col(text_col).alias("text"))
    found = _found(texts, benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")))
    name = unused(docs, "_leaking")
    leaking = checkpointed(found.select(F.col("doc").alias(name)).distinct())
    return docs.join(broadcast_if_small(leaking), F.md5(docs[text_col]) == F.col(name), "left_anti")
