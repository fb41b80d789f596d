"""Near-duplicate groups by Jaccard similarity of five-word shingles, on SimHash and MinHash candidates.

Fingerprints within two bits (the Golay keys of ``simhash``) find the nearest
copies only: pairs at a similarity of 0.8 differ in up to 20 bits of 64, and
keys that tolerate so many would be shared by everything.  So a document also
has MinHash bands, and both kinds of key merely propose pairs: a pair links if
the Jaccard similarity of the two whole shingle sets reaches the threshold.
With 20 bands of 6 a pair at 0.8 is proposed with probability 0.998.

Documents with equal shingle sets are one node, which keeps the fingerprints of
all of them.  Every pair of nodes that shares a key is either compared or in
one component already:

1.  A key's head is the member that meets most others under all its keys: of
    edited copies mostly their original.  Each member is verified against it,
    two rows a member, and components are taken.
2.  Keys whose other members are not yet all in one component are compared
    without a bound on partners, in cells of two blocks of members, so no task
    holds a group.  Members of the key's largest component meet the others
    only.  A cell counts common shingles through an inverted index and emits at
    most one link for each of its members, never all pairs.

Missed is only a pair that shares no key.  Null texts are empty texts, which
are each other's copies.  A text of fewer words is one shingle; very long texts
are whole sets, of eight bytes a shingle.  Repeated rows are copies.  Other
columns are carried along and may have any name; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.components import connected_components
from plinth.llm.memory import giving_back
from plinth.llm.simhash import fingerprint, fingerprint_links
from plinth.session import broadcast_if_small, checkpointed

BANDS, ROWS = 20, 6
_RANDOM = np.random.default_rng(20240501)
_MULTIPLIERS = (_RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
#: Members of a block of a key's group, about.
BLOCK = 256
_BAND_MIX = (_RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    from xxhash import xxh64_digest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    whole = b" ".join(found)
    if len(found) <= words:
        return np.frombuffer(xxh64_digest(whole), "<u8").copy()
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist()
    return np.unique(np.frombuffer(b"".join([xxh64_digest(whole[i:j]) for i, j in zip(first, last)]), "<u8"))


def set_digest(shingles: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(shingles.tobytes())).view(np.int64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band; the empty set has none."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096, None] * _MULTIPLIERS[None, :] + _OFFSETS[None, :]
        np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0), out=least)
    return (((least ^ (least >> np.uint64(29))) * _BAND_MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _reaches(both, a, b, similarity: float):
    """Whether sets of ``a`` and ``b`` shingles with ``both`` in common are similar; two empty ones are."""
    return both >= similarity * (a + b - both)


def cell_links(left: list[np.ndarray], left_root: np.ndarray, right: list[np.ndarray], right_root: np.ndarray, similarity: float):
    """Places (i, j) of similar pairs that join everything similar on both sides.

    Pairs with equal roots, or joined by pairs found before, are passed over.
    """
    roots, part = np.unique(np.concatenate([left_root, right_root]), return_inverse=True)
    group = np.arange(len(roots))  # of each root, a number that joined roots share
    sizes = np.array([len(s) for s in right])
    every = np.concatenate(right)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(len(right)), sizes)[order]
    for i, s in enumerate(left):
        own = part[i]
        if (group[part[len(left) :]] == group[own]).all():
            continue
        lo, hi = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(right))
        for j in np.nonzero(_reaches(both, len(s), sizes, similarity))[0].tolist():
            other = part[len(left) + j]
            if group[other] != group[own]:
                group[group == group[other]] = group[own]
                yield i, j


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """``id, h, digest, fp, keys`` for each row of ``id, h, text``."""
    kind = rows.schema["id"].dataType.simpleString()

    def sketch(batches):
        for b in batches:
            digests, fps, keys = [], [], []
            for t in b.column(2):
                s = shingle_set(t.as_py(), words)
                digests.append(set_digest(s))
                fps.append(fingerprint(t.as_py()))
                keys.append(band_keys(s))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["id", "h", "digest", "fp", "keys"])

    return checkpointed(rows.mapInArrow(giving_back(sketch), f"id {kind}, h long, digest long, fp long, keys array<long>"))


def _placed(df: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """``id, h, digest, root`` for each row; ``h`` is a hash of the text, and rows of one group have one root."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("h"), "text")
    docs = _sketches(rows, words)
    nodes = checkpointed(docs.groupBy("digest").agg(F.min(F.struct("h", "id")).alias("source"), F.min("keys").alias("keys")))
    prints = checkpointed(docs.select("digest", "fp").distinct())
    # equal fingerprints are one more key; those within two bits are linked through the least node of each
    by_fp = checkpointed(prints.groupBy("fp").agg(F.min("digest").alias("node")))
    close = fingerprint_links(by_fp.select("fp")).join(by_fp.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b").select("x", "y")
    close = checkpointed(close.where("x <> y").distinct())
    keyed = nodes.select("digest", F.explode("keys").alias("key")).union(prints.select("digest", F.xxhash64("fp", F.lit("fp"))))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = checkpointed(keyed.join(shared, "key"))
    met = checkpointed(live.groupBy("digest").agg(F.sum("n").alias("met")))
    heads = live.join(met, "digest").groupBy("key").agg(F.max(F.struct("met", "digest")).alias("head")).select("key", F.col("head.digest").alias("head"))
    live = checkpointed(live.join(heads, "key"))
    named = checkpointed(met.select("digest").union(close.select("x")).union(close.select("y")).distinct())
    wanted = checkpointed(nodes.join(named, "digest").select(F.col("source.h").alias("h")).distinct())
    texts = rows.join(broadcast_if_small(wanted), "h", "left_semi").select("text")

    def shingles(batches):
        for b in batches:
            sets = [shingle_set(t.as_py(), words) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "s"])

    sets = checkpointed(texts.mapInArrow(giving_back(shingles), "digest long, s binary").join(named, "digest", "left_semi").dropDuplicates(["digest"]))

    def verify(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                ok.append(bool(_reaches(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), similarity)))
            part = b.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["x", "y"])

    pairs = live.where("digest <> head").select(F.least("digest", "head").alias("x"), F.greatest("digest", "head").alias("y")).union(close.select(F.least("x", "y"), F.greatest("x", "y"))).distinct()
    both = pairs.join(sets.select(F.col("digest").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("digest").alias("y"), F.col("s").alias("sy")), "y")
    links = checkpointed(both.select("x", "y", "sx", "sy").mapInArrow(giving_back(verify), "x long, y long"))
    roots = checkpointed(connected_components(links, "x", "y"))

    # what is left: keys whose members other than the head, which met all, have several roots
    members = live.where("n > 2 and digest <> head").join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("key", "digest", F.coalesce("root", "digest").alias("r"))
    by_root = checkpointed(members.groupBy("key", "r").agg(F.count(F.lit(1)).alias("n")))
    opened = by_root.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "r")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    # a lone block for a small group; else b0 blocks of the main component, then b1 of the others
    lone = F.col("n") <= BLOCK
    opened = opened.select("key", F.col("main.r").alias("main"), F.when(lone, 0).otherwise(F.ceil(F.col("main.n") / BLOCK)).cast("int").alias("b0"), F.when(lone, 1).otherwise(F.ceil((F.col("n") - F.col("main.n")) / BLOCK)).cast("int").alias("b1"))
    dealt = F.xxhash64("digest", "key")
    placed = members.join(checkpointed(opened), "key").withColumn("blk", F.when((F.col("r") == F.col("main")) & (F.col("b0") > 0), F.pmod(dealt, "b0")).otherwise(F.col("b0") + F.pmod(dealt, "b1")).cast("int"))
    with_block = F.explode(F.sequence(F.when(F.col("blk") < F.col("b0"), F.col("b0")).otherwise(F.lit(0)), F.col("b0") + F.col("b1") - 1))
    cells = placed.select("key", "digest", "r", "blk", with_block.alias("other")).select("key", F.least("blk", "other").alias("a"), F.greatest("blk", "other").alias("b"), "digest", "r", "blk")

    def cell(keys, table):
        own, digest, root = (table.column(c).to_numpy() for c in ("blk", "digest", "r"))
        found = [np.frombuffer(s.as_py(), "<u8") for s in table.column("s")]
        (at,), (to,) = np.nonzero(own == keys[1].as_py()), np.nonzero(own == keys[2].as_py())
        if not len(at) or not len(to):
            return pa.table({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64())})
        linked = list(cell_links([found[i] for i in at], root[at], [found[j] for j in to], root[to], similarity))
        return pa.table({"x": pa.array([root[at[i]] for i, _ in linked], pa.int64()), "y": pa.array([root[to[j]] for _, j in linked], pa.int64())})

    # links between roots, so that the second graph is no larger than what was left
    more = checkpointed(cells.join(sets, "digest").groupBy("key", "a", "b").applyInArrow(cell, "x long, y long"))
    if not more.isEmpty():
        higher = connected_components(more, "x", "y").select(F.col("node").alias("root"), F.col("root").alias("higher"))
        named_roots = roots.union(more.select(F.explode(F.array("x", "y")).alias("node")).distinct().withColumn("root", F.col("node"))).distinct()
        roots = checkpointed(named_roots.join(higher, "root", "left").groupBy("node").agg(F.min(F.coalesce("higher", "root")).alias("root")))
    return docs.select("id", "h", "digest").join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("id", "h", "digest", F.coalesce("root", "digest").alias("root"))


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id_col, component_id`` for each row; ``component_id`` is the least id reachable over links (null if all ids there are)."""
    placed = checkpointed(_placed(df, id_col, text_col, words, similarity))
    least = checkpointed(placed.groupBy("root").agg(F.min("id").alias("component_id")))
    return placed.join(least, "root").select(F.col("id").alias(id_col), "component_id")


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The least row of each group, with its columns: that with the least id (nulls last), of rows that share it that with the least hash of the text.

    A row is known by its id and text, so rows that share an id, null or not, but not their group are decided each on its
    own; of rows that repeat both one stays.
    """
    key, digest = unused(df, "_id"), unused(df, "_h")
    placed = checkpointed(_placed(df, id_col, text_col, words, similarity))
    least = checkpointed(placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("kept")))
    decided = placed.join(least, "root").select(F.col("id").alias(key), F.col("h").alias(digest), (F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("h") == F.col("kept.h"))).alias("stays"))
    decided = checkpointed(decided.groupBy(key, digest).agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")))
    gone = checkpointed(decided.where("not stays").select(key, digest))
    again = checkpointed(decided.where("stays and n > 1").select(key, digest))
    same = F.xxhash64(F.coalesce(df[text_col], F.lit(""))) == F.col(digest)
    same = same & df[id_col].eqNullSafe(F.col(key))
    kept = df.join(broadcast_if_small(gone), same, "left_anti")
    if again.isEmpty():
        return kept
    alike = kept.join(again, same, "left_semi")
    return kept.join(again, same, "left_anti").unionByName(alike.dropDuplicates([id_col, text_col]))
