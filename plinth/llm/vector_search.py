"""Exact top-k inner products by block-at-a-time pruning.

Vectors are made integers, and equal vectors are one entry that carries its
k + 1 least ids.  Entries are sorted by length, by the two nearest of a bounded
number of pivots and by id, and dealt to parts of bounded size; a block is a
range of consecutive entries of one length and pivot, so its vectors are alike.
A block holds its forward index (ids and a matrix) and, for each dimension
(term), the largest and least component.

For a query, the sum over terms of the largest contribution that a block's
components allow bounds every score inside.  Queries first score their few most
promising blocks of the part they stand in themselves, which gives each a k-th
score.  Then groups of queries meet parts: blocks are taken in the order of
falling bounds, a block is multiplied only with the queries whose bound for it
reaches their k-th score, which rises meanwhile, and the rest is left alone when
the bounds have fallen below all of these; at an equal bound a block still
counts if it has an id small enough to win the tie.  Nothing is approximate:
the result is that of scoring everything.  How much is pruned is up to the data:
much where vectors stand in clusters, nothing where they point everywhere.

Vectors that are null or hold null or non-finite components (256 times a
component included) take no part, nor do null ids.  The inner product of two
vectors of different lengths is that of their common places.  Sums too large
for exact floating point are made of whole numbers of any size; a score beyond
a long is shown as the largest or least long, in its right rank.  Rows that
repeat an id with different vectors each count; an empty table gives an empty
result, and columns other than the two named ones are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.session import checkpointed

#: Bounds: pivots; vectors of a block; vectors of a part; queries of a group, and of those multiplied at once; blocks that a query scores first.
PIVOTS, BLOCK, PART, GROUP, CHUNK, FIRST = 256, 64, 65_536, 65_536, 512, 4
#: Vectors that a part has at least, where a smaller table is dealt to all cores.
LEAST_PART = 1024
_EXACT = 1 << 53
_LONG = (1 << 63) - 1


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """``id, v array<double>`` of the vectors that take part; components are whole numbers, which doubles hold exactly."""
    v = F.transform(F.col(vector_col), lambda x: F.lit(float(scale)) * x.cast("double"))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # from 2 ** 52 on every double is whole
    whole = F.transform("v", lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x))
    return rows.where(sound).select("id", F.when(F.size("v") == 0, F.array(F.lit(0.0))).otherwise(whole).alias("v"))


class _Numbers:
    """How matrices are stored and multiplied: two bytes a component where they fit, whole numbers of any size where sums may be too large."""

    def __init__(self, dim: int, largest: float):
        self.stored = np.int16 if largest < 1 << 15 else np.float64
        self.exact = dim * int(largest) ** 2 < _EXACT
        self.width = len(f"{2 * dim * int(largest) ** 2:x}")
        self.most = dim * int(largest) ** 2

    def pack(self, m: np.ndarray) -> bytes:
        return m.astype(self.stored).tobytes()

    def matrix(self, data: bytes, dim: int) -> np.ndarray:
        m = np.frombuffer(data, self.stored).reshape(-1, dim).astype(np.float64)
        return m if self.exact else np.vectorize(int, otypes=[object])(m)

    def floor(self, text: str | None):
        """A k-th score as it was written; below everything if there is none."""
        if text is None:
            return -np.inf if self.exact else -self.most - 1
        return float(int(text)) if self.exact else int(text)

    def key(self, score) -> str:
        """Sorts by falling score where longs can't."""
        return "" if self.exact else f"{self.most - int(score):0{self.width}x}"


def _block_batch(held, part, numbers, dim):
    m = np.stack(held["v"])
    ids = held["ids"]
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids], pa.list_(pa.list_(pa.int64()))), pa.array([held["q"]], pa.list_(pa.int64())), *(pa.array([numbers.pack(x)], pa.binary()) for x in (m, m.max(0), m.min(0))), pa.array([min(x[0] for x in ids)], pa.int64())],
        names=["part", "n", "ids", "q", "m", "hi", "lo", "least"],
    )


def _bounds(q: np.ndarray, blocks: list, numbers: _Numbers) -> np.ndarray:
    """For each query and block the sum over terms of the largest contribution."""
    out = np.empty((len(q), len(blocks)), np.float64 if numbers.exact else object)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    of_size: dict[int, list[int]] = {}
    for j, b in enumerate(blocks):
        of_size.setdefault(b["n"], []).append(j)
    for n, js in of_size.items():
        d = min(n, q.shape[1])
        hi, lo = (numbers.matrix(b"".join(blocks[j][x] for j in js), n)[:, :d] for x in ("hi", "lo"))
        out[:, js] = up[:, :d].dot(hi.T) + down[:, :d].dot(lo.T)
    return out


def _best(scores: np.ndarray, ids: list[list[int]], need: int, floor_score, floor_id: int):
    """The ``need`` best (score, id) of one query in a block, none below the floor."""
    order = np.nonzero(scores >= floor_score)[0]
    if len(order) > need:
        cut = np.sort(scores[order])[-need]
        order = order[scores[order] >= cut]
    found = sorted((-s, i) for j in order for s in (scores[j],) for i in ids[j])[:need]
    return [(-s, i) for s, i in found if s < -floor_score or i <= floor_id]


def search(blocks: list, q: np.ndarray, kth: np.ndarray, kth_id: np.ndarray, need: int, numbers: _Numbers, first: int | None = None):
    """(best (score, id) lists of the queries, query-block pairs scored): over all blocks, or each query's ``first`` most promising."""
    bound = _bounds(q, blocks, numbers)
    kth, kth_id = kth.copy(), kth_id.copy()
    least = [b["least"] for b in blocks]
    chosen = None
    if first is not None and first < len(blocks):
        chosen = np.zeros(bound.shape, bool)
        np.put_along_axis(chosen, np.argsort(-bound, axis=1, kind="stable")[:, :first], True, axis=1)
    top = bound.max(0)
    best: list[list] = [[] for _ in range(len(q))]
    scored = 0
    for j in np.argsort(-top, kind="stable").tolist():
        if top[j] < kth.min():
            break  # bounds only fall from here
        live = ((bound[:, j] > kth) | (bound[:, j] == kth) & (least[j] <= kth_id)).astype(bool)
        if chosen is not None:
            live &= chosen[:, j]
        (at,) = np.nonzero(live)
        if not len(at):
            continue
        scored += len(at)
        b = blocks[j]
        m = numbers.matrix(b["m"], b["n"])
        d = min(b["n"], q.shape[1])
        scores = q[at, :d].dot(m[:, :d].T)
        for i, line in zip(at[scores.max(1) >= kth[at]].tolist(), scores[scores.max(1) >= kth[at]]):
            new = _best(line, b["ids"], need, kth[i], kth_id[i])
            if new:
                best[i] = sorted(best[i] + new, key=lambda x: (-x[0], x[1]))[:need]
                if len(best[i]) == need:
                    s, least_id = best[i][-1]
                    if s > kth[i] or s == kth[i] and least_id < kth_id[i]:
                        kth[i], kth_id[i] = s, least_id
    return best, scored


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, scored=None) -> DataFrame:
    """``query_id, rank, id_col, score``: for each id divisible by ``every`` its k best others; ties go to the smaller id.

    ``scored``, an accumulator, counts the pairs of a query and a vector that are multiplied.
    """
    spark = df.sparkSession
    need = k + 1  # a query may find itself
    rows = checkpointed(quantized(df, id_col, vector_col, scale))
    dim, largest = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if dim is None:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    numbers = _Numbers(dim, largest)
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= need)
    asked = checkpointed(rows.where(F.col("id") % every == 0).groupBy("v").agg(F.min("id").alias("q")))
    entries = checkpointed(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(asked, "v", "left"))
    n_entries, n_asked = entries.count(), asked.count()
    pivots = [r.v for r in entries.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(PIVOTS).collect()]

    def nearest(batches):
        by_size: dict = {}
        for b in batches:
            vs = b.column(0).to_pylist()
            near = np.zeros((len(vs), 2), np.int32)
            for n in {len(v) for v in vs}:
                if n not in by_size:
                    by_size[n] = p = np.zeros((len(pivots), n))
                    for row, v in zip(p, pivots):
                        row[: min(n, len(v))] = v[:n]
                at = [i for i, v in enumerate(vs) if len(v) == n]
                p = by_size[n] / max(1.0, largest)  # alikeness only, so rounding does no harm
                far = (np.array([vs[i] for i in at]) / max(1.0, largest)) @ p.T - (p**2).sum(1) / 2
                near[at] = np.argsort(-far, axis=1, kind="stable")[:, [0, min(1, len(pivots) - 1)]]
            sizes = pa.array([len(v) for v in vs], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, sizes, pa.array(near[:, 0]), pa.array(near[:, 1])], names=["v", "ids", "q", "n", "pivot", "second"])

    part = min(PART, max(LEAST_PART, n_entries // (2 * spark.sparkContext.defaultParallelism)))
    order = ["n", "pivot", "second", F.col("ids")[0]]
    placed = entries.mapInArrow(nearest, "v array<double>, ids array<long>, q long, n int, pivot int, second int")
    placed = placed.repartitionByRange(-(-n_entries // part), *order).sortWithinPartitions(*order)

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        held: dict = {"at": None, "ids": [], "q": [], "v": []}
        for b in batches:
            for v, ids, q, n, pivot in zip(b.column(0).to_numpy(zero_copy_only=False), *(b.column(c).to_pylist() for c in range(1, 5))):
                if held["ids"] and ((n, pivot) != held["at"] or len(held["ids"]) == BLOCK):
                    yield _block_batch(held, number, numbers, held["at"][0])
                    held = {"at": None, "ids": [], "q": [], "v": []}
                held["at"] = n, pivot
                held["ids"].append(ids)
                held["q"].append(q)
                held["v"].append(v)
        if held["ids"]:
            yield _block_batch(held, number, numbers, held["at"][0])

    blocks = checkpointed(placed.select("v", "ids", "q", "n", "pivot").mapInArrow(pack, "part int, n int, ids array<array<long>>, q array<long>, m binary, hi binary, lo binary, least long"))

    def started(batches):
        """The queries of a part, with the k-th score that their first blocks give."""
        found = [r for b in batches for r in b.to_pylist()]  # one part, of bounded size
        by_size: dict = {}
        for b in found:
            for i, q in enumerate(b["q"]):
                if q is not None:
                    by_size.setdefault(b["n"], []).append((q, b, i))
        for n, asking in by_size.items():
            for at in range(0, len(asking), CHUNK):
                some = asking[at : at + CHUNK]
                size = n * np.dtype(numbers.stored).itemsize
                data = [b["m"][i * size : (i + 1) * size] for _, b, i in some]
                q = numbers.matrix(b"".join(data), n)
                low = np.full(len(q), numbers.floor(None), np.float64 if numbers.exact else object)
                best, count = search(found, q, low, np.full(len(q), _LONG), need, numbers, FIRST)
                if scored is not None:
                    scored.add(count * BLOCK)
                kth = [x[-1] if len(x) == need else (None, None) for x in best]
                columns = ([x[0] for x in some], [n] * len(some), data, [None if s is None else str(int(s)) for s, _ in kth], [i for _, i in kth])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64()))], names=["q", "n", "m", "kth", "kth_id"])

    queries = checkpointed(blocks.mapInArrow(started, "q long, n int, m binary, kth string, kth_id long"))
    groups = max(1, -(-n_asked // GROUP))
    parts = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(blocks.agg(F.max("part")).first()[0] or 0))).alias("part"))
    # every group of queries meets every part: as many copies of a query as there are parts, of a block as there are groups
    asking = queries.withColumn("g", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int")).join(F.broadcast(parts))
    offered = blocks.drop("q").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def cell(offers, asks):
        found = offers.to_pylist()
        out = []
        if found:
            sizes = asks.column("n").to_numpy()
            for n in np.unique(sizes).tolist():
                (of_size,) = np.nonzero(sizes == n)
                for at in range(0, len(of_size), CHUNK):
                    some = asks.take(pa.array(of_size[at : at + CHUNK]))
                    names = some.column("q").to_pylist()
                    q = numbers.matrix(b"".join(some.column("m").to_pylist()), n)
                    kth = np.array([numbers.floor(x) for x in some.column("kth").to_pylist()], np.float64 if numbers.exact else object)
                    kth_id = np.array([_LONG if x is None else x for x in some.column("kth_id").to_pylist()], np.int64)
                    best, count = search(found, q, kth, kth_id, need, numbers)
                    if scored is not None:
                        scored.add(count * BLOCK)
                    out += [(name, i, max(-_LONG - 1, min(_LONG, int(s))), numbers.key(s)) for name, x in zip(names, best) for s, i in x]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, kinds)], names=["q", "id", "score", "key"])

    found = offered.groupBy("part", "g").cogroup(asking.groupBy("part", "g")).applyInArrow(cell, "q long, id long, score long, key string")
    best_first = [F.desc("score"), "key", "id"]
    found = checkpointed(found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*best_first))).where(F.col("rank") <= need).drop("rank"))
    members = rows.where(F.col("id") % every == 0).join(asked, "v").select(F.col("id").alias("query_id"), "q")
    others = members.join(found, "q").where("query_id <> id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first))).where(F.col("rank") <= k)
    return others.select("query_id", "rank", F.col("id").alias(id_col), "score")
