"""The exact nearest rows of every row, by pivots and the triangle inequality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.session import checkpointed

_NEAR = "near array<struct<d: double, other: long>>, pairs long"
_AT_ONCE = 2_000_000


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, by differences, so that equal vectors are at 0 and a pair has one distance wherever it is met; a few rows at a time."""
    out, step = np.empty((len(a), len(b))), max(1, _AT_ONCE // max(1, b.size))
    for i in range(0, len(a), step):
        gap = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt((gap * gap).sum(axis=2))
    return out


def _stacked(column, width: int) -> np.ndarray:
    other = {len(v) for v in column} - {width}
    if other:
        raise ValueError(f"vectors of {width} and of {min(other)} components")
    return np.array(column.tolist(), dtype=float).reshape(len(column), width)


def _nearest(d: np.ndarray, others: np.ndarray, k: int) -> list[list[dict]]:
    """For each row of ``d`` its k least (distance, id), infinite ones left out."""
    out = []
    for row in d:
        at = np.arange(len(row))
        if len(row) > k:
            at = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1])  # with all ties of the k-th
        at = at[np.isfinite(row[at])]
        at = at[np.lexsort((others[at], row[at]))][:k]
        out.append([{"d": float(row[i]), "other": int(others[i])} for i in at])
    return out


def _merged(d: np.ndarray, others: np.ndarray, gap: np.ndarray, ids: np.ndarray) -> None:
    """Takes into the k least (distance, id) of each row, in place, those of ``gap`` (rows x ids)."""
    k = d.shape[1]
    for i in np.flatnonzero((gap <= d[:, -1:]).any(axis=1)):
        at = np.flatnonzero(gap[i] <= d[i, -1])
        both, names = np.append(d[i], gap[i, at]), np.append(others[i], ids[at])
        first = np.lexsort((names, both))[:k]
        d[i], others[i] = both[first], names[first]


def _within(a: np.ndarray, b: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Distances of all pairs that may be at most ``reach`` apart, infinite for the others; products tell which, with room for their rounding."""
    out, aa, bb = np.full((len(a), len(b)), np.inf), (a * a).sum(axis=1), (b * b).sum(axis=1)
    near = aa[:, None] + bb - 2 * (a @ b.T) <= reach[:, None] ** 2 * (1 + 1e-9) + 1e-9 * (aa[:, None] + bb)
    i, j = np.nonzero(near)
    for lo in range(0, len(i), step := max(1, _AT_ONCE // max(1, a.shape[1]))):
        gap = a[i[lo : lo + step]] - b[j[lo : lo + step]]
        out[i[lo : lo + step], j[lo : lo + step]] = np.sqrt((gap * gap).sum(axis=1))
    return out


def _distinct(rows: DataFrame, k: int, salts: int = 64) -> DataFrame:
    """``v, rep, keys``: each vector once with its least key and its k + 1 least keys; a vector's rows are dealt by salt first."""
    salted = rows.withColumn("s", F.pmod(F.xxhash64("key"), F.lit(salts)))
    few = salted.withColumn("r", F.row_number().over(Window.partitionBy("v", "s").orderBy("key"))).where(F.col("r") <= k + 1)
    keys = few.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("key")), 1, k + 1).alias("keys"))
    return keys.select("v", F.col("keys")[0].alias("rep"), "keys")


def neighbour_join(df: DataFrame, key: str, vector: str, k: int, pivots: int = 256, block: int = 1000) -> tuple[DataFrame, DataFrame]:
    """``key, rank, other, d`` for every row: its ``k`` nearest other rows by Euclidean distance, ties to the smaller key; and
    ``pairs, of``, one row: how many distances between different vectors were computed, of how many.

    ``key`` is a whole number that names a row.  Vectors that are null, empty or hold null, NaN or infinite components take no part;
    the others must be of one length.  With fewer than k other rows there are fewer neighbours.

    Each vector is taken once, whatever its copies.  A bounded sample of them (``pivots``, the only vectors that the driver holds) cuts
    space into cells by the nearest pivot, large cells into blocks.  A row's nearest within its block bound the ball that
    holds its neighbours; it visits the blocks of another cell only if no triangle inequality keeps its ball out of there:
    neither by the cell's inner and outer radius, nor by the plane midway between the two pivots.

    Blocks meet as packed rows of a cartesian product, which copies no vector for those who visit it: what is written grows
    with the rows, though distances may grow with their square.  A task keeps a block's k nearest over all blocks that it meets.
    """
    spark = df.sparkSession
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where("key is not null")
    rows = rows.where(F.coalesce(fine, F.lit(False))).select("key", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))  # -0.0 becomes 0.0
    points = checkpointed(_distinct(rows, k))
    total = points.count()
    result = "key long, rank int, other long, d double"
    sample = points.orderBy(F.xxhash64("rep"), "rep").limit(max(1, min(pivots, int(2 * total**0.5)))).select("v").collect()
    if not sample:
        return spark.createDataFrame([], result), spark.createDataFrame([(0, 0)], "pairs long, of long")
    width = len(sample[0].v)
    centres = _stacked(pd.Series([list(r.v) for r in sample]), width)

    def assign(batches):
        for b in batches:
            d = distances(_stacked(b["v"], width), centres)
            b["cell"] = d.argmin(axis=1).astype("int32")
            b["d0"] = d.min(axis=1)
            yield b

    placed = checkpointed(points.select("rep", "v").mapInPandas(assign, "rep long, v array<double>, cell int, d0 double"))
    # a row for each pivot, so bounded as they are
    cells = {r.cell: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d0").alias("inner"), F.max("d0").alias("outer")).collect()}
    numbers = np.array([-(-cells[c].n // block) if c in cells else 0 for c in range(len(centres))])
    inner, outer = (np.array([getattr(cells[c], f) if c in cells else np.inf for c in range(len(centres))]) for f in ("inner", "outer"))
    split = spark.createDataFrame([(c, int(m)) for c, m in enumerate(numbers) if m], "cell int, blocks int")
    members = checkpointed(placed.join(F.broadcast(split), "cell").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))  # a row for each pivot is broadcast

    def at_home(g: pd.DataFrame) -> pd.DataFrame:
        x, ids = _stacked(g["v"], width), g["rep"].to_numpy()
        gap = distances(x, x)
        np.fill_diagonal(gap, np.inf)
        d, other = np.full((len(g), k), np.inf), np.full((len(g), k), -1)
        for i, near in enumerate(_nearest(gap, ids, k)):
            d[i, : len(near)], other[i, : len(near)] = [n["d"] for n in near], [n["other"] for n in near]
        return pd.DataFrame({"cell": g["cell"][:1], "block": g["block"][:1], "rep": [ids.tobytes()], "v": [x.tobytes()], "d": [d.tobytes()], "other": [other.astype(np.int64).tobytes()]})

    home = checkpointed(members.groupBy("cell", "block").applyInPandas(at_home, "cell int, block int, rep binary, v binary, d binary, other binary"))
    between = distances(centres, centres)
    vectors = lambda v: np.frombuffer(v).reshape(-1, width)
    ranked = lambda d, other: (np.frombuffer(d).reshape(-1, k).copy(), np.frombuffer(other, np.int64).reshape(-1, k).copy())

    def visits(batches):
        """The cells that some row of a block visits, and which of them each row does."""
        for b in batches:
            opened = []
            for cell, v, near in zip(b["cell"], b["v"], b["d"]):
                d = distances(vectors(v), centres)
                mine = d[:, cell][:, None]
                plane = np.divide(d * d - mine * mine, 2 * between[cell], out=np.zeros_like(d), where=between[cell] > 0)
                least = np.maximum.reduce([d - outer, inner - d, plane])
                slack = 1e-9 * (1 + d.max(axis=1, keepdims=True))  # rounding of the bounds
                opened.append((numbers > 0) & (least <= np.frombuffer(near).reshape(-1, k)[:, -1:] + slack))
            b["cells"], b["opened"] = [np.flatnonzero(o.any(axis=0)).astype("int32") for o in opened], [o.tobytes() for o in opened]
            yield b

    asked = home.mapInPandas(visits, "cell int, block int, rep binary, v binary, d binary, other binary, cells array<int>, opened binary")
    cores = spark.sparkContext.defaultParallelism
    asked = checkpointed(asked.repartition(2 * cores, "cell", "block"))
    hosts = checkpointed(home.select(F.col("cell").alias("c"), F.col("block").alias("b"), F.col("rep").alias("ids"), F.col("v").alias("x")).repartition(cores, "c", "b"))
    met = asked.crossJoin(hosts).where(F.array_contains("cells", F.col("c")) & ((F.col("cell") != F.col("c")) | (F.col("block") != F.col("b"))))

    def away(batches):
        now = own = None

        def result():
            names, _, _, d, other, pairs = own
            return pd.DataFrame({"rep": names, "near": [[{"d": float(x), "other": int(o)} for x, o in zip(*r) if np.isfinite(x)] for r in zip(d, other)], "pairs": pairs})

        for batch in batches:
            for r in batch.itertuples(index=False):
                if (r.cell, r.block) != now:
                    if own:
                        yield result()
                    names, now = np.frombuffer(r.rep, np.int64), (r.cell, r.block)
                    own = names, vectors(r.v), np.frombuffer(r.opened, bool).reshape(len(names), -1), *ranked(r.d, r.other), np.zeros(len(names), np.int64)
                _, v, opened, d, other, pairs = own
                who, ids = np.flatnonzero(opened[:, r.c]), np.frombuffer(r.ids, np.int64)
                best, names = d[who], other[who]
                _merged(best, names, _within(v[who], vectors(r.x), best[:, -1]), ids)
                d[who], other[who] = best, names
                pairs[who] += len(ids)
        if own:
            yield result()

    def alone(batches):
        for b in batches:
            for rep, d, other in zip(b["rep"], b["d"], b["other"]):
                names = np.frombuffer(rep, np.int64)
                yield pd.DataFrame({"rep": names, "near": [[{"d": float(x), "other": int(o)} for x, o in zip(*r) if np.isfinite(x)] for r in zip(*ranked(d, other))], "pairs": len(names) - 1})

    parts = home.select("rep", "d", "other").mapInPandas(alone, f"rep long, {_NEAR}").unionByName(met.select("cell", "block", "rep", "v", "d", "other", "opened", "c", "ids", "x").mapInPandas(away, f"rep long, {_NEAR}"))
    found = checkpointed(parts)
    work = found.agg(F.sum("pairs").alias("pairs")).select("pairs", F.lit(total * (total - 1)).alias("of"))
    # a vector among the k least (d, rep) can only be pushed out by rows of those before it, so k vectors are enough
    best = found.groupBy("rep").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    copies = best.select("rep", F.explode("near").alias("x")).select("rep", "x.d", F.col("x.other").alias("other"))
    copies = copies.join(points.select(F.col("rep").alias("other"), "keys"), "other").select("rep", F.transform("keys", lambda i: F.struct(F.col("d").alias("d"), i.alias("other"))).alias("near"))
    own = points.select("rep", F.transform("keys", lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("other"))).alias("near"))
    lists = copies.unionByName(own).groupBy("rep").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    lists = lists.join(points.select("rep", "v"), "rep").select("v", "near")
    out = rows.join(lists, "v").select("key", F.slice(F.filter("near", lambda s: s["other"] != F.col("key")), 1, k).alias("near"))
    out = out.select("key", F.posexplode("near").alias("i", "x")).select("key", (F.col("i") + 1).alias("rank"), F.col("x.other").alias("other"), F.col("x.d").alias("d"))
    return out, work
