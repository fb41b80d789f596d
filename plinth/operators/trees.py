"""Histogram trees: single trees, bags, boosted chains and multi-quantile chains, grown together level by level.

Features are cut into bins once and the binned rows are written to the shared
folder, with a number for each row.  Rows that are alike in all bins reach the
same nodes whatever the tree, so they are dealt by range of their bins and
packed into runs; squared errors need only a run's sums by fold (``cells``),
pinball losses the targets of its rows.  A long run is split between tasks.

A level of all trees that grow at the same time is one job: each task sums,
for each open node, weights and gradients by feature and bin, a shuffle by
node adds the tasks' sums, and the reducers choose each node's split, so the
driver gets one row for a node.  Where all tasks together have at most
``DIRECT`` numbers, the driver adds them itself, which saves the shuffle.

Targets, and what trees predict, are rounded to multiples of 2^-20, so their
sums don't depend on the order in which they are added.  Rows are drawn by
hashed weights of their numbers, so that no tree needs a copy of the table:
trees with the same draw share its sums, at most ``DRAWS`` of them at once.

Boosted chains keep what they predict so far (their margins) with the runs,
renewed every ``RENEW`` rounds; the trees since then are added on the way.
Chains of several quantiles share their splits; a leaf's values are quantiles
of the residuals in it, from a histogram of its residuals.

Nulls in a feature are larger than every value.  Rows without a target aren't
learned from.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from plinth.session import shared_path

#: Bins of a feature, and of a leaf's residuals.
BINS, RESIDUAL_BINS = 64, 1024
#: Numbers that a task sums at once, rows that it packs and bytes that it takes at once, draws held at once, rounds between renewals of margins, numbers that the driver adds.
CELLS, ROWS, BYTES, DRAWS, RENEW, DIRECT = 4_000_000, 65_536, 16_000_000, 24, 5, 1_000_000
UNIT = 2.0**20


@dataclass(frozen=True)
class Spec:
    """How a tree grows: on which rows and features, and how far."""

    depth: int = 6
    min_split: int = 2
    min_leaf: int = 1
    rows: float = 1.0  # share of the rows, drawn with or without repeats
    repeats: bool = False
    features: float = 1.0  # share of the features, drawn for each tree
    fold: int = -1  # rows left out
    seed: int = 0
    chain: int = -1  # whose residuals are fitted; -1: the target itself


class Tree:
    """Nodes in order of growth; ``value`` has a row for each node, so a tree can be read to any depth."""

    def __init__(self, outputs: int = 1):
        self.feature, self.cut, self.left, self.right = [-1], [0], [0], [0]
        self.value, self.weight, self.gain = [np.zeros(outputs)], [0.0], [0.0]

    def split(self, node: int, feature: int, cut: int, gain: float) -> tuple[int, int]:
        k = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node], self.gain[node] = feature, cut, k, k + 1, gain
        for column, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.weight, 0.0), (self.gain, 0.0)):
            column += [x, x]
        self.value += [self.value[node], self.value[node]]
        return k, k + 1

    def arrays(self):
        return tuple(np.array(x) for x in (self.feature, self.cut, self.left, self.right))

    def frozen(self):
        """Arrays and values: what tasks need, in few objects."""
        return self.arrays(), np.array(self.value)

    def leaves(self) -> list[int]:
        return [k for k, f in enumerate(self.feature) if f < 0]


def descend(arrays, bins: np.ndarray, depth: int = 64) -> np.ndarray:
    """The node that each row reaches, at most so deep."""
    feature, cut, left, right = arrays
    node, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            break
        down = np.where(bins[every, np.maximum(f, 0)] <= cut[node], left[node], right[node])
        node = np.where(inner, down, node)
    return node


def hashed(rows: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from row numbers."""
    with np.errstate(over="ignore"):
        z = rows.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the published splitmix64 finaliser
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return (z ^ (z >> np.uint64(31))) / 2.0**64


def drawn(spec: Spec, rows: np.ndarray) -> np.ndarray | None:
    """Weights of rows: Poisson numbers with repeats, 0 or 1 without; None where each counts once."""
    if spec.repeats:
        return _times(spec.rows, hashed(rows, spec.seed))
    return (hashed(rows, spec.seed) < spec.rows).astype(float) if spec.rows < 1 else None


def _times(rate: float, u: np.ndarray) -> np.ndarray:
    """Poisson numbers from uniform ones."""
    out = np.zeros(len(u))
    for chance in np.cumsum(np.cumprod([np.exp(-rate), *(rate / k for k in range(1, 12))])):
        over = u >= chance
        if not over.any():
            break
        out += over
    return out


def draw_of(spec: Spec) -> tuple | None:
    """What trees with the same draw share."""
    return (spec.seed, spec.rows, spec.repeats) if spec.repeats or spec.rows < 1 else None


def feature_mask(spec: Spec, n: int) -> np.ndarray:
    order = np.argsort(hashed(np.arange(n), spec.seed + 7919), kind="stable")
    return np.isin(np.arange(n), order[: max(1, round(spec.features * n))])


@dataclass
class Binned:
    """The written rows (``row, fold, y, b0 ..``), the features' names, the upper edges of their bins, and what targets are measured from."""

    df: DataFrame
    columns: list[str]
    edges: list[np.ndarray]
    centre: float = 0.0
    tasks: int = 1
    _packed: DataFrame | None = None
    _cells: DataFrame | None = None

    def __post_init__(self):
        self.bins = 1 + max(map(len, self.edges))

    @staticmethod
    def of(df: DataFrame, columns, y: str = "y", fold: str | None = "fold", bins: int = BINS) -> Binned:
        columns = list(columns)
        shares = [k / bins for k in range(1, bins)]
        rows = df.where(F.col(y).isNotNull()).select(*(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)), F.col(y).cast("double").alias("y"), (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"))
        rows = _written(rows, "columns")  # read twice
        got = rows.agg(*(F.percentile_approx(f"x{k}", shares, 10_000).alias(f"e{k}") for k in range(len(columns))), F.avg("y").alias("m"), F.count(F.lit(1)).alias("n")).first()
        edges = [np.unique(np.array([x for x in (e or []) if x is not None], float)) for e in got[:-2]]

        cores = df.sparkSession.sparkContext.defaultParallelism
        want = min(cores, got.n // 10_000)
        rows = rows.repartition(want) if rows.rdd.getNumPartitions() < want else rows

        def run(batches):
            from pyspark import TaskContext

            at = TaskContext.get().partitionId() << 33
            for b in batches:
                n = b.num_rows
                cut = [pa.array(np.searchsorted(e, b.column(k).to_numpy(zero_copy_only=False)).astype(np.int16)) for k, e in enumerate(edges)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), b.column(len(edges) + 1), b.column(len(edges)), *cut], names=["row", "fold", "y", *(f"b{k}" for k in range(len(edges)))])
                at += n

        out = rows.mapInArrow(run, f"row long, fold int, y double, {', '.join(f'b{k} smallint' for k in range(len(edges)))}")
        return Binned(_written(out, "bins"), columns, edges, float(np.round((got.m or 0.0) * UNIT) / UNIT), max(1, min(2 * cores, got.n // 10_000), got.n // 2_000_000))

    @property
    def names(self) -> list[str]:
        return [f"b{k}" for k in range(len(self.columns))]

    @property
    def schema(self) -> str:
        return ", ".join(f"{b} smallint" for b in self.names)

    @property
    def packed(self) -> DataFrame:
        """A row for each run of rows with equal bins: their folds, targets and numbers as bytes."""
        if self._packed is None:
            n_features, names = len(self.columns), [*self.names, *ROW]
            dealt = self.df.repartitionByRange(self.tasks, *self.names, "row").sortWithinPartitions(*self.names, "fold")

            def run(batches):
                for t in _gathered(batches, ROWS, lambda b: b.num_rows):
                    col = lambda k: t.column(k).to_numpy()
                    bins = [col(3 + k) for k in range(n_features)]
                    first = np.flatnonzero(_changes(*bins))
                    ends = np.append(first, t.num_rows)
                    blobs = [_blob(x.astype(kind), ends) for x, kind in zip((col(1), col(2), col(0)), ROW.values())]
                    yield pa.RecordBatch.from_arrays([*(pa.array(b[first]) for b in bins), *blobs], names=names)

            self._packed = _written(dealt.mapInArrow(run, f"{self.schema}, {', '.join(f'{n} binary' for n in ROW)}"), "runs")
        return self._packed

    @property
    def cells(self) -> DataFrame:
        """A row for each run: of its rows by fold the number, and the sums of their targets and of these squared."""
        if self._cells is None:
            self._cells = _written(self.summed(()), "cells")
        return self._cells

    def summed(self, draws: tuple) -> DataFrame:
        """``cells``, with weights and weighted targets of each draw."""
        n_features, centre, names = len(self.columns), self.centre, [*self.names, *CELL]

        def run(batches):
            for x in _runs(batches, n_features, ROW):
                folds, rows, y = x.items["folds"], x.items["row"], x.items["y"] - centre
                first = np.flatnonzero(x.begins | _changes(folds))
                ends, add = np.append(first, len(folds)), lambda v: np.add.reduceat(v, first)
                target = np.round(y * UNIT) / UNIT
                w, g, seed, u = np.empty((len(first), len(draws))), np.empty((len(first), len(draws))), None, None
                for d, (s, rate, repeats) in sorted(enumerate(draws), key=lambda x: x[1]):
                    if s != seed:
                        seed, u = s, hashed(rows, s)
                    v = _times(rate, u) if repeats else (u < rate).astype(float)
                    w[:, d], g[:, d] = add(v), add(v * target)
                at = np.append(np.searchsorted(first, x.first), len(first))
                blobs = (folds[first], np.diff(ends).astype(float), add(target), add(y * y), w, g)
                yield pa.RecordBatch.from_arrays([*(pa.array(x.bins[:, k].astype(np.int16)) for k in range(n_features)), *(_blob(v, at) for v in blobs)], names=names)

        return self.packed.mapInArrow(run, f"{self.schema}, {', '.join(f'{n} binary' for n in CELL)}")


#: What runs hold of rows, and of cells.
ROW = {"folds": np.int32, "y": np.float64, "row": np.int64}
CELL = {"folds": np.int32, "n": np.float64, "s": np.float64, "q": np.float64, "w": np.float64, "g": np.float64}


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _gathered(batches, most: int, size):
    """Tables of about ``most`` at once."""
    held, total = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            total += size(b)
        if total >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _blob(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of ``values`` from each of ``ends`` to the next."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize * int(np.prod(values.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(values.tobytes())])


def _bytes(column, kind=np.uint8) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of bytes one after the other, and where each row's begin and end."""
    c = pa.concat_arrays(column.chunks).cast(pa.binary())
    at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
    held = c.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return np.frombuffer(data.tobytes(), kind), (at - at[0]) // np.dtype(kind).itemsize


class Runs:
    """Some runs in a task: bins of each, items of all one after the other, and margins."""

    def __init__(self, table: pa.Table, n_features: int, kinds: dict):
        self.bins = np.stack([table.column(k).to_numpy() for k in range(n_features)], axis=1).astype(np.int64)
        self.by_feature = np.ascontiguousarray(self.bins.T)
        self.items, ends = {}, None
        for name, kind in kinds.items():
            if name in table.column_names:
                v, at = _bytes(table.column(name), kind)
                ends = at if ends is None else ends
                self.items[name] = v
        self.first, self.lengths = ends[:-1], np.diff(ends)
        self.of = np.repeat(np.arange(len(self.first)), self.lengths)
        self.begins = np.zeros(len(self.of), bool)
        self.begins[self.first] = True
        for name in ("w", "g"):  # a column for each draw
            if name in self.items:
                self.items[name] = self.items[name].reshape(len(self.of), -1)
        self.held = _bytes(table.column("margins"), np.float64)[0].reshape(len(self.first), -1) if "margins" in table.column_names else None
        self._sums: dict = {}

    def sums(self, name: str, fold: int, inside: bool, draw: int | None = None) -> np.ndarray:
        """A cell's number for each run, of all folds but ``fold`` or (``inside``) of ``fold`` alone; -1 stands for none, and then ``inside`` for all."""
        key = (name, fold, inside, draw)
        if key not in self._sums:
            v = self.items[name] if draw is None else self.items[name][:, draw]
            if fold < 0:
                self._sums[key] = np.add.reduceat(v, self.first)
            else:
                pick = self.items["folds"] == fold
                part = np.zeros(len(self.first))
                part[self.of[pick]] = v[pick]  # a run has a fold once
                self._sums[key] = part if inside else self.sums(name, -1, False, draw) - part
        return self._sums[key]


def _runs(batches, n_features: int, kinds: dict):
    for t in _gathered(batches, BYTES, lambda b: b.nbytes):
        yield Runs(t, n_features, kinds)


@dataclass
class Loss:
    """Squared error, or pinball losses of the shares in ``alphas`` together."""

    alphas: tuple[float, ...] = ()

    @property
    def outputs(self) -> int:
        return max(1, len(self.alphas))

    def of_cells(self, x: Runs, margin: np.ndarray, fold: int, centre: float) -> np.ndarray:
        """Sum of the losses of a fold (-1: of all rows), and their number."""
        if not self.alphas:
            n, s, q, m = (*(x.sums(c, fold, True) for c in ("n", "s", "q")), margin[:, 0] - centre)
            return np.array([(q - 2 * m * s + n * m * m).sum(), n.sum()])
        pick = x.items["folds"] == fold if fold >= 0 else np.ones(len(x.of), bool)
        e = x.items["y"][pick][:, None] - margin[x.of[pick]]
        return np.array([np.maximum(np.array(self.alphas) * e, (np.array(self.alphas) - 1) * e).mean(axis=1).sum(), pick.sum()])

    def gradients(self, x: Runs, margin: np.ndarray | None, spec: Spec, draw: int | None, centre: float) -> list[np.ndarray]:
        """For each run the weight of the rows that a tree learns from, and the sums of their gradients."""
        if not self.alphas:
            w, g = (x.sums(c, spec.fold, False, draw) for c in (("n", "s") if draw is None else ("w", "g")))
            return [w, g + w * (centre - (np.round(margin[:, 0] * UNIT) / UNIT if margin is not None else 0.0))]
        weight = (x.items["folds"] != spec.fold).astype(float)
        if draw_of(spec):
            weight *= drawn(spec, x.items["row"])
        w = np.add.reduceat(weight, x.first)
        return [w, *(np.round(a * UNIT) / UNIT * w - np.add.reduceat(weight * (x.items["y"] < np.repeat(margin[:, j], x.lengths)), x.first) for j, a in enumerate(self.alphas))]


@dataclass
class Chains:
    """Boosted chains over one table: what they start from, their trees and rates, and how many of the trees are in the margins held."""

    loss: Loss
    start: np.ndarray
    rates: list[float]
    trees: list[list[Tree]]
    folds: list[int]  # on which each chain's loss is measured; -1: all rows
    held: int = 0

    def sent(self, first: int | None = None) -> Chains:
        """For tasks: the trees that the margins held lack, or those from ``first``."""
        first = self.held if first is None else first
        return replace(self, held=first, trees=[[t.frozen() for t in trees[first:]] for trees in self.trees])

    def margins(self, x: Runs, c: int) -> np.ndarray:
        """Runs x outputs, of what ``sent`` gave."""
        k = self.loss.outputs
        out = x.held[:, c * k : (c + 1) * k].copy() if self.held else np.tile(self.start, (len(x.bins), 1))
        for arrays, values in self.trees[c]:
            out += self.rates[c] * values[descend(arrays, x.bins)]
        return out


@dataclass
class Work:
    """Runs as the jobs of some rounds read them: which draws they have sums of, and how many parts."""

    table: Binned
    df: DataFrame
    kinds: dict
    draws: list
    parts: int = field(init=False)

    def __post_init__(self):
        self.parts = self.df.rdd.getNumPartitions()

    @staticmethod
    def of(table: Binned, draws: list, chains: Chains | None = None) -> Work:
        """Kept by executors until ``done``, on disk where memory ends; all of it can be made again from the written runs."""
        n_features = len(table.columns)
        if chains and chains.loss.alphas:
            df, kinds = table.packed.drop(*([] if draws else ["row"])), {k: v for k, v in ROW.items() if draws or k != "row"}
        else:
            df, kinds = table.summed(tuple(draws)) if draws else table.cells, CELL
        if chains and chains.trees[0]:
            now, names = chains.sent(0), [*df.columns, "margins"]

            def run(batches):
                for t in _gathered(batches, BYTES, lambda b: b.nbytes):
                    x = Runs(t, n_features, kinds)
                    v = np.concatenate([now.margins(x, c) for c in range(len(now.rates))], axis=1)
                    yield pa.RecordBatch.from_arrays([*(pa.concat_arrays(c.chunks) for c in t.columns), _blob(v, np.arange(len(v) + 1))], names=names)

            df = df.mapInArrow(run, f"{table.schema}, {', '.join(f'{n} binary' for n in names[n_features:])}")
            chains.held = len(chains.trees[0])
        return Work(table, df.persist(StorageLevel.MEMORY_AND_DISK), kinds, draws)

    def done(self) -> None:
        self.df.unpersist()

    def at(self, spec: Spec) -> int | None:
        key = draw_of(spec)
        return None if key is None or "n" not in self.kinds else self.draws.index(key)


def grow(table: Binned, specs: list[Spec]) -> list[Tree]:
    """A tree for each spec; those with the same draws together."""
    trees, draws = [None] * len(specs), sorted({d for s in specs if (d := draw_of(s))})
    groups = [draws[k : k + DRAWS] for k in range(0, len(draws), DRAWS)] or [[]]
    for g, group in enumerate(groups):
        own = [m for m, s in enumerate(specs) if draw_of(s) in group or (g == 0 and not draw_of(s))]
        work = Work.of(table, group)
        for m, t in zip(own, _grown(work, [specs[m] for m in own])):
            trees[m] = t
        work.done()
    return trees


def _grown(work: Work, specs: list[Spec], chains: Chains | None = None, seen: dict | None = None) -> list[Tree]:
    """A tree for each spec.  ``seen`` gets the sums of each chain's losses before it."""
    loss, table = chains.loss if chains else Loss(), work.table
    trees = [Tree(loss.outputs) for _ in specs]
    frontier = {m: [0] for m, s in enumerate(specs) if s.depth > 0}
    for depth in range(max(s.depth for s in specs)):
        found = {}
        part, cells = [], 0
        open_now = [m for m in frontier if frontier[m] and depth < specs[m].depth]
        for m in open_now:
            need = len(frontier[m]) * len(table.columns) * table.bins * (1 + loss.outputs)
            if part and cells + need > CELLS:
                found |= _splits(work, specs, trees, {i: frontier[i] for i in part}, chains, seen if depth == 0 else None)
                part, cells = [], 0
            part, cells = [*part, m], cells + need
        if part:
            found |= _splits(work, specs, trees, {i: frontier[i] for i in part}, chains, seen if depth == 0 else None)
        frontier = {m: [] for m in open_now}
        for (m, node), r in sorted(found.items()):
            t = trees[m]
            t.weight[node], t.value[node] = r["n"], np.array(r["sums"]) / max(r["n"], 1e-300) if r["n"] else np.zeros(loss.outputs)
            if r["feature"] >= 0:
                a, b = t.split(node, r["feature"], r["cut"], r["gain"])
                for child, n, sums in ((a, r["left_n"], np.array(r["left_sums"])), (b, r["n"] - r["left_n"], np.array(r["sums"]) - np.array(r["left_sums"]))):
                    t.weight[child], t.value[child] = n, sums / n
                frontier[m] += [a, b]
    return trees


def best_split(v: np.ndarray, spec: Spec, mask: np.ndarray) -> dict:
    """The split of a node with the greatest gain, from weights and gradients by feature and bin (features x bins x 1 + outputs)."""
    total = v[0].sum(axis=0)
    left = np.cumsum(v, axis=1)
    n, n_left = total[0], left[:, :, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (left[:, :, 1:] ** 2).sum(axis=2) / n_left + ((total[1:] - left[:, :, 1:]) ** 2).sum(axis=2) / (n - n_left) - (total[1:] ** 2).sum() / n
    least = max(1, spec.min_leaf)
    fit = (n_left >= least) & (n - n_left >= least) & mask[:, None]
    score = np.where(fit, score, -np.inf)
    f, b = divmod(int(score.argmax()), v.shape[1])
    split = n >= spec.min_split and score[f, b] > 1e-9
    return {"feature": f if split else -1, "cut": b, "gain": float(score[f, b]) if split else 0.0, "n": float(n), "sums": total[1:].tolist(), "left_n": float(n_left[f, b]), "left_sums": left[f, b, 1:].tolist()}


def _splits(work: Work, specs: list[Spec], trees: list[Tree], frontier: dict[int, list[int]], chains: Chains | None, seen: dict | None) -> dict:
    table, loss = work.table, chains.loss if chains else Loss()
    n_features, n_bins, centre, kinds = len(table.columns), table.bins, table.centre, work.kinds
    width, masks = 1 + loss.outputs, {m: feature_mask(specs[m], n_features) for m in frontier}
    arrays = {m: trees[m].arrays() for m in frontier}
    specs, chains = {m: specs[m] for m in frontier}, chains and chains.sent()
    at_draw = {m: work.at(specs[m]) for m in frontier}

    def sums(batches):
        total = {m: np.zeros((width, n_features, len(nodes), n_bins)) for m, nodes in frontier.items()}
        lost = {specs[m].chain: np.zeros(2) for m in frontier}
        for x in _runs(batches, n_features, kinds):
            for m, nodes in frontier.items():
                spec, place = specs[m], np.full(len(arrays[m][0]), -1)
                margin = chains.margins(x, spec.chain) if chains else None
                if seen is not None:
                    lost[spec.chain] += loss.of_cells(x, margin, chains.folds[spec.chain], centre)
                place[nodes] = np.arange(len(nodes))
                at, sent, by_feature = place[descend(arrays[m], x.bins)], loss.gradients(x, margin, spec, at_draw[m], centre), x.by_feature
                keep = at >= 0
                if not keep.all():
                    at, sent, by_feature = at[keep], [v[keep] for v in sent], by_feature[:, keep]
                at = at * n_bins
                for f in np.flatnonzero(masks[m] | (np.arange(n_features) == 0)):  # the first feature's bins give the node's own sums
                    cell = at + by_feature[f]
                    for k in range(width):
                        total[m][k, f] += np.bincount(cell, sent[k], len(nodes) * n_bins).reshape(len(nodes), n_bins)
        out = [(m, node, total[m][:, :, i].transpose(1, 2, 0).tobytes()) for m, nodes in frontier.items() for i, node in enumerate(nodes) if total[m][0, 0, i].any()]
        out += [(-1, c, v.tobytes()) for c, v in lost.items()] if seen is not None else []
        for lo in range(0, len(out), 256):
            m, node, v = zip(*out[lo : lo + 256])
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(node, pa.int32()), pa.array(v, pa.binary())], names=["m", "node", "v"])

    def choose(batches):
        total: dict = {}
        for b in batches:
            for m, node, v in zip(*(c.to_pylist() for c in b.columns)):
                v = np.frombuffer(v)
                total[m, node] = total[m, node] + v if (m, node) in total else v
        found = [chosen(m, node, v) for (m, node), v in total.items()]
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    def chosen(m, node, v):
        if m < 0:  # a chain's losses
            return {"m": m, "node": node, "feature": -1, "cut": 0, "gain": 0.0, "n": 0.0, "sums": v.tolist(), "left_n": 0.0, "left_sums": []}
        return {"m": m, "node": node, **best_split(v.reshape(n_features, n_bins, width), specs[m], masks[m])}

    schema = pa.schema([("m", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), ("gain", pa.float64()), ("n", pa.float64()), ("sums", pa.list_(pa.float64())), ("left_n", pa.float64()), ("left_sums", pa.list_(pa.float64()))])
    mapped = work.df.mapInArrow(sums, "m int, node int, v binary")
    nodes = sum(map(len, frontier.values()))
    if work.parts * nodes * n_features * table.bins * width <= DIRECT:
        total: dict = {}
        for r in mapped.collect():
            v = np.frombuffer(bytes(r.v))
            total[r.m, r.node] = total[r.m, r.node] + v if (r.m, r.node) in total else v
        found = [chosen(m, node, v) for (m, node), v in total.items()]
    else:
        found = [r.asDict() for r in _dealt(mapped, nodes).mapInArrow(choose, "m int, node int, feature int, cut int, gain double, n double, sums array<double>, left_n double, left_sums array<double>").collect()]  # one for each open node
    if seen is not None:
        seen |= {r["node"]: r["sums"] for r in found if r["m"] < 0}
    return {(r["m"], r["node"]): r for r in found if r["m"] >= 0}


def _dealt(mapped: DataFrame, nodes: int) -> DataFrame:
    return mapped.repartition(max(1, min(int(mapped.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes // 8)), "m", "node")


def _task_sums(df: DataFrame, parts: int, n_features: int, kinds: dict, fill, size: int) -> np.ndarray:
    """The sum over tasks of a vector that ``fill`` adds some runs to; its length doesn't grow with the rows."""

    def run(batches):
        v = np.zeros(size)
        for x in _runs(batches, n_features, kinds):
            fill(v, x)
        held = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array([held.astype(np.int64).tobytes()], pa.binary()), pa.array([v[held].tobytes()], pa.binary())], names=["k", "v"])

    def numbers(batches):
        for b in batches:
            k, v = (np.concatenate([np.frombuffer(x) if j else np.frombuffer(x, np.int64) for x in c.to_pylist()]) for j, c in enumerate(b.columns))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v)], names=["k", "v"])

    out, sums = np.zeros(size), df.mapInArrow(run, "k binary, v binary")
    if parts * size <= DIRECT:
        for r in sums.collect():
            out[np.frombuffer(bytes(r.k), np.int64)] += np.frombuffer(bytes(r.v))
        return out
    for r in sums.mapInArrow(numbers, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out


def errors_by_depth(table: Binned, specs: list[Spec], groups: list[list[Tree]], numbers: list[int], depths: list[int]) -> np.ndarray:
    """Mean squared error on each model's left-out fold: models x numbers of trees x depths; a model is the mean of its trees."""
    shape, groups, centre = (len(groups), len(numbers), len(depths)), [[t.frozen() for t in ts] for ts in groups], table.centre

    def fill(v, x):
        v = v.reshape(*shape, 2)
        for m, (spec, trees) in enumerate(zip(specs, groups)):
            n = x.sums("n", spec.fold, True)
            out = n > 0
            n, s, q, bins = n[out], x.sums("s", spec.fold, True)[out], x.sums("q", spec.fold, True)[out], x.bins[out]
            for d, depth in enumerate(depths):
                total = np.zeros(len(n))
                for k, (arrays, values) in enumerate(trees, 1):
                    total += values[descend(arrays, bins, depth), 0]
                    if k in numbers:
                        p = total / k - centre
                        v[m, numbers.index(k), d] += [(q - 2 * p * s + n * p * p).sum(), n.sum()]

    cells = table.cells
    sums = _task_sums(cells, cells.rdd.getNumPartitions(), len(table.columns), CELL, fill, int(np.prod(shape)) * 2).reshape(*shape, 2)
    return sums[..., 0] / np.maximum(1, sums[..., 1])


def quantile_leaves(work: Work, specs: list[Spec], trees: list[Tree], chains: Chains, reach: float) -> None:
    """Sets each leaf's values to the quantiles of its rows' residuals, interpolated within a bin of their histogram."""
    k, n_features = chains.loss.outputs, len(work.table.columns)
    leaves = [t.leaves() for t in trees]
    first = np.cumsum([0, *map(len, leaves)])
    width = 2 * reach / RESIDUAL_BINS
    arrays, now = [t.arrays() for t in trees], chains.sent()

    def fill(v, x):
        for m, (spec, own) in enumerate(zip(specs, leaves)):
            place = np.full(len(arrays[m][0]), -1)
            place[own] = first[m] + np.arange(len(own))
            w, keep = drawn(spec, x.items["row"]) if draw_of(spec) else None, x.items["folds"] != spec.fold
            y, run = x.items["y"][keep], x.of[keep]
            at, margin = place[descend(arrays[m], x.bins)] * k * RESIDUAL_BINS, now.margins(x, spec.chain)
            for j in range(k):
                e = np.clip((y + (reach - margin[:, j])[run]) / width, 0, RESIDUAL_BINS - 1).astype(np.int64)
                v += np.bincount(e + (at + j * RESIDUAL_BINS)[run], None if w is None else w[keep], len(v))

    sums = _task_sums(work.df, work.parts, n_features, work.kinds, fill, int(first[-1]) * k * RESIDUAL_BINS).reshape(-1, k, RESIDUAL_BINS)
    for m, own in enumerate(leaves):
        for i, leaf in enumerate(own):
            trees[m].value[leaf] = np.array([histogram_quantile(sums[first[m] + i, j], a) * width - reach for j, a in enumerate(chains.loss.alphas)])


def histogram_quantile(counts: np.ndarray, share: float) -> float:
    """Where ``share`` of the counts lies below, in bins; the middle of all bins if there are none."""
    total = counts.sum()
    if not total:
        return len(counts) / 2
    upto = np.cumsum(counts)
    b = int(np.searchsorted(upto, share * total))
    return b + (share * total - (upto[b] - counts[b])) / counts[b]


def shapley(tree: Tree, bins: np.ndarray, output: int = 0) -> tuple[np.ndarray, float]:
    """Path-dependent Shapley values (rows x features) of a tree, and its mean over the rows that it grew on.

    Features that aren't known follow both branches by their rows' shares.  A leaf counts for a set of features by a product
    over the features of its path: whether the row satisfies their conditions if they are known, their share if not.  The sums
    over all sets of a size are coefficients of a polynomial.
    """
    out, mean = np.zeros(bins.shape), 0.0
    stack = [(0, {})]
    while stack:
        node, path = stack.pop()
        f = tree.feature[node]
        if f >= 0:
            for child, low in ((tree.left[node], True), (tree.right[node], False)):
                share, met = path.get(f, (1.0, np.ones(len(bins), bool)))
                stack.append((child, path | {f: (share * tree.weight[child] / tree.weight[node], met & ((bins[:, f] <= tree.cut[node]) == low))}))
            continue
        value, d = float(tree.value[node][output]), len(path)
        mean += value * float(np.prod([share for share, _ in path.values()]))
        for g, (share, met) in path.items():
            poly = np.zeros((d, len(bins)))
            poly[0] = 1
            for k, (z, o) in enumerate((z, o) for h, (z, o) in path.items() if h != g):
                poly[1 : k + 2] = poly[1 : k + 2] * z + poly[: k + 1] * o
                poly[0] *= z
            weights = [factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)]
            out[:, g] += value * (met - share) * (np.array(weights) @ poly)
    return out, mean


class Regions:
    """Shapley values of a tree by the intervals between its cuts that a row's bins lie in, each met region computed once."""

    def __init__(self, tree: Tree, output: int = 0):
        self.tree, self.output = tree, output
        self.cuts = [np.unique([c for f, c in zip(tree.feature, tree.cut) if f == k]) for k in range(max([0, *(f + 1 for f in tree.feature)]))]
        self.mean, self.codes, self.values = shapley(tree, np.zeros((1, max(1, len(self.cuts))), np.int64), output)[1], np.empty(0, np.int64), None

    def shapley(self, bins: np.ndarray) -> np.ndarray:
        code = np.zeros(len(bins), np.int64)
        for k, cuts in enumerate(self.cuts):
            if len(cuts):
                if code.max(initial=0) > 2**40:  # more cuts than a whole number counts
                    return shapley(self.tree, bins, self.output)[0]
                code = code * (len(cuts) + 1) + np.searchsorted(cuts, bins[:, k])
        at = np.searchsorted(self.codes, code)
        new = (at == len(self.codes)) | (np.append(self.codes, -1)[at] != code)
        if new.any():
            found, first = np.unique(code[new], return_index=True)
            values = shapley(self.tree, bins[new][first], self.output)[0]
            codes = np.append(self.codes, found)
            order = np.argsort(codes)
            self.codes, self.values = codes[order], (values if self.values is None else np.concatenate([self.values, values]))[order]
            at = np.searchsorted(self.codes, code)
        return self.values[at] if len(code) else np.zeros(bins.shape)


@dataclass
class Boosted:
    """A fitted chain on named features: split values in place of bins."""

    columns: list[str]
    edges: list[np.ndarray]
    start: np.ndarray
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def values(self, x: np.ndarray, frozen=None) -> np.ndarray:
        """``frozen``: the trees' arrays, where many batches share them."""
        bins = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(self.edges)], axis=1)
        out = np.tile(self.start, (len(x), 1))
        for arrays, values in frozen or [t.frozen() for t in self.trees]:
            out += self.rate * values[descend(arrays, bins)]
        return out

    def transform(self, df: DataFrame, names: list[str], key: str, ordered: bool = False) -> DataFrame:
        """``key`` and one column for each output; ``ordered``: outputs of a row ascend."""
        model, kind = self, df.schema[key].dataType.simpleString()

        def run(batches):
            frozen = [t.frozen() for t in model.trees]
            for b in batches:
                v = model.values(np.stack([b.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(model.columns))], axis=1), frozen)
                v = np.sort(v, axis=1) if ordered else v
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v[:, k]) for k in range(v.shape[1]))], names=[key, *names])

        return df.select(key, *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(self.columns))).mapInArrow(run, f"`{key}` {kind}, {', '.join(f'{n} double' for n in names)}")

    def contributions(self, x: np.ndarray, output: int = 0, known: list | None = None) -> tuple[np.ndarray, float]:
        """Shapley values of each feature for each row, and the mean prediction that they are measured from.

        Rows between the same cuts of a tree have the same values of it; ``known`` keeps them for later calls.
        """
        bins = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(self.edges)], axis=1)
        total, base = np.zeros(x.shape), float(self.start[output])
        known = [] if known is None else known
        if not known:
            known += [Regions(t, output) for t in self.trees]
        for t in known:
            total += self.rate * t.shapley(bins)
            base += self.rate * t.mean
        return total, base

    def attributed(self, df: DataFrame, key: str, output: int = 0) -> DataFrame:
        """``key, base, prediction`` and ``contribution_<feature>``: exact, by the paths of the stored trees, in Arrow batches."""
        model, kind = self, df.schema[key].dataType.simpleString()
        names = [key, "base", "prediction", *(f"contribution_{c}" for c in self.columns)]

        def run(batches):
            known, frozen = [], [t.frozen() for t in model.trees]
            for b in batches:
                x = np.stack([b.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(model.columns))], axis=1)
                part, base = model.contributions(x, output, known)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(x), base)), pa.array(model.values(x, frozen)[:, output]), *(pa.array(part[:, k]) for k in range(x.shape[1]))], names=names)

        rows = df.select(key, *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(self.columns)))
        return rows.mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"`{n}` double" for n in names[1:])]))

    def importances(self) -> dict[str, float]:
        """Shares of the trees' gains by feature."""
        gains = dict.fromkeys(self.columns, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    gains[self.columns[f]] += g
        whole = sum(gains.values()) or 1.0
        return {c: g / whole for c, g in gains.items()}


def boost(table: Binned, specs: list[Spec], rates: list[float], rounds: int, loss: Loss | None = None, patience: int | None = None, valid_fold: int | None = None):
    """Boosted chains, one for each spec, all grown in the same jobs; ``(models, losses)``.

    ``losses`` has for each chain its mean loss on the fold it leaves out (``valid_fold``, where its spec leaves none out) before
    each round and after the last.  A chain ends after ``patience`` rounds without gain, and keeps its trees up to the best.
    """
    loss = loss or Loss()
    level = table.df.where(F.col("fold") != (valid_fold if valid_fold is not None else -1))
    r = level.agg(F.percentile_approx("y", list(loss.alphas) or [0.5], 10_000).alias("q"), F.avg("y").alias("m"), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    start = np.array(r.q if loss.alphas else [r.m], float)
    folds = [s.fold if s.fold >= 0 or valid_fold is None else valid_fold for s in specs]
    chains = Chains(loss, start, list(rates), [[] for _ in specs], folds)
    reach = float(r.hi - r.lo) or 1.0
    losses: list[list[float]] = [[] for _ in specs]
    best = [(np.inf, 0)] * len(specs)
    going = list(range(len(specs)))

    def note(sums) -> None:
        for c in going:
            losses[c].append(sums[c][0] / max(1, sums[c][1]))
            if losses[c][-1] < best[c][0] - 1e-12:
                best[c] = (losses[c][-1], len(losses[c]) - 1)

    def round_of(t: int) -> list[Spec]:
        return [replace(specs[c], seed=specs[c].seed + 1000003 * (t + 1), chain=c, fold=specs[c].fold if specs[c].fold >= 0 or valid_fold is None else valid_fold) for c in going]

    work = None
    for t in range(rounds):
        if work is None or t - renewed >= RENEW or any(d and d not in work.draws for d in map(draw_of, round_of(t))):
            work, old, renewed, draws = None, work, t, []
            for later in range(t, min(t + RENEW, rounds)):  # as many rounds as there is room for draws, at least one
                new = sorted({d for d in map(draw_of, round_of(later)) if d})
                if draws and len(draws) + len(new) > DRAWS:
                    break
                draws += new
            work = Work.of(table, draws, chains)
            if old:
                old.done()
        own = round_of(t)
        seen: dict = {}
        trees = _grown(work, own, chains, seen)
        note(seen)
        going, grown = [c for c in going if patience is None or t - best[c][1] < patience], going
        if not going:
            break
        if loss.alphas:
            quantile_leaves(work, own, trees, chains, 1.5 * reach)
        fresh = dict(zip(grown, trees))
        for c in range(len(specs)):
            chains.trees[c].append(fresh[c] if c in going else Tree(loss.outputs))
    else:
        if work:
            note(_losses(work, chains))
    if work:
        work.done()
    models = [Boosted(table.columns, table.edges, start, rates[c], chains.trees[c][: best[c][1]] if patience is not None else chains.trees[c]) for c in range(len(specs))]
    return models, losses


def _losses(work: Work, chains: Chains) -> np.ndarray:
    chains, centre = chains.sent(), work.table.centre

    def fill(v, x):
        v = v.reshape(-1, 2)
        for c in range(len(chains.rates)):
            v[c] += chains.loss.of_cells(x, chains.margins(x, c), chains.folds[c], centre)

    return _task_sums(work.df, work.parts, len(work.table.columns), work.kinds, fill, 2 * len(chains.rates)).reshape(-1, 2)
