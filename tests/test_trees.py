"""Histogram trees against plain numpy versions, and Shapley values against all subsets."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.operators import trees as T

COLUMNS = ["a", "b", "c", "d"]


def _data(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.normal(size=n).round(2), rng.integers(0, 3, n), rng.exponential(size=n).round(1)]).astype(float)
    y = 2 * (x[:, 0] > 5) + x[:, 1] * (x[:, 2] == 1) + 0.3 * rng.normal(size=n) * (1 + x[:, 0] / 6)
    return x, y.round(4), rng.integers(0, 5, n)


@pytest.fixture(scope="module")
def table(spark):
    x, y, fold = _data()
    rows = [(*map(float, r), float(t), int(k)) for r, t, k in zip(x, y, fold)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double, fold int").repartition(3)
    return T.Binned.of(df, COLUMNS, bins=16), df


def _pandas(table):
    p = table.df.toPandas()
    return p[[f"b{k}" for k in range(4)]].to_numpy(np.int64), p["y"].to_numpy(), p["fold"].to_numpy(), p["row"].to_numpy()


def _plain_tree(bins, g, w, depth, min_split, min_leaf, mask):
    """Nested (feature, cut, left, right) or the mean, grown greedily on rounded gradients."""
    n, total = w.sum(), (w[:, None] * g).sum(axis=0)
    best = (1e-9, None)
    if depth and n >= min_split:
        for f in np.flatnonzero(mask):
            for cut in range(bins[:, f].max() + 1):
                low = bins[:, f] <= cut
                nl = w[low].sum()
                if nl < max(1, min_leaf) or n - nl < max(1, min_leaf):
                    continue
                left = (w[low, None] * g[low]).sum(axis=0)
                gain = (left**2).sum() / nl + ((total - left) ** 2).sum() / (n - nl) - (total**2).sum() / n
                if gain > best[0] + 1e-12:
                    best = (gain, (f, cut))
    if best[1] is None:
        return total / n
    f, cut = best[1]
    low = bins[:, f] <= cut
    return f, cut, *(_plain_tree(bins[s], g[s], w[s], depth - 1, min_split, min_leaf, mask) for s in (low, ~low))


def _plain_values(tree, bins):
    if not isinstance(tree, tuple):
        return np.tile(tree, (len(bins), 1))
    f, cut, left, right = tree
    low = bins[:, f : f + 1] <= cut
    return np.where(low, _plain_values(left, bins), _plain_values(right, bins))


def _values(tree, bins, depth=64):
    return np.array(tree.value)[T.descend(tree.arrays(), bins, depth)]


SPECS = [T.Spec(depth=3), T.Spec(depth=4, min_split=60, min_leaf=5, fold=2), T.Spec(depth=3, rows=0.7, repeats=True, features=0.5, seed=9), T.Spec(depth=5, rows=0.6, seed=4, min_leaf=3), T.Spec(depth=0)]


@pytest.mark.parametrize("direct", [1_000_000, 0])
def test_trees_equal_a_plain_version(table, monkeypatch, direct):
    monkeypatch.setattr(T, "DIRECT", direct)  # sums added by the driver, and by a shuffle
    monkeypatch.setattr(T, "CELLS", 500)  # several jobs a level
    binned, _ = table
    bins, y, fold, row = _pandas(binned)
    g = np.round(y[:, None] * T.UNIT) / T.UNIT
    for spec, tree in zip(SPECS[:4], T.grow(binned, SPECS[:4])):
        w = T.drawn(spec, row)
        w = (np.ones(len(y)) if w is None else w) * (fold != spec.fold)
        keep = w > 0
        want = _plain_tree(bins[keep], g[keep], w[keep], spec.depth, spec.min_split, spec.min_leaf, T.feature_mask(spec, 4))
        assert np.allclose(_values(tree, bins), _plain_values(want, bins)), spec
        assert min(tree.weight[k] for k in tree.leaves()) >= spec.min_leaf
        shallow = _plain_tree(bins[keep], g[keep], w[keep], 2, spec.min_split, spec.min_leaf, T.feature_mask(spec, 4))
        assert np.allclose(_values(tree, bins, 2), _plain_values(shallow, bins))


def test_draws():
    rows = np.arange(200_000)
    for spec, mean in ((T.Spec(rows=0.6, repeats=True), 0.6), (T.Spec(rows=1.0, repeats=True), 1.0), (T.Spec(rows=0.8), 0.8)):
        w = T.drawn(spec, rows)
        assert abs(w.mean() - mean) < 0.01
        assert abs(w.var() - (mean if spec.repeats else mean * (1 - mean))) < 0.02
        assert abs(np.corrcoef(w, T.drawn(T.replace(spec, seed=1), rows))[0, 1]) < 0.01
    assert {int(T.feature_mask(T.Spec(features=0.5, seed=k), 4).sum()) for k in range(20)} == {2}
    assert len({tuple(T.feature_mask(T.Spec(features=0.5, seed=k), 4)) for k in range(20)}) > 3


def test_errors_by_depth_and_number(table):
    binned, _ = table
    bins, y, fold, _ = _pandas(binned)
    specs = [T.Spec(depth=3, rows=1.0, repeats=True, fold=1, seed=k) for k in range(4)]
    grown = T.grow(binned, specs)
    got = T.errors_by_depth(binned, [specs[0]], [grown], [1, 4], [1, 3])
    out = fold == 1
    for i, n in enumerate((1, 4)):
        for j, d in enumerate((1, 3)):
            p = np.mean([_values(t, bins[out], d)[:, 0] for t in grown[:n]], axis=0)
            assert np.isclose(got[0, i, j], ((y[out] - p) ** 2).mean())


def test_boosting_equals_a_plain_version(table, monkeypatch):
    monkeypatch.setattr(T, "RENEW", 2)  # margins are written twice
    binned, _ = table
    bins, y, fold, row = _pandas(binned)
    specs, rates = [T.Spec(depth=2, fold=0), T.Spec(depth=3, rows=0.8, fold=3, seed=5)], [0.3, 0.1]
    models, losses = T.boost(binned, specs, rates, 5)
    for c, (spec, rate) in enumerate(zip(specs, rates)):
        margin = np.full(len(y), y.mean())
        out = fold == spec.fold
        for t in range(5):
            assert np.isclose(losses[c][t], ((y - margin)[out] ** 2).mean())
            own = T.replace(spec, seed=spec.seed + 1000003 * (t + 1))
            w = T.drawn(own, row)
            w = (np.ones(len(y)) if w is None else w) * ~out
            keep = w > 0
            g = np.round((y - margin)[:, None] * T.UNIT) / T.UNIT
            tree = _plain_tree(bins[keep], g[keep], w[keep], spec.depth, 2, 1, np.ones(4, bool))
            margin = margin + rate * _plain_values(tree, bins)[:, 0]
        assert np.isclose(losses[c][5], ((y - margin)[out] ** 2).mean())
        assert losses[c][5] < losses[c][0]
        assert len(models[c].trees) == 5


def test_quantile_boosting(table, spark):
    """First-round leaves are the quantiles of their residuals, losses fall, and the held-out rows are covered."""
    binned, df = table
    bins, y, fold, _ = _pandas(binned)
    loss = T.Loss((0.05, 0.5, 0.95))
    [model], [losses] = T.boost(binned, [T.Spec(depth=3, min_leaf=20)], [0.2], 12, loss, valid_fold=0)
    first, inside = model.trees[0], fold != 0
    node = T.descend(first.arrays(), bins)
    for leaf in first.leaves():
        e = (y - model.start[:, None])[:, inside & (node == leaf)]
        assert np.allclose([np.quantile(e[j], a, method="inverted_cdf") for j, a in enumerate(loss.alphas)], first.value[leaf], atol=0.02)
    assert losses[12] < 0.85 * losses[0]
    scored = model.transform(df.where("fold = 0").withColumn("k", F.struct("y", "fold")), ["lo", "mid", "hi"], "k", ordered=True).select("k.y", "lo", "mid", "hi").collect()
    assert len(scored) == (fold == 0).sum() and all(r.lo <= r.mid <= r.hi for r in scored)
    assert 0.8 <= np.mean([r.lo <= r.y <= r.hi for r in scored]) <= 0.97


def test_early_stop(table):
    binned, _ = table
    [model], [losses] = T.boost(binned, [T.Spec(depth=4)], [1.0], 40, patience=3, valid_fold=0)
    best = int(np.argmin(losses))
    assert len(model.trees) == best < 40 and len(losses) == best + 4


def _known(tree, node, x, known):
    f = tree.feature[node]
    if f < 0:
        return tree.value[node][0]
    a, b = tree.left[node], tree.right[node]
    if f in known:
        return _known(tree, a if x[f] <= tree.cut[node] else b, x, known)
    return (tree.weight[a] * _known(tree, a, x, known) + tree.weight[b] * _known(tree, b, x, known)) / tree.weight[node]


def test_shapley_equals_all_subsets(table):
    binned, _ = table
    bins, *_ = _pandas(binned)
    for tree in T.grow(binned, [T.Spec(depth=5), T.Spec(depth=2, min_leaf=30), T.Spec(depth=0)]):
        got, mean = T.shapley(tree, bins[:25])
        for i, x in enumerate(bins[:25]):
            want = [sum(factorial(r) * factorial(3 - r) / 24 * (_known(tree, 0, x, {*s, f}) - _known(tree, 0, x, set(s))) for r in range(4) for s in combinations([k for k in range(4) if k != f], r)) for f in range(4)]
            assert np.allclose(got[i], want)
        assert np.allclose(got.sum(axis=1) + mean, _values(tree, bins[:25])[:, 0])


def test_attributions_add_up(table):
    binned, df = table
    [model], _ = T.boost(binned, [T.Spec(depth=3)], [0.3], 4)
    rows = model.attributed(df.withColumn("id", F.monotonically_increasing_id()), "id").collect()
    assert len(rows) == 600
    assert all(abs(r.base + sum(r[f"contribution_{c}"] for c in COLUMNS) - r.prediction) < 1e-9 for r in rows)
    assert abs(np.mean([r.prediction for r in rows]) - rows[0].base) < 1e-6
    assert abs(sum(model.importances().values()) - 1) < 1e-9


def test_nulls_constants_and_empty(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0), (2.0, 1.0, 5.0), (3.0, 1.0, 5.0), (3.0, 1.0, None)], "a double, b double, y double")
    binned = T.Binned.of(df, ["a", "b"], fold=None, bins=4)
    assert binned.df.count() == 3
    [tree] = T.grow(binned, [T.Spec(depth=2)])
    p = binned.df.toPandas()
    assert np.allclose(_values(tree, p[["b0", "b1"]].to_numpy())[:, 0], p["y"])
    empty = T.Binned.of(df.where("false"), ["a", "b"], fold=None)
    assert T.grow(empty, [T.Spec(depth=2)])[0].feature == [-1]
