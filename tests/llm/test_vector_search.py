"""Block-at-a-time search against scoring everything."""

import math

import numpy as np

from plinth.llm import vector_search


def brute(rows, k, every):
    v = {}
    sound = [(i, [math.floor(256 * float(x)) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    for q, a in sound:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q)[:k]
            v[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return v


def got(df, **kw):
    out = {}
    for r in vector_search.top_k(df, **kw).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


SCHEMA = "vec_id long, embedding array<float>, score string"


def test_equals_brute_force_with_ties_copies_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", 16)
    monkeypatch.setattr(vector_search, "CHUNK", 8)
    monkeypatch.setattr(vector_search, "PIVOTS", 5)
    monkeypatch.setattr(vector_search, "GROUP", 30)
    monkeypatch.setattr(vector_search, "LEAST_PART", 50)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    x = (centres[rng.integers(0, 6, 400)] + 0.2 * rng.normal(size=(400, 8))).astype(np.float32)
    x[100:180] = x[0]  # one very common vector
    x[200:220] = np.round(x[200:220])
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(400, None), (405, [None] * 8), (410, [float("nan")] * 8), (415, [float("inf")] + [0.0] * 7), (420, [0.0] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert got(df, k=5, every=5) == brute(rows, 5, 5)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (3, [0.0, -1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert got(df) == brute(rows, 5, 50)
    assert got(df.limit(0)) == {}


def test_large_components_and_mixed_lengths(spark, monkeypatch):
    """Sums past what doubles hold, and past longs; inner products of the common places; copies of an id."""
    monkeypatch.setattr(vector_search, "LEAST_PART", 20)
    rng = np.random.default_rng(5)
    for scale, rows in ((1e7, 60), (3e9, 60), (1e30, 20), (0.01, 60)):
        data = [(int(i), [float(c) for c in rng.normal(size=rng.integers(0, 6)) * scale]) for i in range(rows)]
        data += [(60, [scale] * 4), (61, [scale] * 4), (65, [-scale]), (70, [])]
        df = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<double>, score string")
        want = {q: [(n, i, max(-(1 << 63), min((1 << 63) - 1, s))) for n, i, s in x] for q, x in brute(data, 5, 5).items()}
        assert got(df, k=5, every=5) == want, scale
    one = spark.createDataFrame([(0, [1e308]), (1, [1.0])], "vec_id long, embedding array<double>")
    assert got(one) == {}  # 256 times the component isn't finite


def test_bounds_prune_clusters(spark, monkeypatch):
    """What is multiplied: a part where vectors stand in clusters."""
    monkeypatch.setattr(vector_search, "LEAST_PART", 500)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 16))).astype(np.float32)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    scored = spark.sparkContext.accumulator(0)
    assert got(df, scored=scored) == brute(rows, 5, 50)
    share = scored.value / (4000 * 80)
    print("share of products made:", share)
    assert share < 0.5
