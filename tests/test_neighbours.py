"""The neighbour join against all distances."""

import math
import random

import pytest

from plinth.operators import neighbours


def plain(rows, k):
    """Every distance of every row."""
    out = {}
    for i, a in rows:
        near = sorted((math.dist(a, b), j) for j, b in rows if j != i)[:k]
        out |= {(i, r): (j, d) for r, (d, j) in enumerate(near, 1)}
    return out


def joined(spark, rows, k, **sizes):
    found, work = neighbours.neighbour_join(spark.createDataFrame(rows, "id long, x array<double>, key string, v int").withColumnRenamed("id", "name"), "name", "x", k, **sizes)
    return {(r.key, r.rank): (r.other, r.d) for r in found.collect()}, work.first()


def same(got, wanted):
    assert got.keys() == wanted.keys()
    for at, (other, d) in wanted.items():
        assert got[at][0] == other and got[at][1] == pytest.approx(d, abs=1e-12), at


def test_equals_all_distances_with_ties_copies_and_small_blocks(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(6)) for _ in range(3)]) for i in range(200)]  # a grid: many copies, many ties
    rows += [(1000 + i, [2.0, 2.0, 2.0]) for i in range(120)] + [(3000, [-0.0, 9.0, 0.0]), (3001, [0.0, 9.0, 0.0])]
    left_out = [(5000, None), (5001, []), (5002, [1.0, None, 2.0]), (5003, [1.0, float("nan"), 2.0]), (5004, [float("inf"), 0.0, 0.0])]
    got, work = joined(spark, [(i, v, "clash", 0) for i, v in rows + left_out], 4, pivots=9, block=12)
    same(got, plain(rows, 4))
    assert work.pairs <= work.of


def test_visits_few_cells_where_the_space_is_small(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(10 * (i % 20), 1), rng.gauss(5 * (i % 7), 1)]) for i in range(1200)]
    got, work = joined(spark, [(i, v, "", 0) for i, v in rows], 5)
    same(got, plain(rows, 5))
    assert work.of == 1200 * 1199 and work.pairs < 0.1 * work.of


def test_few_rows(spark):
    assert joined(spark, [], 3) == ({}, (0, 0))
    assert joined(spark, [(1, [1.0], "", 0)], 3)[0] == {}
    assert joined(spark, [(2, [1.0], "", 0), (1, [1.0], "", 0)], 3)[0] == {(1, 1): (2, 0.0), (2, 1): (1, 0.0)}
    with pytest.raises(Exception, match="components"):
        joined(spark, [(1, [1.0], "", 0), (2, [1.0, 2.0], "", 0)], 3)
