"""What held on small tables only: digits that sums lose, and work that grew with the rows."""

import numpy as np
from pyspark.sql import functions as F

from plinth.operators import impute, neighbours, trees
from plinth.plans import modelling
from plinth.sources import pages


def test_regular_pipeline_keeps_the_digits_of_least_squares(spark):
    df = spark.range(40_000).select(*((F.pmod(F.xxhash64("id", F.lit(c)), F.lit(n)) * step + low).cast("double").alias(c) for c, n, step, low in (("engine_cc_val", 50, 50, 1000), ("mileage", 50, 1000, 1000), ("year", 7, 1, 1992), ("risk", 13, 9, 0))))
    df = df.withColumn("y", F.log1p(F.lit(900.0) + F.pmod(F.xxhash64("mileage", "year", "risk"), F.lit(100_000))))
    got = np.array(modelling.regular_pipeline().fit(df).transform(df).select(*modelling.REGULAR, "y", "prediction").collect())
    x, y = got[:, :4], got[:, 4]
    z = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / x.std(axis=0)])
    want = z @ np.linalg.lstsq(z, y, rcond=None)[0]
    assert np.abs(got[:, 5] - want).max() < 2e-13


def _repeated(spark, times):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(2 * (a > 4) + b + e), int(k)) for a, b, e, k in zip(rng.integers(0, 9, 400), rng.integers(0, 4, 400), rng.normal(size=400).round(3), rng.integers(0, 5, 400))]
    df = spark.createDataFrame(rows, "a double, b double, y double, fold int")
    return trees.Binned.of(df.crossJoin(spark.range(times)).drop("id").repartition(3), ["a", "b"], bins=16)


def test_trees_read_runs_of_equal_bins(spark):
    """A hundred copies of each row make the same trees from no more cells, but for runs that are split; errors by fold come from sums."""
    one, many = _repeated(spark, 1), _repeated(spark, 100)
    assert many.df.count() == 40_000 and many.cells.count() <= one.cells.count() + 2 * many.tasks
    specs = [trees.Spec(depth=3, fold=k) for k in range(2)]
    a, b = trees.grow(one, specs), trees.grow(many, specs)
    assert [t.feature for t in a] == [t.feature for t in b] and [t.cut for t in a] == [t.cut for t in b]
    assert all(np.allclose(np.array(s.value), np.array(t.value)) and np.allclose(100 * np.array(s.weight), t.weight) for s, t in zip(a, b))
    assert np.allclose(trees.errors_by_depth(one, specs, [[t] for t in a], [1], [3]), trees.errors_by_depth(many, specs, [[t] for t in b], [1], [3]))


def test_draws_of_trees_that_share_them_come_in_groups(spark, monkeypatch):
    table = _repeated(spark, 5)
    specs = [trees.Spec(depth=3, rows=r, repeats=p, fold=k, seed=s) for s in (1, 2, 3) for r, p in ((0.6, True), (1.0, True), (0.7, False), (1.0, False)) for k in (0, 1)]
    whole = trees.grow(table, specs)
    monkeypatch.setattr(trees, "DRAWS", 2)
    parts = trees.grow(table, specs)
    assert [(t.feature, t.cut, t.weight) for t in whole] == [(t.feature, t.cut, t.weight) for t in parts]
    p = table.df.toPandas()
    for spec, tree in zip(specs, whole):
        w = trees.drawn(spec, p["row"].to_numpy())
        assert tree.weight[0] == ((np.ones(len(p)) if w is None else w) * (p["fold"] != spec.fold)).sum()


def test_contributions_are_computed_once_for_each_region(spark, monkeypatch):
    table = _repeated(spark, 1)
    [model], _ = trees.boost(table, [trees.Spec(depth=3)], [0.3], 3)
    met, plain = [], trees.shapley
    monkeypatch.setattr(trees, "shapley", lambda tree, bins, output=0: met.append(len(bins)) or plain(tree, bins, output))
    x, known = np.random.default_rng(1).integers(0, 9, (5000, 2)).astype(float), []
    for part in np.array_split(x, 5):
        got, base = model.contributions(part, 0, known)
        bins = np.stack([np.searchsorted(e, part[:, k]) for k, e in enumerate(model.edges)], axis=1)
        want = sum(model.rate * plain(t, bins)[0] for t in model.trees)
        assert np.allclose(got, want) and np.allclose(got.sum(axis=1) + base, model.values(part)[:, 0])
    assert sum(met) < 500


def test_modes_join_rows_once(spark):
    rows = [(i, None if i % 17 == 0 else f"m{i % 6}", f"b{i % 3}", None if i % 2 or i % 6 == 4 else f"v{i * 7 % 5}", None if i % 5 else i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, model string, brand string, seg string, code int")
    levels = (("model", "brand"), ("model",), ("brand",))
    out = impute.mode_hierarchical(df, ["seg", "code"], levels)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # one for each column, none for a level
    got = {r.id: r for r in out.collect()}
    for at, c in ((3, "seg"), (4, "code")):
        for r in rows:
            want = (r[at], "Original")
            for level in (*levels, ()) if r[at] is None else ():
                own = [1 + ("model", "brand").index(k) for k in level]
                held = [x[at] for x in rows if x[at] is not None and all(x[k] == r[k] and r[k] is not None for k in own)]
                if held:
                    want = (min(set(held), key=lambda v: (-held.count(v), v)), " & ".join(level) or "Overall")
                    break
            assert (str(got[r[0]][c]), got[r[0]][c + "_imputed"]) == (str(want[0]), want[1])


def test_neighbours_write_no_row_for_each_visit(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(240, 16))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    written, plain = [], neighbours.checkpointed
    monkeypatch.setattr(neighbours, "checkpointed", lambda d: written.append(out := plain(d)) or out)
    near, work = neighbours.neighbour_join(df, "id", "v", 3, block=20)
    got = {(r.key, r["rank"]): r.other for r in near.collect()}
    gap = neighbours.distances(x, x)
    np.fill_diagonal(gap, np.inf)
    assert got == {(i, r + 1): int(j) for i in range(240) for r, j in enumerate(np.argsort(gap[i])[:3])}
    assert work.first().pairs > 240 * 120  # in 16 even dimensions bounds keep little away
    assert max(d.count() for d in written if "v" in d.columns) <= 240


def _shape(x):
    return x if isinstance(x, str) else (x.tag, x.attrs, [_shape(i) for i in x.items])


def test_plain_pages_are_read_as_the_parser_reads_them():
    plain = ['<html><body><div class="a b" id="c">x &amp; y &lt z</p> > <br>t<ul><li>1<li>2</ul></div> tail &copy', '<p>a</b></p>b</p>', "no tag &amp;", "", '<div class=""><img src="u?a=1">q</div></html>&am']
    other = ["<P>a</P>", "<p class=x>a</p>", "<p>a < b</p> c>", "<script>if (a<b) x</script>", "<p>a<!-- <b> -->c</p>", '<p title="a>b">c</p>', "<br/>a", "<title>a<b></title>", "<p", "a<", '<p a="1"b="2">c</p>', "<p >a</p >", '<p t="&lt;">a</p>']
    for page in plain + other:
        b = pages._Builder()
        b.feed(page)
        b.close()
        assert _shape(pages.tree(page)) == _shape(b.root), page
        assert (pages._plain_tree(page) is not None) == (page in plain), page
