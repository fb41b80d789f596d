"""Closed forms and invariants of the operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.operators import aggregates as agg
from plinth.operators import association, encode, evaluate, filters, impute, models, outliers, profile
from plinth.sources import io, pages
from plinth.streaming import ingest


def test_filter_dynamic_skips_what_says_nothing(spark):
    df = spark.createDataFrame([("a", 0), ("b", 5), ("c", 9)], "k string, v int")
    assert filters.filter_dynamic(df, {"k": filters.ALL}, {"v": 0}, {"v": None}).count() == 3
    assert [r.k for r in filters.filter_dynamic(df, {"k": "b"}, {"v": 1}, {"v": 5}).collect()] == ["b"]


def test_insert_only_is_idempotent(spark, tmp_path):
    target = f"{tmp_path}/t"
    first = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 1), (None, "x", 1)], "id long, v string, t int")
    for _ in range(2):
        io.append_new(first, target, "id", ["t"])
    io.append_new(spark.createDataFrame([(1, "new", 0), (3, "d", 1)], "id long, v string, t int"), target, "id", ["t"])
    assert sorted((r.id, r.v) for r in spark.read.parquet(target).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_upsert_replaces_and_adds(spark):
    old = spark.createDataFrame([("v1", 1, "x"), ("v2", 2, "y")], "id string, d int, m string")
    new = spark.createDataFrame([("v1", 0, "z"), ("v3", 3, "w")], "id string, d int, m string")
    assert [tuple(r) for r in io.upsert(old, new, "id", "d").collect()] == [("v3", 3, "w"), ("v2", 2, "y"), ("v1", 0, "z")]


def test_stream_restart_adds_only_what_is_new(spark, tmp_path):
    source, target, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    rows = lambda ids: spark.createDataFrame([(i, 1) for i in ids], "id long, t int").write.mode("append").json(source)
    rows([1, 2])
    for more in ([], [2, 3], []):
        if more:
            rows(more)
        ingest.run_insert_only(ingest.file_stream(spark, source, "id long, t int"), target, state, "id", ["t"])
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_imputation_levels(spark):
    rows = [("a", "x", 1.0), ("a", "x", 3.0), ("a", "x", None), ("a", "y", None), ("b", None, None), (None, None, 10.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, g string, h string, v double")
    got = {r.id: (r.v, r.v_imputed) for r in impute.median_hierarchical(df, ["v"], [("g", "h"), ("g",)]).collect()}
    assert got == {0: (1.0, "Original"), 1: (3.0, "Original"), 2: (2.0, "g & h"), 3: (2.0, "g"), 4: (2.0, "Overall"), 5: (10.0, "Original")}
    texts = df.select("id", "g", F.when(F.col("v") == 1, "p").when(F.col("v") == 3, "o").alias("t"))
    got = {r.id: (r.t, r.t_imputed) for r in impute.mode_hierarchical(texts, ["t"], [("g",)]).collect()}
    assert got[2] == ("o", "g") and got[4] == ("o", "Overall") and got[0] == ("p", "Original")
    assert impute.mode_hierarchical(texts.where("t is null"), ["t"], [("g",)]).where("t <> 'Unknown'").count() == 0


def test_association_closed_forms(spark):
    df = spark.createDataFrame([(i % 3, i % 3, (i // 3) % 4, 7) for i in range(120)], "a int, b int, c int, d int")
    v = {(r.x, r.y): r.v for r in association.cramers_v(df, [("a", "b"), ("a", "c"), ("a", "d")]).collect()}
    assert v[("a", "b")] == pytest.approx(1, abs=1e-6) and v[("a", "c")] == 0 and v[("a", "d")] == 0
    u = {(r.x, r.y): r.u for r in association.theils_u(df, [("a", "b"), ("a", "c"), ("d", "a")]).collect()}
    assert u == {("a", "b"): 1.0, ("a", "c"): 0.0, ("d", "a"): 1.0}
    r = {(x.a, x.b): x.r for x in association.pearson(df, ["a", "b", "d"]).collect()}
    assert r[("a", "b")] == 1.0 and r[("a", "d")] == 0.0


def test_drift_of_shifted_uniforms(spark):
    rows = [(0, float(i), 1.0) for i in range(1000)] + [(1, float(i + 250), 1.0) for i in range(1000)]
    out = {r.feature: r for r in association.drift(spark.createDataFrame(rows, "side int, v double, w double"), ["v", "w"], "side").collect()}
    assert out["v"].ks_statistic == 0.25 and out["v"].emd_score == 250.0 and out["v"].drift_detected and out["v"].p_value < 1e-5
    assert out["w"].ks_statistic == 0 and out["w"].normalized_emd == 0 and not out["w"].drift_detected


def test_running_totals_cross_ranges(spark):
    df = spark.range(1, 2001).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"), F.lit(1).alias("n"))
    got = agg.running_totals(df.repartition(7), ["g"], "v", ["n"]).collect()
    assert all(r.n_upto == (r.v + 1) // 2 and r.n_all == 1000 and r.next_value == (r.v + 2 if r.v + 2 <= 2000 else None) for r in got)


def test_profiles(spark):
    df = spark.createDataFrame([(1, 1, None, "a"), (2, 2, None, "a"), (None, None, 5, "a")], "a int, b int, c int, d string")
    assert {(r.a, r.b) for r in profile.identical_columns(df, ["a", "b", "c"]).collect()} == {("a", "b")}
    assert {r["column"]: r.n_missing for r in profile.missing_profile(df).collect()} == {"a": 1, "b": 1, "c": 2}
    assert [r["column"] for r in profile.quasi_constant(df, ["a", "d"]).collect()] == ["d"]
    h = {r.bin: r.n for r in profile.histogram(spark.range(101), "id", 10).collect()}
    assert sum(h.values()) == 101 and h[10] == 11 and h[1] == 10


def test_folds_are_stable_under_repartition(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    f = lambda d: {r.k: (r.fold, r.is_train) for r in encode.holdout(encode.folds(d, "k"), "k").collect()}
    assert f(df) == f(df.repartition(13)) and {v[0] for v in f(df).values()} == set(range(5))


def test_vif_and_pls(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.5]
    df = spark.createDataFrame([(*map(float, a), float(b), i % 5) for i, (a, b) in enumerate(zip(x, y))], "a double, b double, c double, y double, fold int")
    assert all(r.vif < 1.3 for r in models.vif(df, ["a", "b", "c"]).collect())
    errors = {r.parameters: r.mse for r in models.solved_grid(df, ["a", "b", "c"], {str(k): models.pls_solution(k) for k in (1, 2, 3)}).withColumn("parameters", F.col("parameters").cast("int")).collect()}
    assert errors[3] < 1e-12 < errors[1]


def test_intervals_are_ordered_and_cover(spark):
    rng = random.Random(1)
    rows = [(i, "ab"[i % 2], 10.0, 10.0 + rng.gauss(0, 1 + i % 2)) for i in range(2000)]
    out = models.conformal_interval(spark.createDataFrame(rows, "id int, g string, prediction double, y double"), "y", (("g",), ()))
    assert out.where("q05 > q50 or q50 > q95").count() == 0
    assert evaluate.coverage(out, "y", "q05", "q95").first()[0] == pytest.approx(90, abs=1)


def test_isolation_forest_finds_the_far_point(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(500)] + [(999, 30.0, 30.0)], "id int, a double, b double")
    top = outliers.isolation_scores(df, "id", ["a", "b"], trees=30).orderBy(F.desc("score")).first()
    assert top.id == 999


def test_page_records():
    page = "<div class='product-location'><span>x</span><span> Ankara </span></div><div class='car-damage-info'><div class='car-damage-info-item'><p>Lokal Boyalı</p><ul><li>Kaput</li><li>-</li></ul></div></div><div class='tramer-info'><p>AGIR HASAR</p><span class='property-value'>1.200 TL</span></div>"
    r = pages.record(page)
    assert r["location"] == "Ankara" and r["damage"] == ["Kaput: Lokal Boyalı"] and r["fee_text"] == "1.200 TL" and r["price"] is None
    assert pages.record("")["attributes"] == []


def test_outlier_flags_are_those_of_the_row(spark):
    """Rows that share a key don't share flags."""
    from plinth.operators import outliers

    rows = [(k % 7, float(k % 11), float(k % 5), 0.01 * (k % 13)) for k in range(400)] + [(3, 900.0, -700.0, 0.0), (3, 5.0, 2.0, 50.0)]
    both = outliers.consolidated(spark.createDataFrame(rows, "k long, a double, b double, r double"), "r", ("a", "b"), contamination=0.004, trees=30)
    got = sorted((r.a, r.b, r.is_z, r.is_iso) for r in both.where("is_z or is_iso").collect())
    assert both.count() == 402 and (900.0, -700.0, False, True) in got and (5.0, 2.0, True, False) in got and len(got) <= 4
    flags = spark.createDataFrame([(True, False), (False, True), (True, True), (False, False)], "is_z boolean, is_iso boolean")
    assert tuple(outliers.flag_totals(flags).first()) == (2, 2, 3)


def test_tails_against_closed_forms(spark):
    import math

    from plinth.functions import tails

    z = [x / 7 for x in range(-80, 81)]
    df = spark.createDataFrame([(x,) for x in z], "z double").select("z", F.expr(tails.normal_cdf_sql("z")).alias("p"))
    assert all(abs(r.p - 0.5 * math.erfc(-r.z / math.sqrt(2))) < 1e-13 for r in df.collect())
    # two-sided tails of Student's distribution with 20 and 50 degrees of freedom, by integration
    for freedom in (20, 50, 3000):
        c = math.exp(math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2)) / math.sqrt(freedom * math.pi)
        for t in (0.1, 1.0, 2.5, 5.0):
            h = t / 2000
            inside = 2 * sum((1 if k in (0, 2000) else 4 if k % 2 else 2) * c * (1 + (k * h) ** 2 / freedom) ** (-(freedom + 1) / 2) for k in range(2001)) * h / 3
            got = spark.sql(f"SELECT {tails.student_two_sided_sql(f'CAST({t} AS DOUBLE)', f'CAST({freedom} AS DOUBLE)')} AS p").first().p
            assert abs(got - (1 - inside)) < 1e-7, (freedom, t, got, 1 - inside)
    assert abs(spark.sql(f"SELECT {tails.kolmogorov_sql('CAST(1.3581 AS DOUBLE)')} AS p").first().p - 0.05) < 1e-5


def test_ks_of_normal_and_other_values(spark):
    import numpy as np

    from plinth.operators import outliers

    rng = np.random.default_rng(1)
    for x, normal in ((rng.normal(5, 3, 900), True), (rng.uniform(size=900), False), (rng.integers(0, 3, 900).astype(float), False)):
        r = outliers.ks_normal(spark.createDataFrame([(float(v),) for v in x], "v double"), "v").first()
        v = np.sort(x)
        from math import erfc

        p = np.array([0.5 * erfc(-(a - x.mean()) / x.std() / 2**0.5) for a in v])
        upto, before = np.searchsorted(v, v, side="right") / 900, np.searchsorted(v, v) / 900
        assert abs(r.statistic - max((upto - p).max(), (p - before).max())) < 1e-6 and r.normal == normal


def test_gram_solutions(spark):
    """Ridge and lasso by their conditions of optimality, components up to all columns by least squares."""
    import numpy as np

    from plinth.operators import models

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) * [1, 10, 0.1] + [0, 100, 5]
    y = x @ [1.0, -0.2, 3.0] + rng.normal(size=300)
    df = spark.createDataFrame([(*map(float, r), float(t), i % 5) for i, (r, t) in enumerate(zip(x, y))], "a double, b double, c double, y double, fold int")
    grams = models.fold_grams(df, ["a", "b", "c"])

    def plain(fit):
        errors = []
        for k in range(5):
            out = np.arange(300) % 5 == k
            m, s, t = x[~out].mean(0), x[~out].std(0), y[~out].mean()
            b = fit((x[~out] - m) / s, y[~out] - t)
            errors.append(((y[out] - t - (x[out] - m) / s @ b) ** 2).mean())
        return errors

    for alpha in (0.01, 10.0, 500.0):
        assert np.allclose(models.gram_errors(grams, models.ridge_solution(alpha)), plain(lambda z, t: np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ t)), rtol=1e-8)  # noqa: B023
    full = plain(lambda z, t: np.linalg.lstsq(z, t, rcond=None)[0])
    for solution in (models.pcr_solution(3), models.pls_solution(3), models.lasso_solution(0.0)):
        assert np.allclose(models.gram_errors(grams, solution), full, rtol=1e-6)
    xx, xy = np.array([[1, 0.5, 0.1], [0.5, 1, 0.3], [0.1, 0.3, 1]]), np.array([0.9, -0.2, 0.05])
    for alpha in (0.01, 0.2, 2.0):
        b = models.lasso_solution(alpha)(xx, xy, 10)
        slope = xy - xx @ b
        assert np.all(np.abs(slope) <= alpha + 1e-8) and np.allclose(slope[b != 0], alpha * np.sign(b[b != 0]), atol=1e-8)
    one = models.pcr_solution(1)(xx, xy, 10)
    v = np.linalg.eigh(xx)[1][:, -1]
    assert np.allclose(one, v * (v @ xy) / (v @ xx @ v))


def test_medians_fill_level_by_level_like_a_plain_version(spark):
    import random
    from statistics import median

    from plinth.operators import impute

    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1, 2, 3, None]), rng.choice([None, None, 1.0, 2.0, 7.5, 9.0]), rng.choice([None, 3.0, 4.0])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, h int, v double, w double")
    levels = (("g", "h"), ("g",), ("h",))
    got = {r.id: (r.v, r.v_imputed, r.w, r.w_imputed) for r in impute.median_hierarchical(df, ["v", "w"], levels).collect()}
    want = {}
    for c in (3, 4):
        value, source = {r[0]: r[c] for r in rows}, {r[0]: "Original" if r[c] is not None else None for r in rows}
        for level in [*levels, ()]:
            at = ["_ g h".split().index(k) for k in level]
            groups = {}
            for r in rows:
                if value[r[0]] is not None and all(r[k] is not None for k in at):
                    groups.setdefault(tuple(r[k] for k in at), []).append(value[r[0]])
            for r in rows:
                key = tuple(r[k] for k in at)
                if value[r[0]] is None and key in groups and None not in key:
                    want[r[0], c] = (median(groups[key]), " & ".join(level) or "Overall")
            for (i, k), (v, s) in want.items():
                if k == c and value[i] is None:
                    value[i], source[i] = v, s
        for i in value:
            want[i, c] = (value[i], source[i])
    assert got == {i: (*want[i, 3], *want[i, 4]) for i in got} and len(got) == 300


def test_isolation_forest_on_few_rows_and_any_partitioning(spark):
    from plinth.operators import outliers

    rows = [(i, float(i % 17), float(i % 5)) for i in range(400)] + [(1000, 900.0, -700.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    got = [{r.k: r.score for r in outliers.isolation_scores(d, "k", ("a", "b"), trees=20).collect()} for d in (df.repartition(1), df.repartition(7))]
    assert got[0] == got[1] and max(got[0], key=got[0].get) == 1000
    flags = outliers.isolation_flags(df, "k", ("a", "b"), contamination=0.01, trees=20).where("is_iso").collect()
    assert 1000 in {r.k for r in flags} and len(flags) <= 8
    few = outliers.isolation_scores(df.limit(3), "k", ("a", "b"), trees=5)
    assert few.count() == 3 and outliers.isolation_scores(df.limit(0), "k", ("a", "b"), trees=5).count() == 0


def test_pearson_with_nulls_and_constants(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1, 1e4, 1] + [0, 5e6, 7]
    rows = [tuple(None if rng.random() < 0.2 else float(v) for v in r) + (2.5,) for r in x]
    got = {(r.a, r.b): r.r for r in association.pearson(spark.createDataFrame(rows, "p double, q double, r double, c double"), ["p", "q", "r", "c"]).collect()}
    a = np.array(rows, float)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        ok = ~np.isnan(a[:, i]) & ~np.isnan(a[:, j])
        assert abs(got["pqr"[i], "pqr"[j]] - np.corrcoef(a[ok, i], a[ok, j])[0, 1]) < 2e-6
    assert got["p", "c"] == 0


def test_exact_quantiles_and_arrays(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(None if i % 11 == 0 else f"g{i % 3}", None if i % 7 == 0 else float(rng.integers(0, 40))) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = (0.0, 0.05, 0.5, 0.9, 1.0)
    got = {r.g: r.q for r in aggregates.exact_quantiles(df, ["g"], "v", shares).collect()}
    for g in {g for g, _ in rows}:
        assert np.allclose(got[g], np.quantile([v for h, v in rows if h == g and v is not None], shares))
    chunks = aggregates.arrays_by_group(df, "g", "v", size=16).collect()
    for g in ("g0", "g1", "g2"):
        mine = sorted((r.chunk, r.points) for r in chunks if r.g == g)
        assert all(len(p) == 16 for _, p in mine[:-1]) and [v for _, p in mine for v in p] == sorted(v for h, v in rows if h == g and v is not None)


def test_linear_inference_and_fold_errors_in_closed_form(spark):
    import numpy as np

    from plinth.operators import models

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = 2 + x @ [1.5, -0.5] + 0.3 * rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b), float(2 * a + 1), float(t), i % 5) for i, ((a, b), t) in enumerate(zip(x, y))], "a double, b double, a2 double, y double, fold int")
    got = {r.feature: r for r in models.inference(df, ["a", "b"]).collect()}
    d = np.column_stack([x, np.ones(400)])
    beta = np.linalg.solve(d.T @ d, d.T @ y)
    s2 = ((y - d @ beta) ** 2).sum() / 397
    for k, c in enumerate(("a", "b", "intercept")):
        assert abs(got[c].coefficient - beta[k]) < 1e-8 and abs(got[c].std_error - np.sqrt(s2 * np.linalg.inv(d.T @ d)[k, k])) < 1e-8
    wanted = []
    for i in range(5):
        out = np.arange(400) % 5 == i
        b = np.linalg.lstsq(d[~out], y[~out], rcond=None)[0]
        wanted.append(np.sqrt(((y[out] - d[out] @ b) ** 2).mean()))
    grams = models.fold_grams(df, ["a", "b", "a2"])
    assert np.allclose(models.linear_errors(grams, [0, 1]), wanted) and np.allclose(models.linear_errors(grams, [0, 1, 2]), wanted)


def test_token_table_of_any_number_of_words(spark):
    from plinth.operators import models

    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "C-d"), (4, "a b a"), (5, " !"), (6, "D")], "id int, t string")
    table = {(r.text, r.word): (r.n, r.in_rows) for r in models.token_table(df, "t").collect()}
    assert table == {("a b a", "a"): (2, 2), ("a b a", "b"): (1, 2), ("C-d", "c"): (1, 1), ("C-d", "d"): (1, 2), ("D", "d"): (1, 2)}
    got = {r.id: (r.n_tokens, r.n_distinct, round(r.l2, 6), r.rarest) for r in models.with_token_statistics(df, "t").collect()}
    none = (0.0, 0, 0.0, "")
    assert got == {1: (3.0, 2, 2.236068, "a"), 2: none, 3: (2.0, 2, 1.414214, "c"), 4: (3.0, 2, 2.236068, "a"), 5: none, 6: (1.0, 1, 1.0, "d")}
    many = spark.range(0, 1_000_000, 1, 8).select((F.col("id") % 1000).alias("id"), F.concat(F.lit("w"), "id", F.lit(" all")).alias("t"))
    r = models.token_table(many, "t").agg(F.count(F.lit(1)).alias("n"), F.max("in_rows").alias("most")).first()
    assert tuple(r) == (2_000_000, 1_000_000)


def _psi(x):
    out = 0.0
    while x < 12:
        out, x = out - 1 / x, x + 1
    return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def _plain_information(rows, k):
    """Every distance of every row."""
    sizes = {c: sum(d == c for d, _ in rows) for c, _ in rows}
    rows = [(c, v) for c, v in rows if sizes[c] > 1]
    s = 0.0
    for i, (c, v) in enumerate(rows):
        r = sorted(abs(u - v) for j, (d, u) in enumerate(rows) if d == c and j != i)[min(k, sizes[c] - 1) - 1]
        within = [d == c for j, (d, u) in enumerate(rows) if j != i and abs(u - v) <= r]
        s += _psi(sum(within)) - _psi(len(within)) - _psi(sizes[c])
    return max(0.0, _psi(len(rows)) + s / len(rows))


@pytest.mark.parametrize("k", [1, 3, 7])
def test_neighbour_information_equals_all_distances(spark, k):
    rng = random.Random(k)
    rows = [("a" if i % 3 else rng.choice("bcdefg"), float(rng.choice([5, 5, 5, rng.randrange(4000), rng.randrange(40)]))) for i in range(500)]
    rows = [(c, v + (40 if c in "bc" else 0)) for c, v in rows] + [("alone", 7.0), ("two", 9.0), ("two", 9.0), ("pair", 1.0), ("pair", 3000.0)]
    extra = [(None, 4.0), ("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows + extra, "label string, x double")
    got = association.neighbour_information(df, "x", "label", k).first().mi
    assert got == pytest.approx(_plain_information(rows, k), abs=1e-9)
    assert association.neighbour_information(df.limit(0), "x", "label", k).first().mi is None


def test_neighbour_information_of_known_cases(spark):
    rng = random.Random(1)
    free = [(rng.choice("ab"), rng.gauss(0, 1)) for _ in range(3000)]
    apart = [(c, rng.gauss(100 if c == "a" else 0, 1)) for c, _ in free]
    for rows, wanted in ((free, 0.0), (apart, math.log(2))):
        assert association.neighbour_information(spark.createDataFrame(rows, "label string, x double"), "x", "label").first().mi == pytest.approx(wanted, abs=0.03)
    # equal values only: the plain information of counts, but for psi in place of ln
    rows = [("a", 1.0)] * 400 + [("b", 2.0)] * 400 + [("b", 1.0)] * 200
    plain = 0.4 * math.log(0.4 / (0.6 * 0.4)) + 0.4 * math.log(0.4 / (0.4 * 0.6)) + 0.2 * math.log(0.2 / (0.6 * 0.6))
    assert association.neighbour_information(spark.createDataFrame(rows, "label string, x double"), "x", "label").first().mi == pytest.approx(plain, abs=0.01)


def test_with_neighbours_over_many_ranges(spark):
    rng = random.Random(2)
    rows = sorted({(c, rng.randrange(10_000)) for c in "aaaaaab" for _ in range(60)} | {("c", 1)})
    df = spark.createDataFrame(rows, "g string, v long")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "150")  # most ranges have a row or two, fewer than k
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = agg.with_neighbours(df, ["g"], "v", ("v",), 4).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert len(got) == len(rows)
    for r in got:
        mine = [v for g, v in rows if g == r.g]
        i = mine.index(r.v)
        assert sorted(s.v for s in r.near) == mine[max(0, i - 4) : i + 5]


def test_outliers_by_model_count_either_flag(spark, tmp_path):
    """Planted prices beyond three deviations, and rows that only the forest flags; z flags by SQL, counts from the flags as a given table."""
    import duckdb

    import __spark_entry__ as entry
    from plinth.plans import statistics

    con = duckdb.connect()
    for t, columns in (("lineitem", "* REPLACE (CASE WHEN l_orderkey % 400 = 7 THEN 40 * l_extendedprice ELSE l_extendedprice END AS l_extendedprice)"), ("part", "*")):
        con.execute(f"COPY (SELECT {columns} FROM '/root/testdata/sf0.001/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    flags = statistics.flagged(spark, str(tmp_path), "model").select("ad_id", "residual", "model", "is_z", "is_iso").toPandas()  # noqa: F841 - read by the SQL below
    con.execute("CREATE TABLE flags AS SELECT * FROM flags")
    one = "SELECT ad_id, residual, is_z FROM flags ORDER BY ALL"
    assert con.execute(one).fetchall() == con.execute(f"SELECT * FROM ({entry.oracle_sql()['stat_zscore_outlier']}) ORDER BY ALL").fetchall()
    assert all(con.execute("SELECT count_if(is_z), count_if(is_iso AND NOT is_z), count_if(model IS NULL AND (is_z OR is_iso)) FROM flags").fetchone())
    wanted = con.execute("SELECT coalesce(model, 'missing') AS model, count(*) AS n FROM flags WHERE is_z OR is_iso GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20").fetchall()
    df = entry.queries()["outlier_by_model"](spark, str(tmp_path))
    assert df.columns == ["model", "n"] and [tuple(r) for r in df.collect()] == wanted and len(wanted) == 20
    # on the tables as they are no residual is that far away, but the forest has flags
    assert sum(r.n for r in entry.queries()["outlier_by_model"](spark, "/root/testdata/sf0.001").collect()) > 0


def test_outlier_flags_on_any_partitioning(spark):
    """Flags of rows are those of any other order and dealing of the rows, copies among them."""
    rng = random.Random(5)
    rows = [(k % 50, rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(3000)]
    df = spark.createDataFrame(rows + rows[:200] + [rows[7]] * 300, "k long, a double, b double")
    first, *others = (sorted(map(tuple, outliers.consolidated(d, "a", ("a", "b"), trees=20).collect())) for d in (df.repartition(1), df.repartition(7, "b"), df.orderBy("a")))
    assert len(first) == 3500 and sum(r[-1] for r in first) == pytest.approx(175, abs=5) and all(o == first for o in others)
