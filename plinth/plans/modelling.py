"""Queries of encoders, models, validation and intervals, on the listings' price."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.functions import scores, tails
from plinth.operators import encode, evaluate, models, neighbours, trees
from plinth.operators.aggregates import exact_quantiles
from plinth.plans import least_squares as ls
from plinth.plans.least_squares import REGULAR
from plinth.plans.registry import query
from plinth.session import checkpointed, shared_path
from plinth.sources import io
from plinth.sources.listings import listings, table

FEATURES = ["power_hp_val", "torque_nm", "engine_cc_val", "mileage", "year", "risk"]


def frame(spark, sf):
    """Complete rows of the features, the log price as ``y``, a fold and a training flag by hash."""
    df = listings(spark, sf).where("price > 0").select("ad_id", "part_id", "brand", "series", "model", "price", F.log1p("price").alias("y"), "power_hp_val", "torque_nm", "engine_cc_val", F.coalesce("kb_mileage", "gb_mileage").cast("double").alias("mileage"), F.coalesce("kb_year", "gb_year").cast("double").alias("year"), scores.risk_ladder().cast("double").alias("risk"))
    # the score is never null, and a test of it would have the engine compute it again, in code too long to be compiled
    return encode.holdout(encode.folds(df.dropna(subset=[c for c in FEATURES if c != "risk"]), "ad_id"), "ad_id")


def ready(spark, sf, columns=tuple(FEATURES)):
    return models.assembled(frame(spark, sf), columns).select("ad_id", "brand", "series", "price", "y", "fold", "is_train", "features").cache()


def fitted(spark, sf, name, estimator):
    df = ready(spark, sf)
    model = (estimator(df) if not hasattr(estimator, "fit") else estimator).fit(df.where("is_train"))
    return models.as_row(spark, name, models.metrics(model.transform(df.where("not is_train"))))


@query("split_holdout", f"SELECT ad_id, {encode.hashed_sql('ad_id', 42, 100)} < 80 AS is_train FROM listings")
def split_holdout(spark, sf):
    return encode.holdout(listings(spark, sf).select("ad_id"), "ad_id")


@query("kfold_assign", f"SELECT ad_id, {encode.hashed_sql('ad_id', 42, 5)} AS fold FROM listings")
def kfold_assign(spark, sf):
    return encode.folds(listings(spark, sf).select("ad_id"), "ad_id")


_EB = """WITH l AS (SELECT ad_id, model, price, ad_id % 5 AS fold, ln(1 + price) AS y FROM listings WHERE price > 0),
    p AS (SELECT model, fold, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM l GROUP BY ALL), w AS (SELECT model, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM p GROUP BY ALL), f AS (SELECT fold, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM p GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q FROM p),
    x AS (SELECT l.ad_id, l.y, w.n - p.n AS n, w.s - p.s AS s, w.q - p.q AS q, (t.s - f.s) / (t.n - f.n) AS g, (t.q - f.q) / (t.n - f.n) AS g2 FROM l JOIN p ON l.model IS NOT DISTINCT FROM p.model AND l.fold = p.fold JOIN w ON l.model IS NOT DISTINCT FROM w.model JOIN f ON l.fold = f.fold, t),
    z AS (SELECT *, s / nullif(n, 0) AS m, greatest(0, q / nullif(n, 0) - pow(s / nullif(n, 0), 2)) AS v, g2 - g * g AS tau FROM x)
    SELECT ad_id, round(y, 6) AS y, round(CASE WHEN n > 0 THEN n * tau / (v + n * tau) * m + (1 - n * tau / (v + n * tau)) * g ELSE g END, 6) AS model_te FROM z"""


@query("encode_target_eb", _EB)
def encode_target_eb(spark, sf):
    df = listings(spark, sf).where("price > 0").select("ad_id", "model", F.log1p("price").alias("y"), (F.col("ad_id") % 5).alias("fold"))
    return encode.target_encoded(df, "model", "y", "fold", "model_te").select("ad_id", F.round("y", 6).alias("y"), F.round("model_te", 6).alias("model_te"))


@query("encode_onehot_drop_first", "SELECT ad_id, CAST(coalesce(kb_fuel = 'Dizel', false) AS INT) AS kb_fuel_Dizel, CAST(coalesce(kb_fuel = 'Elektrik', false) AS INT) AS kb_fuel_Elektrik FROM listings")
def encode_onehot_drop_first(spark, sf):
    df = listings(spark, sf).select("ad_id", "kb_fuel")
    return encode.one_hot(df, "kb_fuel", encode.levels_of(df, "kb_fuel")).drop("kb_fuel")


@query("scale_standard", "WITH s AS (SELECT avg(engine_cc_val) AS m1, stddev_pop(engine_cc_val) AS s1, avg(gb_mileage) AS m2, stddev_pop(gb_mileage) AS s2 FROM listings WHERE ad_id % 5 <> 0) SELECT ad_id, round((engine_cc_val - m1) / s1, 6) AS engine_cc_val, round((gb_mileage - m2) / s2, 6) AS gb_mileage FROM listings, s")
def scale_standard(spark, sf):
    df = listings(spark, sf).select("ad_id", "engine_cc_val", F.col("gb_mileage").cast("double").alias("gb_mileage"))
    z = encode.standardized(df, ["engine_cc_val", "gb_mileage"], df.where("ad_id % 5 <> 0"))
    return z.select("ad_id", F.round("engine_cc_val", 6).alias("engine_cc_val"), F.round("gb_mileage", 6).alias("gb_mileage"))


@query("fill_category_literal", "SELECT ad_id, coalesce(model, 'Bilinmiyor') AS model, coalesce(kb_fuel, 'Bilinmiyor') AS kb_fuel FROM listings")
def fill_category_literal(spark, sf):
    return listings(spark, sf).select("ad_id", "model", "kb_fuel").fillna("Bilinmiyor")


@query("encode_text_tokens", r"""
    WITH t AS (SELECT coalesce(model, '') AS m, count(*) AS times, list_filter(regexp_split_to_array(lower(coalesce(any_value(model), '')), '\W+'), lambda w: w <> '') AS words FROM listings GROUP BY 1),
    w AS (SELECT m, times, unnest(words) AS word FROM t), c AS (SELECT m, times, word, count(*) AS n FROM w GROUP BY ALL), d AS (SELECT word, sum(times) AS df FROM c GROUP BY word),
    s AS (SELECT m, count(*) AS k, sqrt(sum(n * n)) AS l2, arg_min(word, (df, word)) AS rarest FROM c JOIN d USING (word) GROUP BY m)
    SELECT ad_id, CAST(len(words) AS DOUBLE) AS n_tokens, CAST(coalesce(s.k, 0) AS BIGINT) AS n_distinct, round(coalesce(s.l2, 0), 6) AS l2, coalesce(s.rarest, '') AS rarest
    FROM listings JOIN t ON coalesce(model, '') = t.m LEFT JOIN s ON s.m = t.m""")
def encode_text_tokens(spark, sf):
    """Of each row's counts of words: tokens, distinct ones, length, and the word that fewest rows have."""
    out = models.with_token_statistics(listings(spark, sf).select("ad_id", "model"), "model")
    return out.select("ad_id", "n_tokens", "n_distinct", F.round("l2", 6).alias("l2"), "rarest")


@query("assemble_features", f"WITH {ls.FRAME} SELECT ad_id, [power_hp_val, torque_nm, engine_cc_val, mileage, year, risk] AS features FROM f")
def assemble_features(spark, sf):
    from pyspark.ml.functions import vector_to_array

    return models.assembled(frame(spark, sf), FEATURES).select("ad_id", vector_to_array("features").alias("features"))


@query("gram_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CAST(sum(CAST({a} AS DOUBLE) * {b}) AS DOUBLE) AS v FROM listings" for a, b in [*combinations(("engine_cc_val", "gb_year", "part_id"), 2), ("engine_cc_val", "engine_cc_val"), ("gb_year", "gb_year"), ("part_id", "part_id")]))
def gram_matrix(spark, sf):
    return encode.gram(listings(spark, sf), ["engine_cc_val", "gb_year", "part_id"])


def _vif_sql() -> str:
    n = len(REGULAR)
    raw = f"SELECT 0 AS k, {', '.join(f'sum({a} * {b}) AS g_{i}_{j}' for i, a in enumerate(REGULAR) for j, b in enumerate(REGULAR))} FROM f"
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, v_0.g_{i}_{i} * v_{n}.g_{i}_{i} AS vif FROM v_0, v_{n}" for i, c in enumerate(REGULAR))
    return f"WITH {ls.FRAME}, {ls.swept('v', raw, n, ())} SELECT feature, round(vif, 4) AS vif, CASE WHEN vif < 5 THEN 'low' WHEN vif < 10 THEN 'moderate' ELSE 'high' END AS verdict FROM ({rows})"


@query("stat_vif", _vif_sql())
def stat_vif(spark, sf):
    return models.vif(frame(spark, sf), REGULAR)  # the other features are linear in the first, so their inflation has no bound


@query("model_linear", f"WITH {ls.FRAME}, {ls.fitted('m', REGULAR, 'is_train')} SELECT 'linear' AS model, {ls.METRICS} FROM m_p WHERE NOT is_train")
def model_linear(spark, sf):
    return fitted(spark, sf, "linear", models.linear())


def _inference_sql() -> str:
    """Coefficients and errors of the scaled columns, in terms of the columns themselves."""
    n, at = len(REGULAR), {"engine_cc_val": (2250, 1000), "mileage": (25000, 10000), "year": (1995, 1), "risk": (0, 100)}  # what ``least_squares.SCALED`` takes off and divides by
    shift = [1.0, *(-at[c][0] / at[c][1] for c in REGULAR)]
    fit = ls.fitted("m", REGULAR)
    whole = " + ".join(f"{a!r} * {b!r} * g_{i}_{j}" for i, a in enumerate(shift) for j, b in enumerate(shift))
    rows = [f"SELECT '{c}' AS feature, g_{i}_y / {at[c][1]} AS b, sqrt(s2 * g_{i}_{i}) / {at[c][1]} AS e, nu, r2 FROM m_{n + 1}, s" for i, c in enumerate(REGULAR, 1)]
    rows.append(f"SELECT 'intercept', {' + '.join(f'{a!r} * g_{i}_y' for i, a in enumerate(shift))}, sqrt(s2 * ({whole})), nu, r2 FROM m_{n + 1}, s")
    return f"""WITH {ls.FRAME}, {fit}, s AS (SELECT sum(pow(y - prediction, 2)) / (count(*) - {n + 1}) AS s2, CAST(count(*) - {n + 1} AS DOUBLE) AS nu, 1 - sum(pow(y - prediction, 2)) / (count(*) * var_pop(y)) AS r2 FROM m_p),
        c AS ({' UNION ALL '.join(rows)}), t AS (SELECT *, b / e AS t FROM c)
        SELECT feature, round(b, 9) AS coefficient, round(e, 9) AS std_error, round(t, 5) AS t, round({tails.student_two_sided_sql('t', 'nu')}, 6) AS p, round(r2, 8) AS r2 FROM t"""


@query("ols_inference", _inference_sql())
def ols_inference(spark, sf):
    out = models.inference(frame(spark, sf), REGULAR)  # the other features are linear in the first, and errors need a regular design
    return out.select("feature", *(F.round(c, k).alias(c) for c, k in (("coefficient", 9), ("std_error", 9), ("t", 5), ("p", 6), ("r2", 8))))


_ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 500.0, 1000.0)


def _ridge_sql() -> str:
    """Standardised by the other folds, one sweep for each fold and penalty."""
    z = range(len(FEATURES))
    stats = ", ".join(f"avg({c}) AS m_{i}, stddev_pop({c}) AS s_{i}" for i, c in enumerate(FEATURES))
    sums = ", ".join([*(f"sum(z_{i} * z_{j}) AS g_{i}_{j}" for i in z for j in z), *(f"sum(z_{i} * y) AS g_{i}_y" for i in z)])
    cells = ", ".join([*(f"g_{i}_{j} + {'alpha' if i == j else '0'} AS g_{i}_{j}" for i in z for j in z), *(f"g_{i}_y" for i in z)])
    return f"""WITH {ls.FRAME}, a AS (SELECT * FROM (VALUES {', '.join(f"('alpha={x}', CAST({x} AS DOUBLE))" for x in _ALPHAS)}) v(parameters, alpha)),
        st AS (SELECT k.k, avg(y) AS m_y, {stats} FROM f JOIN (SELECT unnest(range(0, 5)) AS k) k ON f.fold <> k.k GROUP BY k.k),
        z AS (SELECT k, fold, y - m_y AS y, {', '.join(f'({c} - m_{i}) / s_{i} AS z_{i}' for i, c in enumerate(FEATURES))} FROM f, st),
        g AS (SELECT k, {sums} FROM z WHERE fold <> k GROUP BY k), {ls.swept('r', f'SELECT k, alpha, {cells} FROM g, a', len(FEATURES), key='k, alpha')},
        e AS (SELECT z.k, alpha, avg(pow(y - ({' + '.join(f'z_{i} * g_{i}_y' for i in z)}), 2)) AS mse FROM z JOIN r_{len(FEATURES)} r ON z.k = r.k WHERE z.fold = z.k GROUP BY z.k, alpha)
        SELECT parameters, round(avg(mse), 6) AS mse FROM e JOIN a USING (alpha) GROUP BY parameters"""


def _linear_points() -> dict:
    n = range(1, len(FEATURES) + 1)
    return {
        "ridge": {f"alpha={a}": models.ridge_solution(a) for a in _ALPHAS},
        "lasso": {f"alpha={a}": models.lasso_solution(a) for a in (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0)},
        "pcr": {f"components={k}": models.pcr_solution(k) for k in n},
        "pls": {f"components={k}": models.pls_solution(k) for k in n},
    }


@query("model_ridge", _ridge_sql())
def model_ridge(spark, sf):
    return models.solved_grid(frame(spark, sf), FEATURES, _linear_points()["ridge"])


@query("model_lasso")
def model_lasso(spark, sf):
    return models.solved_grid(frame(spark, sf), FEATURES, _linear_points()["lasso"])


@query("model_pcr")
def model_pcr(spark, sf):
    return models.solved_grid(frame(spark, sf), FEATURES, _linear_points()["pcr"])


@query("win_cumulative_variance")
def win_cumulative_variance(spark, sf):
    df = encode.standardized(frame(spark, sf), FEATURES)
    return models.cumulative_variance(models.assembled(df, FEATURES), len(FEATURES))


@query("model_pls")
def model_pls(spark, sf):
    return models.solved_grid(frame(spark, sf), FEATURES, _linear_points()["pls"])


_KNN = range(3, 21)


@query("model_knn", f"""
    WITH e AS (SELECT vec_id, embedding, CAST(label AS DOUBLE) AS y FROM embeddings), b AS (SELECT a.vec_id, a.y AS y, b.y AS yb, b.vec_id AS other, list_transform(range(1, len(a.embedding) + 1), lambda i: abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE))) AS g FROM e a JOIN e b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
    p AS (SELECT vec_id, y, yb, other, 1 AS p, round(list_sum(g), 9) AS d FROM b UNION ALL SELECT vec_id, y, yb, other, 2, round(sqrt(list_sum(list_transform(g, lambda x: x * x))), 9) FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, other) AS r FROM p), t AS (SELECT * FROM r WHERE r <= {max(_KNN)}), k AS (SELECT unnest({list(_KNN)}) AS k),
    g AS (SELECT k, p, vec_id, any_value(y) AS y, avg(yb) AS plain, CASE WHEN min(d) = 0 THEN sum(CASE WHEN d = 0 THEN yb ELSE 0 END) / sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) ELSE sum(yb / d) / sum(1 / d) END AS near FROM t JOIN k ON r <= k GROUP BY k, p, vec_id)
    SELECT CAST(k AS INT) AS k, CAST(p AS INT) AS p, weights, round(avg(pow(y - prediction, 2)), 6) AS mse FROM (SELECT k, p, 'uniform' AS weights, y, plain AS prediction FROM g UNION ALL SELECT k, p, 'distance', y, near FROM g) GROUP BY ALL""")
def model_knn(spark, sf):
    """A stated query set (ids divisible by 100) against all other rows; one ranked table of neighbours for each metric serves every k and weighting."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.col("label").cast("double").alias("y"))
    return models.knn_grid(e, "vec_id", "v", "y", F.col("vec_id") % 100 == 0, _KNN)


@query("model_knn_all", f"""
    WITH e AS (SELECT vec_id, embedding, CAST(label AS DOUBLE) AS y FROM embeddings),
    b AS (SELECT a.vec_id, a.y AS y, b.y AS yb, b.vec_id AS other, round(sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: pow(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2)))), 9) AS d FROM e a JOIN e b ON b.vec_id <> a.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS r FROM b), k AS (SELECT unnest({list(_KNN)}) AS k),
    g AS (SELECT k, vec_id, any_value(y) AS y, avg(yb) AS plain, CASE WHEN min(d) = 0 THEN sum(CASE WHEN d = 0 THEN yb ELSE 0 END) / sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) ELSE sum(yb / d) / sum(1 / d) END AS near FROM r JOIN k ON r <= k GROUP BY k, vec_id)
    SELECT CAST(k AS INT) AS k, CAST(2 AS INT) AS p, weights, round(avg(pow(y - prediction, 2)), 6) AS mse FROM (SELECT k, 'uniform' AS weights, y, plain AS prediction FROM g UNION ALL SELECT k, 'distance', y, near FROM g) GROUP BY ALL""")
def model_knn_all(spark, sf):
    """Every row against all other rows, by the exact neighbour join."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("y"))
    near, _ = neighbours.neighbour_join(e, "vec_id", "embedding", max(_KNN))
    values = e.select(F.col("vec_id").alias("other"), "y")
    near = near.join(values, "other").join(values.select(F.col("other").alias("key"), F.col("y").alias("qy")), "key")
    near = near.select(F.lit(2).alias("p"), F.col("key").alias("q"), "qy", F.col("rank").alias("r"), F.round("d", 9).alias("d"), "y")
    return models.neighbour_errors(near, "y", _KNN)


def _grid_rows(spark, points, errors):
    rows = [(", ".join(f"{k}={v}" for k, v in sorted(p.items())), round(float(e), 6)) for p, e in zip(points, errors)]
    return spark.createDataFrame(rows, "parameters string, mse double").orderBy("mse", "parameters")


def _binned(spark, sf, bins=32):
    return trees.Binned.of(frame(spark, sf), FEATURES, bins=bins)


_DEPTHS, _FOLDS = (3, 5, 7, 10), range(5)


@query("model_tree")
def model_tree(spark, sf):
    """Depth, least rows to split and least rows of a leaf, over five folds.  A deep tree read to less depth is the shallower tree."""
    table, leafs = _binned(spark, sf), [(s, m) for s in (2, 5, 10) for m in (1, 2, 4)]
    specs = [trees.Spec(depth=max(_DEPTHS), min_split=s, min_leaf=m, fold=k) for s, m in leafs for k in _FOLDS]
    errors = trees.errors_by_depth(table, specs, [[t] for t in trees.grow(table, specs)], [1], list(_DEPTHS))[:, 0].reshape(len(leafs), 5, -1).mean(axis=1)
    points = [{"max_depth": d, "min_samples_split": s, "min_samples_leaf": m} for s, m in leafs for d in _DEPTHS]
    return _grid_rows(spark, points, errors.ravel())


def _bags(spark, sf, shares, numbers, depths):
    """Errors of bags of trees, by (rows, features) share, number of trees and depth, averaged over five folds."""
    table, most = _binned(spark, sf), max(numbers)
    owners = [(r, f, k) for r, f in shares for k in _FOLDS]
    specs = [trees.Spec(depth=max(depths), rows=r, repeats=True, features=f, fold=k, seed=1 + t) for r, f, k in owners for t in range(most)]
    grown = trees.grow(table, specs)
    groups = [grown[i * most : (i + 1) * most] for i in range(len(owners))]
    errors = trees.errors_by_depth(table, [specs[i * most] for i in range(len(owners))], groups, list(numbers), list(depths))
    return errors.reshape(len(shares), 5, len(numbers), len(depths)).mean(axis=1)


@query("model_bagging")
def model_bagging(spark, sf):
    """Number of trees, share of rows and share of features, each drawn for each tree, over five folds."""
    shares, numbers = [(r, f) for r in (0.6, 0.8, 1.0) for f in (0.6, 0.8, 1.0)], (10, 25, 50)
    errors = _bags(spark, sf, shares, numbers, (5,))
    return _grid_rows(spark, [{"n_estimators": n, "max_samples": r, "max_features": f} for r, f in shares for n in numbers], errors.ravel())


@query("model_forest")
def model_forest(spark, sf):
    numbers, depths = (50, 100), (5, 7)
    errors = _bags(spark, sf, [(1.0, 1.0)], numbers, depths)
    return _grid_rows(spark, [{"n_estimators": n, "max_depth": d} for n in numbers for d in depths], errors.ravel())


@query("model_gbt")
def model_gbt(spark, sf):
    """Number of rounds, rate, depth and share of rows, over five folds; all chains grow in the same jobs."""
    axes = [(r, d, s) for r in (0.05, 0.1, 0.2) for d in (3, 5) for s in (0.8, 1.0)]
    chains, numbers = [(*a, k) for a in axes for k in _FOLDS], (6, 12)
    specs = [trees.Spec(depth=d, rows=s, fold=k, seed=3) for _, d, s, k in chains]
    _, losses = trees.boost(_binned(spark, sf), specs, [r for r, *_ in chains], max(numbers))
    points = [{"learning_rate": r, "max_depth": d, "subsample": s, "n_estimators": n} for r, d, s in axes for n in numbers]
    errors = [sum(losses[i * 5 + k][n] for k in _FOLDS) / 5 for i in range(len(axes)) for n in numbers]
    return _grid_rows(spark, points, errors)


def held_out_frame(spark, sf):
    """``frame`` with the held-out rows as fold 0 and all others as fold 1."""
    return frame(spark, sf).withColumn("fold", F.col("is_train").cast("int"))


@query("model_early_stop")
def model_early_stop(spark, sf):
    """150 rounds at most, ended by 100 without gain on the held-out rows."""
    df = held_out_frame(spark, sf)
    table = trees.Binned.of(df, FEATURES, bins=32)
    [model], [losses] = trees.boost(table, [trees.Spec(depth=2)], [0.1], 150, patience=100, valid_fold=0)
    best = len(model.trees)
    return spark.createDataFrame([("early_stopped", best, len(losses) - 1, round(losses[0] ** 0.5, 4), round(losses[best] ** 0.5, 4))], "model string, best_round int, rounds int, rmse_start double, rmse_best double")


def quantile_model(spark, sf):
    """The multi-quantile booster on the training rows, ended by the held-out rows, and the frame."""
    df = held_out_frame(spark, sf)
    [model], _ = trees.boost(trees.Binned.of(df, FEATURES), [trees.Spec(depth=4, min_leaf=50)], [0.1], 30, trees.Loss((0.05, 0.5, 0.95)), patience=10, valid_fold=0)
    return model, df


def intervals(spark, sf):
    """Held-out rows with their three quantiles; a row's quantiles ascend."""
    model, df = quantile_model(spark, sf)
    # rows are scored in their own order, so the target comes along as a part of the key
    rows = df.where("not is_train").withColumn("k", F.struct("ad_id", "y"))
    return model.transform(rows, ["q05", "q50", "q95"], "k", ordered=True).select("k.*", "q05", "q50", "q95")


@query("model_quantile_interval")
def model_quantile_interval(spark, sf):
    return intervals(spark, sf).select("ad_id", *(F.expm1(c).alias(c) for c in ("y", "q05", "q50", "q95")))


@query("attrib_tree")
def attrib_tree(spark, sf):
    """Shapley values of the median booster's trees for each held-out row, in log price: with the base they add up to the prediction."""
    model, df = quantile_model(spark, sf)
    out = model.attributed(df.where("not is_train"), "ad_id", output=1)
    return out.select("ad_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query("quantile_by_group", "SELECT brand, round(quantile_cont(price, 0.05), 4) AS q05, round(quantile_cont(price, 0.5), 4) AS q50, round(quantile_cont(price, 0.95), 4) AS q95 FROM listings WHERE price IS NOT NULL GROUP BY brand")
def quantile_by_group(spark, sf):
    return exact_quantiles(listings(spark, sf), ["brand"], "price", (0.05, 0.5, 0.95)).select("brand", *(F.round(F.col("q")[k], 4).alias(n) for k, n in enumerate(("q05", "q50", "q95"))))


_Q = "q AS (SELECT brand, round(quantile_cont(price, 0.05), 4) AS q05, round(quantile_cont(price, 0.5), 4) AS q50, round(quantile_cont(price, 0.95), 4) AS q95 FROM listings WHERE price IS NOT NULL GROUP BY brand), j AS (SELECT * FROM listings JOIN q USING (brand) WHERE price IS NOT NULL)"


def banded(spark, sf):
    return listings(spark, sf).where("price is not null").select("ad_id", "brand", "price").join(quantile_by_group(spark, sf), "brand")


@query("loss_pinball", f"WITH {_Q} SELECT " + ", ".join(f"round(avg(greatest({a} * (price - {c}), ({a} - 1) * (price - {c}))), 4) AS {c}" for a, c in ((0.05, "q05"), (0.5, "q50"), (0.95, "q95"))) + " FROM j")
def loss_pinball(spark, sf):
    return banded(spark, sf).agg(*(F.round(F.avg(evaluate.pinball(F.col("price"), F.col(c), a)), 4).alias(c) for a, c in ((0.05, "q05"), (0.5, "q50"), (0.95, "q95"))))


@query("eval_regression", f"WITH {_Q}, e AS (SELECT price, price - q50 AS e FROM j) SELECT round(avg(e * e), 2) AS mse, round(sqrt(avg(e * e)), 2) AS rmse, round(avg(abs(e)), 2) AS mae, round(1 - avg(e * e) / var_pop(price), 4) AS r2 FROM e")
def eval_regression(spark, sf):
    return evaluate.regression(banded(spark, sf), "price", "q50")


@query("eval_mape", f"WITH {_Q} SELECT round(avg(abs((price - q50) / price)) * 100, 4) AS mape FROM j")
def eval_mape(spark, sf):
    return evaluate.mape(banded(spark, sf), "price", "q50").select(F.round("mape", 4).alias("mape"))


@query("eval_coverage", f"WITH {_Q} SELECT round(avg(CAST(price BETWEEN q05 AND q95 AS INT)) * 100, 4) AS coverage_percent FROM j")
def eval_coverage(spark, sf):
    return evaluate.coverage(banded(spark, sf), "price", "q05", "q95").select(F.round("coverage_percent", 4).alias("coverage_percent"))


def regular_pipeline() -> Pipeline:
    """Columns are centred before their products are summed: years near 2000 would cost the sums six digits, and cut-off prices their last unit."""
    return Pipeline(stages=[VectorAssembler(inputCols=REGULAR, outputCol="columns", handleInvalid="skip"), StandardScaler(inputCol="columns", outputCol="features", withMean=True), models.linear()])


def saved_model(spark, sf):
    """A stored version: the model and, beside it, the quantiles of its residuals, which make its interval."""
    df = checkpointed(frame(spark, sf).select("ad_id", *REGULAR, "y", "is_train"))
    model = regular_pipeline().fit(df.where("is_train"))
    path = models.save(model, shared_path(spark, "models"), "v1")
    residual = F.col("y") - F.col("prediction")
    exact_quantiles(model.transform(df.where("is_train")).select(residual.alias("r")), [], "r", (0.05, 0.95)).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("up")).write.parquet(f"{path}-interval")
    return path, df


@query("score_batch", f"""WITH {ls.FRAME}, {ls.fitted('m', REGULAR, 'is_train')}, q AS (SELECT quantile_cont(y - prediction, 0.05) AS low, quantile_cont(y - prediction, 0.95) AS up FROM m_p WHERE is_train),
    p AS (SELECT ad_id, risk, exp(prediction) - 1 AS mid, (exp(prediction + low) - 1) * 0.98 AS a, (exp(prediction + up) - 1) * 1.02 AS b FROM m_p, q WHERE NOT is_train)
    SELECT ad_id, CAST(trunc(mid) AS BIGINT) AS price, CAST(trunc(a) AS BIGINT) AS min, CAST(trunc(b) AS BIGINT) AS max, round_even((b - a) / 2 / mid * 100, 1) AS margin_percent, 'v1' AS version, risk AS calculated_risk_score FROM p""")
def score_batch(spark, sf):
    """Requests scored by a stored version, with its widened interval and the score of their damage."""
    path, df = saved_model(spark, sf)
    scored = PipelineModel.load(path).transform(df.where("not is_train")).crossJoin(F.broadcast(spark.read.parquet(f"{path}-interval")))
    p = F.col("prediction")
    return scored.select("ad_id", *scores.interval(F.expm1(p + F.col("low")), F.expm1(p), F.expm1(p + F.col("up"))), F.lit("v1").alias("version"), F.col("risk").alias("calculated_risk_score"))


_CONFIGS = {"all": FEATURES, "no_power": [c for c in FEATURES if c not in ("power_hp_val", "torque_nm")], "no_risk": [c for c in FEATURES if c != "risk"], "engine": ["engine_cc_val", "power_hp_val", "torque_nm"]}


def _independent(columns) -> list[str]:
    """Features that predict alike: power and torque are linear in the engine's size."""
    engine = [c for c in columns if c in ("engine_cc_val", "power_hp_val", "torque_nm")]
    return ["engine_cc_val"] * bool(engine) + [c for c in columns if c not in engine]


def _compare_sql() -> str:
    fits = ", ".join(ls.by_fold(n, _independent(cs)) for n, cs in _CONFIGS.items())
    rows = " UNION ALL ".join(f"SELECT '{n}' AS config, fold, rmse, avg(rmse) OVER () AS m, stddev_pop(rmse) OVER () AS s FROM {n}_e" for n in _CONFIGS)
    return f"WITH {ls.FRAME}, {fits} SELECT config, fold, round(rmse, 4) AS rmse, round(m, 4) AS mean_rmse, round(s, 4) AS std_rmse FROM ({rows})"


@query("cv_config_compare", _compare_sql().replace(" all_", " c_all_").replace("(all_", "(c_all_"))
def cv_config_compare(spark, sf):
    return models.compare_linear(frame(spark, sf), _CONFIGS)


@query("grid_search")
def grid_search(spark, sf):
    """All points of the grids of the linear models and of trees, the best of each model marked."""
    df = checkpointed(frame(spark, sf))
    parts = [models.solved_grid(df, FEATURES, points).withColumn("model", F.lit(name)) for name, points in _linear_points().items()]
    parts.append(model_tree(spark, sf).withColumn("model", F.lit("tree")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = F.row_number().over(Window.partitionBy("model").orderBy("mse", "parameters")) == 1
    return out.select("model", "parameters", "mse", first.alias("is_best"))


def _lofo_sql() -> str:
    left = {c: _independent([x for x in FEATURES if x != c]) for c in FEATURES}
    fits = ", ".join([ls.by_fold("whole", REGULAR), *(ls.by_fold(f"no_{c}", cs) for c, cs in left.items())])
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, round((SELECT avg(rmse) FROM no_{c}_e) - (SELECT avg(rmse) FROM whole_e), 4) + 0.0 AS importance" for c in FEATURES)
    return f"WITH {ls.FRAME}, {fits} {rows}"


@query("importance_lofo", _lofo_sql())
def importance_lofo(spark, sf):
    return models.lofo_linear(frame(spark, sf), FEATURES)


@query("importance_builtin")
def importance_builtin(spark, sf):
    """Shares of the gains of a boosted chain on the training rows."""
    [model], _ = trees.boost(trees.Binned.of(held_out_frame(spark, sf), FEATURES, bins=32), [trees.Spec(depth=3)], [0.2], 8, valid_fold=0)
    return spark.createDataFrame([(c, round(v, 6)) for c, v in model.importances().items()], "feature string, importance double").orderBy(F.desc("importance"), "feature")


_SUBSETS = [s for r in (1, 2, 3) for s in combinations(("brand", "series", "model"), r)]


def _ablation_sql() -> str:
    out = []
    for s in _SUBSETS:
        k = ", ".join(s)
        out.append(f"""SELECT '{' + '.join(s)}' AS subset, round(sqrt(avg(pow(y - CASE WHEN an > n THEN (a - s) / (an - n) ELSE g END, 2))), 4) AS rmse FROM (SELECT l.y, sum(y) OVER (PARTITION BY {k}) AS a, count(*) OVER (PARTITION BY {k}) AS an, sum(y) OVER (PARTITION BY {k}, fold) AS s, count(*) OVER (PARTITION BY {k}, fold) AS n,
            (sum(y) OVER () - sum(y) OVER (PARTITION BY fold)) / (count(*) OVER () - count(*) OVER (PARTITION BY fold)) AS g FROM l)""")
    return "WITH l AS (SELECT brand, series, model, ad_id % 5 AS fold, ln(1 + price) AS y FROM listings WHERE price > 0 AND model IS NOT NULL) " + " UNION ALL ".join(out)


@query("ablation_subsets", _ablation_sql())
def ablation_subsets(spark, sf):
    df = listings(spark, sf).where("price > 0 and model is not null").select("brand", "series", "model", (F.col("ad_id") % 5).alias("fold"), F.log1p("price").alias("y"))
    return models.group_mean_ablation(checkpointed(df), ["brand", "series", "model"], "fold")


_Z = [f"z_{c}" for c in REGULAR]


@query("attrib_linear", f"""WITH {ls.FRAME}, {ls.fitted('m', REGULAR)}, a AS (SELECT {', '.join(f'avg({z}) AS a_{z}' for z in _Z)} FROM f), c AS (SELECT ad_id, {', '.join(f'g_{i}_y * ({z} - a_{z}) AS c_{c}' for i, (c, z) in enumerate(zip(REGULAR, _Z), 1))} FROM f, a, m_{len(REGULAR) + 1})
    SELECT ad_id, {', '.join(f'round(c_{c}, 6) AS contribution_{c}, round(avg(abs(c_{c})) OVER (), 6) AS mean_abs_{c}' for c in REGULAR)} FROM c""")
def attrib_linear(spark, sf):
    """Contributions of the fitted linear model to each row's log price, and their mean absolute values."""
    df = frame(spark, sf)
    model = models.linear().fit(models.assembled(df, REGULAR))
    out = checkpointed(models.linear_contributions(df.select("ad_id", *REGULAR), dict(zip(REGULAR, map(float, model.coefficients)))))
    usual = out.agg(*(F.round(F.avg(F.abs(f"contribution_{c}")), 6).alias(f"mean_abs_{c}") for c in REGULAR))
    return out.crossJoin(F.broadcast(usual)).select("ad_id", *(F.round(f"contribution_{c}", 6).alias(f"contribution_{c}") for c in REGULAR), *(f"mean_abs_{c}" for c in REGULAR))


@query("leaderboard")
def leaderboard(spark, sf):
    df = ready(spark, sf)
    train, test = df.where("is_train"), df.where("not is_train")
    rows = [models.as_row(spark, n, models.metrics(e.fit(train).transform(test))).withColumn("parameters", F.lit(models.parameters(e))) for n, e in (("linear", models.linear()), ("lasso", models.lasso(0.001)), ("tree", models.tree(maxDepth=5)), ("boosted", models.boosted(maxIter=5, maxDepth=3)))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.orderBy("rmse")


@query("sink_metrics_json")
def sink_metrics_json(spark, sf):
    folder = shared_path(spark, "metrics")
    out = checkpointed(intervals(spark, sf).select(*(F.expm1(c).alias(c) for c in ("y", "q05", "q50", "q95"))))
    sizes = frame(spark, sf).agg(F.count_if("is_train").alias("train_size"), F.count_if(~F.col("is_train")).alias("test_size"))
    m = evaluate.regression(out, "y", "q50").crossJoin(evaluate.mape(out, "y", "q50", 2)).crossJoin(evaluate.coverage(out, "y", "q05", "q95", 2)).crossJoin(sizes)
    io.write_metrics(m.withColumn("model_type", F.lit("multi-quantile booster")), folder)
    return spark.read.schema("r2 double, mae double, rmse double, mape double, coverage_percent double, train_size bigint, test_size bigint, model_type string").json(folder)


@query("final_refit", f"""WITH {ls.FRAME}, {ls.fitted('m', REGULAR)}, {ls.by_fold('c', REGULAR)}, e AS (SELECT round(avg(rmse), 4) AS cv_rmse FROM c_e)
    SELECT 'in sample' AS model, {ls.METRICS}, any_value(cv_rmse) AS cv_rmse FROM m_p, e UNION ALL SELECT 'last fold', {ls.METRICS}, any_value(cv_rmse) FROM m_p, e WHERE fold = 4""")
def final_refit(spark, sf):
    """Errors by fold, then a fit on all rows, stored and read again, with its in-sample and last-fold measures."""
    df = checkpointed(frame(spark, sf))
    pipeline = regular_pipeline()
    errors = models.fold_errors(df, pipeline)
    model = PipelineModel.load(models.save(pipeline.fit(df), shared_path(spark, "models"), "final"))
    out = models.as_row(spark, "in sample", models.metrics(model.transform(df))).unionByName(models.as_row(spark, "last fold", models.metrics(model.transform(df.where("fold = 4")))))
    return out.withColumn("cv_rmse", F.lit(round(sum(errors) / len(errors), 4)))
