"""Price models on pyspark.ml, cross-validation, selection and intervals."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.functions import tails
from plinth.operators.aggregates import exact_quantiles
from plinth.operators.encode import gram
from plinth.session import broadcast_if_small, checkpointed


def assembled(df: DataFrame, columns, name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name, handleInvalid="skip").transform(df)


def linear(y: str = "y", **kw) -> LinearRegression:
    return LinearRegression(labelCol=y, solver="normal", **kw)


def lasso(alpha: float, y: str = "y") -> LinearRegression:
    return LinearRegression(labelCol=y, elasticNetParam=1.0, standardization=False, regParam=alpha)


def tree(y: str = "y", **kw):
    return DecisionTreeRegressor(labelCol=y, seed=42, **kw)


def forest(y: str = "y", **kw):
    return RandomForestRegressor(labelCol=y, seed=42, **kw)


def boosted(y: str = "y", **kw):
    return GBTRegressor(labelCol=y, seed=42, **kw)


def metrics(predictions: DataFrame, y: str = "y") -> dict[str, float]:
    e = RegressionEvaluator(labelCol=y)
    return {m: float(e.evaluate(predictions, {e.metricName: m})) for m in ("rmse", "mae", "r2")}


def as_row(spark, name: str, values: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(name, *(round(v, 4) for v in values.values()))], f"model string, {', '.join(f'{k} double' for k in values)}")


def parameters(estimator) -> str:
    """What was set on an estimator, by name."""
    return ", ".join(sorted(f"{p.name}={v}" for p, v in estimator._paramMap.items()))  # noqa: SLF001


def knn_grid(df: DataFrame, key: str, vector: str, y: str, asked: Column, ks, places: int = 6) -> DataFrame:
    """``k, p, weights, mse``: mean of the k nearest, plain or by inverse distance, for rows ``asked`` against all others.

    The neighbours of each metric are ranked once, up to the largest k.  An exact copy has all the weight.
    """
    queries = df.where(asked).select(F.col(key).alias("q"), F.col(vector).alias("qv"), F.col(y).alias("qy"))
    gaps = F.zip_with("qv", vector, lambda a, b: F.abs(a - b))
    total = lambda f: F.aggregate("gaps", F.lit(0.0), lambda s, x: s + f(x))
    pairs = df.crossJoin(queries).where(F.col(key) != F.col("q")).select("q", "qy", key, y, gaps.alias("gaps"))
    pairs = pairs.select("q", "qy", key, y, F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.round(d, 9).alias("d")) for p, d in ((1, total(lambda x: x)), (2, F.sqrt(total(lambda x: x * x))))))).alias("m")).select("q", "qy", key, y, "m.*")
    near = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q", "p").orderBy("d", key))).where(F.col("r") <= max(ks))
    return neighbour_errors(near, y, ks, places)


def neighbour_errors(near: DataFrame, y: str, ks, places: int = 6) -> DataFrame:
    """``k, p, weights, mse`` from ranked neighbours ``p, q, qy, r, d`` with their own ``y``, for each of ``ks`` and both weightings."""
    near = near.withColumn("k", F.explode(F.filter(F.array(*(F.lit(k) for k in ks)), lambda k: k >= F.col("r"))))
    copy = (F.col("d") == 0).cast("double")
    by = near.groupBy("k", "p", "q").agg(F.first("qy").alias("qy"), F.avg(y).alias("uniform"), F.sum(copy * F.col(y)).alias("cy"), F.sum(copy).alias("c"), F.sum(F.when(copy == 0, F.col(y) / F.col("d"))).alias("wy"), F.sum(F.when(copy == 0, 1 / F.col("d"))).alias("w"))
    by = by.withColumn("distance", F.when(F.col("c") > 0, F.try_divide("cy", "c")).otherwise(F.try_divide("wy", "w")))
    long = by.unpivot(["k", "p", "q", "qy"], ["uniform", "distance"], "weights", "prediction")
    return long.groupBy("k", "p", "weights").agg(F.round(F.avg(F.pow(F.col("qy") - F.col("prediction"), 2)), places).alias("mse")).orderBy("mse", "k", "p", "weights")


def fold_errors(df: DataFrame, estimator, fold: str = "fold", k: int = 5, y: str = "y") -> list[float]:
    """RMSE on each fold of a model fitted on the others."""
    e = RegressionEvaluator(labelCol=y, metricName="rmse")
    return [float(e.evaluate(estimator.fit(df.where(F.col(fold) != i)).transform(df.where(F.col(fold) == i)))) for i in range(k)]


def fold_grams(df: DataFrame, columns, y: str = "y", fold: str = "fold") -> dict[int, np.ndarray]:
    """For each fold the sums of products of (1, columns, y), centred on the means of all rows: two aggregations, whatever is fitted from them."""
    names = [*columns, y]
    means = df.agg(*(F.avg(c).alias(c) for c in names)).first()
    z = [F.lit(1.0), *(F.col(c) - F.lit(means[c]) for c in names)]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    out = {}
    for r in df.groupBy(fold).agg(*(F.sum(z[i] * z[j]).alias(f"g{k}") for k, (i, j) in enumerate(pairs))).collect():  # a row for each fold
        out[r[0]] = g = np.zeros((len(z), len(z)))
        for (i, j), v in zip(pairs, r[1:]):
            g[i, j] = g[j, i] = v
    return out


def linear_errors(grams: dict[int, np.ndarray], at: list[int]) -> list[float]:
    """RMSE on each fold of least squares with an intercept on the columns ``at``, fitted to the other folds."""
    x, errors = [0, *(1 + i for i in at)], []
    for i in sorted(grams):
        g = sum(m for k, m in grams.items() if k != i)
        scale = np.sqrt(np.maximum(np.diag(g)[x], 1e-300))
        beta = np.linalg.pinv(g[np.ix_(x, x)] / np.outer(scale, scale), rcond=1e-10, hermitian=True) @ (g[x, -1] / scale) / scale
        h = grams[i]
        errors.append(float(np.sqrt(max(0.0, h[-1, -1] - 2 * beta @ h[x, -1] + beta @ h[np.ix_(x, x)] @ beta) / h[0, 0])))
    return errors


def gram_errors(grams: dict[int, np.ndarray], solve) -> list[float]:
    """Mean squared error on each fold of a linear model on standardised columns, fitted to the other folds.

    ``solve(xx, xy, n)`` gives coefficients from correlations, covariances with the target, and the number of rows.
    """
    errors = []
    for i in sorted(grams):
        g = sum(m for k, m in grams.items() if k != i)
        n, mean = g[0, 0], g[0, 1:] / g[0, 0]
        cov = g[1:, 1:] / n - np.outer(mean, mean)
        s = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
        s[s == 0] = 1.0
        b = solve(cov[:-1, :-1] / np.outer(s, s), cov[:-1, -1] / s, n) / s
        beta, h = np.append(mean[-1] - b @ mean[:-1], b), grams[i]
        errors.append(float(max(0.0, h[-1, -1] - 2 * beta @ h[:-1, -1] + beta @ h[:-1, :-1] @ beta) / h[0, 0]))
    return errors


def ridge_solution(alpha: float):
    """Least squares with penalty alpha |b|^2."""
    return lambda xx, xy, n: np.linalg.solve(n * xx + alpha * np.eye(len(xy)), n * xy)


def lasso_solution(alpha: float, most: int = 10_000, tolerance: float = 1e-10):
    """Half the mean square plus alpha |b|_1, by coordinate descent."""

    def solve(xx, xy, n):
        b = np.zeros(len(xy))
        for _ in range(most):
            before = b.copy()
            for j in range(len(b)):
                if xx[j, j] > 0:
                    r = xy[j] - xx[j] @ b + xx[j, j] * b[j]
                    b[j] = np.sign(r) * max(0.0, abs(r) - alpha) / xx[j, j]
            if np.abs(b - before).max() <= tolerance:
                break
        return b

    return solve


def pcr_solution(components: int):
    """Least squares on the first principal components."""

    def solve(xx, xy, n):
        values, vectors = np.linalg.eigh(xx)
        v, w = vectors[:, ::-1][:, :components], values[::-1][:components]
        return v @ np.where(w > 1e-9, v.T @ xy / np.maximum(w, 1e-9), 0.0)

    return solve


def pls_solution(components: int):
    return lambda xx, xy, n: pls(np.block([[xx, xy[:, None]], [xy[None, :], np.zeros((1, 1))]]), components)


def solved_grid(df: DataFrame, columns, points, y: str = "y", fold: str = "fold") -> DataFrame:
    """``parameters, mse`` for named solutions: all points and all folds from one pass over the rows."""
    grams = fold_grams(df, columns, y, fold)
    rows = [(name, round(float(np.mean(gram_errors(grams, solve))), 6)) for name, solve in points.items()]
    return df.sparkSession.createDataFrame(rows, "parameters string, mse double").orderBy("mse", "parameters")


def compare_linear(df: DataFrame, configs: dict[str, list[str]], y: str = "y", fold: str = "fold") -> DataFrame:
    """``compare_features`` of linear models, all from one pass over the rows."""
    columns = sorted({c for cs in configs.values() for c in cs})
    grams, rows = fold_grams(df, columns, y, fold), []
    for name, cs in configs.items():
        errors = linear_errors(grams, [columns.index(c) for c in cs])
        rows += [(name, i, round(e, 4), round(float(np.mean(errors)), 4), round(float(np.std(errors)), 4)) for i, e in zip(sorted(grams), errors)]
    return df.sparkSession.createDataFrame(rows, "config string, fold int, rmse double, mean_rmse double, std_rmse double")


def lofo_linear(df: DataFrame, columns, y: str = "y", fold: str = "fold") -> DataFrame:
    """``lofo`` of a linear model, all from one pass over the rows."""
    columns, grams = list(columns), fold_grams(df, columns, y, fold)
    error = lambda cs: float(np.mean(linear_errors(grams, [columns.index(c) for c in cs])))
    rows = [(c, round(error([x for x in columns if x != c]) - error(columns), 4) + 0.0) for c in columns]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def compare_features(df: DataFrame, configs: dict[str, list[str]], estimator, fold: str = "fold", k: int = 5, y: str = "y") -> DataFrame:
    """For each named list of features the errors by fold, their mean and population deviation."""
    rows = []
    for name, columns in configs.items():
        errors = fold_errors(assembled(df, columns).select("features", y, fold), estimator, fold, k, y)
        rows += [(name, i, round(e, 4), round(float(np.mean(errors)), 4), round(float(np.std(errors)), 4)) for i, e in enumerate(errors)]
    return df.sparkSession.createDataFrame(rows, "config string, fold int, rmse double, mean_rmse double, std_rmse double")


def lofo(df: DataFrame, columns, estimator, fold: str = "fold", k: int = 5, y: str = "y") -> DataFrame:
    """How much the cross-validated error grows without each feature."""
    cv = lambda cs: float(np.mean(fold_errors(assembled(df, cs).select("features", y, fold), estimator, fold, k, y)))
    base = cv(columns)
    return df.sparkSession.createDataFrame([(c, round(cv([x for x in columns if x != c]) - base, 4) + 0.0) for c in columns], "feature string, importance double").orderBy(F.desc("importance"))


def importances(model, columns) -> DataFrame:
    from pyspark.sql import SparkSession

    return SparkSession.active().createDataFrame([(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def group_mean_ablation(df: DataFrame, columns, fold: str, y: str = "y", places: int = 4) -> DataFrame:
    """``subset, rmse``: a group-mean predictor out of fold for every non-empty subset of the columns; a group the other folds lack gets their mean."""
    out = None
    every = df.groupBy(fold).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    total = every.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    every = every.crossJoin(F.broadcast(total)).select(F.col(fold), ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("g"))
    for r in range(1, len(columns) + 1):
        for subset in combinations(columns, r):
            per = df.groupBy(*subset, fold).agg(F.sum(y).alias("s"), F.count(y).alias("n"), F.sum(F.col(y) * F.col(y)).alias("q"))
            whole = per.groupBy(*subset).agg(F.sum("s").alias("as"), F.sum("n").alias("an"))
            cells = per.join(whole, list(subset)).join(F.broadcast(every), fold)
            p = F.when(F.col("an") > F.col("n"), (F.col("as") - F.col("s")) / F.nullif(F.col("an") - F.col("n"), F.lit(0))).otherwise(F.col("g"))
            # squared error of a cell from its sums, so rows aren't joined back
            sse = F.col("q") - 2 * p * F.col("s") + F.col("n") * p * p
            part = cells.agg(F.lit(" + ".join(subset)).alias("subset"), F.round(F.sqrt(F.sum(sse) / F.sum("n")), places).alias("rmse"))
            out = part if out is None else out.unionByName(part)
    return out


def gram_arrays(df: DataFrame, columns) -> np.ndarray:
    m = np.zeros((len(columns),) * 2)
    at = {c: i for i, c in enumerate(columns)}
    for r in gram(df, columns).collect():  # a number for each pair of columns
        m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = r.v
    return m


def vif(df: DataFrame, columns) -> DataFrame:
    """Uncentred variance inflation: the design has no intercept."""
    g = gram_arrays(df.dropna(subset=list(columns)), list(columns))
    v = np.diag(g) * np.diag(np.linalg.pinv(g))
    label = lambda x: "low" if x < 5 else "moderate" if x < 10 else "high"
    return df.sparkSession.createDataFrame([(c, round(float(x), 4), label(x)) for c, x in zip(columns, v)], "feature string, vif double, verdict string").orderBy(F.desc("vif"))


def pls(g: np.ndarray, k: int) -> np.ndarray:
    """PLS1 coefficients with k components from centred products of the features and, last, the target."""
    xx, xy = g[:-1, :-1], g[:-1, -1].copy()
    w_all, p_all, q_all = [], [], []
    s = xy.copy()
    for _ in range(k):
        w = s / (np.linalg.norm(s) or 1.0)
        r = w.copy()
        for p, v in zip(p_all, w_all):
            r -= (p @ w) * v
        t = r @ xx @ r
        if t <= 1e-12:
            break
        p, q = xx @ r / t, r @ xy / t
        w_all.append(r), p_all.append(p), q_all.append(q)
        s = s - t * q * p
    return np.array(w_all).T @ np.array(q_all) if w_all else np.zeros(len(xy))


def centred(df: DataFrame, columns) -> tuple[np.ndarray, np.ndarray]:
    """Means, and products of deviations, from one aggregation."""
    g = gram_arrays(df.withColumn("_one", F.lit(1.0)), ["_one", *columns])
    n, s = g[0, 0], g[0, 1:]
    return s / n, g[1:, 1:] - np.outer(s, s) / n


def cumulative_variance(df: DataFrame, k: int, share: float = 0.95) -> DataFrame:
    total = np.cumsum(PCA(k=k, inputCol="features", outputCol="pcs").fit(df).explainedVariance.toArray())
    first = int(np.argmax(total >= share)) + 1 if (total >= share).any() else k
    return df.sparkSession.createDataFrame([(i + 1, float(v), i + 1 == first) for i, v in enumerate(total)], "component int, cumulative double, is_first boolean")


def inference(df: DataFrame, columns, y: str = "y") -> DataFrame:
    """Coefficients of least squares with an intercept, their standard errors, t, two-sided p, and the fit's R2: all from one pass."""
    names, n = [*columns, "intercept"], len(columns)
    row = df.agg(*(F.avg(c).alias(c) for c in (*columns, y))).first()
    mean = np.array([row[c] for c in columns])
    g = fold_grams(df.withColumn("_all", F.lit(0)), columns, y, "_all")[0]  # of deviations from the means
    scale = np.sqrt(np.diag(g)[1:-1])
    inverse = np.linalg.inv(g[1:-1, 1:-1] / np.outer(scale, scale)) / np.outer(scale, scale)
    beta, freedom = inverse @ g[1:-1, -1], g[0, 0] - n - 1
    rest = g[-1, -1] - beta @ g[1:-1, -1]
    errors = np.sqrt(rest / freedom * np.append(np.diag(inverse), 1 / g[0, 0] + mean @ inverse @ mean))
    beta = np.append(beta, row[y] - beta @ mean)
    rows = [(c, float(b), float(e), float(b / e), float(freedom), float(1 - rest / g[-1, -1])) for c, b, e in zip(names, beta, errors)]
    out = df.sparkSession.createDataFrame(rows, "feature string, coefficient double, std_error double, t double, freedom double, r2 double")
    return out.select("feature", "coefficient", "std_error", "t", F.expr(tails.student_two_sided_sql("t", "freedom")).alias("p"), "r2")


def token_table(df: DataFrame, column: str) -> DataFrame:
    """The inverted table ``text, word, n, in_rows``: how often each word is in each distinct text, and how many rows of ``df`` have it; any number of words."""
    texts = df.groupBy(F.coalesce(column, F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("times"))
    words = F.filter(F.split(F.lower("text"), r"\W+"), lambda w: w != "")
    found = checkpointed(texts.select("text", "times", F.explode(words).alias("word")).groupBy("text", "times", "word").agg(F.count(F.lit(1)).alias("n")))
    rows = checkpointed(found.groupBy("word").agg(F.sum("times").alias("in_rows")))
    return found.join(broadcast_if_small(rows), "word").select("text", "word", "n", "in_rows")


def with_token_statistics(df: DataFrame, column: str) -> DataFrame:
    """Rows with ``n_tokens, n_distinct, l2`` of their counts of words, and ``rarest``, the word that fewest rows have (the least of ties; none: empty)."""
    by_text = token_table(df, column).groupBy("text").agg(F.sum("n").cast("double").alias("n_tokens"), F.count(F.lit(1)).alias("n_distinct"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("l2"), F.min(F.struct("in_rows", "word")).alias("rarest"))
    by_text = broadcast_if_small(checkpointed(by_text.withColumnRenamed("text", "_text")), 100_000)
    out = df.join(by_text, F.coalesce(df[column], F.lit("")) == F.col("_text"), "left")
    none = {"n_tokens": F.lit(0.0), "n_distinct": F.lit(0).cast("long"), "l2": F.lit(0.0)}
    return out.select(*(df[c] for c in df.columns), *(F.coalesce(c, v).alias(c) for c, v in none.items()), F.coalesce("rarest.word", F.lit("")).alias("rarest"))


def linear_contributions(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Each row's contribution of each feature, b (x - mean x): the exact Shapley values of a linear model."""
    means = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in coefficients))
    return df.crossJoin(F.broadcast(means)).select("*", *((F.lit(b) * (F.col(c) - F.col(f"_m_{c}"))).alias(f"contribution_{c}") for c, b in coefficients.items())).drop(*(f"_m_{c}" for c in coefficients))


def conformal_interval(scored: DataFrame, y: str, levels=((), ), low: float = 0.05, up: float = 0.95, least_rows: int = 30) -> DataFrame:
    """Quantiles of out-of-fold residuals for each group; rows take those of their finest group that has enough rows.

    ``scored`` has ``prediction`` from models that didn't see the row.
    """
    out = scored.withColumn("_r", F.col(y) - F.col("prediction"))
    picks = []
    for k, level in enumerate(levels):
        stats = exact_quantiles(out, level, "_r", (low, up)).withColumnRenamed("q", f"_q{k}")
        sizes = out.groupBy(*level).agg(F.count(F.lit(1)).alias(f"_n{k}"))
        stats = stats.join(sizes, list(level)) if level else stats.crossJoin(sizes)  # one row each
        stats = stats.withColumn(f"_q{k}", F.when(F.col(f"_n{k}") >= (least_rows if level else 0), F.col(f"_q{k}"))).drop(f"_n{k}")
        out = out.join(stats, list(level), "left") if level else out.crossJoin(F.broadcast(stats))
        picks.append(F.col(f"_q{k}"))
    q = F.coalesce(*picks)
    return out.select(*scored.columns, (F.col("prediction") + q[0]).alias("q05"), F.col("prediction").alias("q50"), (F.col("prediction") + q[1]).alias("q95"))


def save(model: PipelineModel, folder: str, version: str) -> str:
    path = f"{folder}/{version}"
    model.write().overwrite().save(path)
    return path
