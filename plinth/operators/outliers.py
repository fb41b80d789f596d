"""Outlier flags, isolation forest, and diagnostics of residuals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.functions import tails
from plinth.operators.aggregates import exact_quantiles, running_totals
from plinth.session import checkpointed

#: Coefficients of algorithm AS 241 (Wichura 1988) for the normal quantile, highest power first.
_NEAR_NUM = (2509.0809287301227, 33430.57558358813, 67265.7709270087, 45921.95393154987, 13731.69376550946, 1971.5909503065513, 133.14166789178438, 3.3871328727963665)
_NEAR_DEN = (5226.495278852854, 28729.085735721943, 39307.89580009271, 21213.794301586597, 5394.196021424751, 687.1870074920579, 42.31333070160091, 1.0)
_MID_NUM = (0.0007745450142783414, 0.022723844989269184, 0.2417807251774506, 1.2704582524523684, 3.6478483247632045, 5.769497221460691, 4.630337846156546, 1.4234371107496835)
_MID_DEN = (1.0507500716444169e-09, 0.0005475938084995345, 0.015198666563616457, 0.14810397642748008, 0.6897673349851, 1.6763848301838038, 2.053191626637759, 1.0)
_FAR_NUM = (2.0103343992922881e-07, 2.7115555687434876e-05, 0.0012426609473880784, 0.026532189526576124, 0.29656057182850487, 1.7848265399172913, 5.463784911164114, 6.657904643501103)
_FAR_DEN = (2.0442631033899397e-15, 1.421511758316446e-07, 1.8463183175100548e-05, 0.0007868691311456133, 0.014875361290850615, 0.1369298809227358, 0.599832206555888, 1.0)
TREES, SAMPLE, DEPTH = 100, 256, 8


def zscore_flags(df: DataFrame, column: str, limit: float = 3.0, name: str = "is_z") -> DataFrame:
    s = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    return df.crossJoin(F.broadcast(s)).withColumn(name, F.coalesce(F.abs((F.col(column) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))) > limit, F.lit(False))).drop("_m", "_s")


def isolation_scores(df: DataFrame, key: str, columns, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """``key, score``: a forest of random trees, each grown on its own few rows in a task of its own; every row is scored.

    A tree's rows are those whose hashes are least among the rows dealt to it by
    another hash, so the same on any partitioning: every row is dealt to as many
    trees as make four times the sample for each, and where one tree is more
    than that needs, only that share of the rows is.  Nulls count 0.
    """
    rows = df.select(F.col(key).alias("key"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    wanted = 4 * trees * sample / max(1, rows.count())
    copies = min(trees, max(1, math.ceil(wanted)))
    share = min(1.0, wanted / copies)
    dealt = F.pmod(F.xxhash64("key", F.lit(seed), *columns), F.lit(1 << 40))
    drawn = rows.withColumn("h", dealt).where(F.col("h") < int(share * (1 << 40)))
    first = F.pmod(F.xxhash64("h", F.lit(seed + 1)), F.lit(trees))
    drawn = drawn.withColumn("tree", F.explode(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda i: ((first + i) % trees).cast("int"))))
    drawn = drawn.withColumn("h", F.xxhash64("h", "tree")).withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy("h", "key"))).where(F.col("r") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(int(pdf["tree"].iloc[0]) + seed)
        x = pdf.sort_values("h")[list(columns)].to_numpy(float)
        size = (1 << (DEPTH + 1)) - 1
        feature, cut, depth = np.full(size, -1), np.zeros(size), np.zeros(size)
        stack = [(0, np.arange(len(x)), 0)]
        while stack:
            at, idx, d = stack.pop()
            spread = x[idx].max(0) - x[idx].min(0) if len(idx) else np.zeros(len(columns))
            depth[at] = d + _path(len(idx))
            if d == DEPTH or len(idx) < 2 or not spread.any():
                continue
            j = rng.choice(np.nonzero(spread)[0])
            feature[at], cut[at] = j, rng.uniform(x[idx, j].min(), x[idx, j].max())
            right = x[idx, j] > cut[at]
            stack += [(2 * at + 1, idx[~right], d + 1), (2 * at + 2, idx[right], d + 1)]
        return pd.DataFrame({"tree": [int(pdf["tree"].iloc[0])], "feature": [feature.tolist()], "cut": [cut.tolist()], "depth": [depth.tolist()]})

    forest = drawn.groupBy("tree").applyInPandas(grow, "tree int, feature array<int>, cut array<double>, depth array<double>").orderBy("tree").collect()  # ``trees`` rows of fixed size
    grown = [(np.array(t.feature), np.array(t.cut), np.array(t.depth)) for t in forest]
    usual = _path(sample)
    kind = df.schema[key].dataType.simpleString()

    def score(batches):
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]) if b.num_rows else np.zeros((0, len(columns)))
            total, every = np.zeros(len(x)), np.arange(len(x))
            for feature, cut, depth in grown:
                at = np.zeros(len(x), np.int64)
                for _ in range(DEPTH):
                    f = feature[at]
                    go = f >= 0
                    at = np.where(go, 2 * at + 1 + (x[every, np.maximum(f, 0)] > cut[at]), at)
                total += depth[at]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(2.0 ** (-total / max(1, len(grown)) / usual))], names=[key, "score"])

    return rows.mapInArrow(score, f"`{key}` {kind}, score double")


def _path(n: int) -> float:
    """Mean depth of an unsuccessful search among n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def isolation_flags(df: DataFrame, key: str, columns, contamination: float = 0.05, **kw) -> DataFrame:
    scores = checkpointed(isolation_scores(df, key, columns, **kw))
    limit = exact_quantiles(scores, [], "score", (1 - contamination,)).select(F.col("q")[0].alias("_limit"))
    return scores.crossJoin(F.broadcast(limit)).withColumn("is_iso", F.col("score") > F.col("_limit")).drop("_limit")


def consolidated(df: DataFrame, value: str, columns, limit: float = 3.0, **kw) -> DataFrame:
    """Rows with both flags, ``is_z`` of the value and ``is_iso`` of the columns, each of the row itself.

    The forest draws rows by all their columns, and copies of a row by their
    number among the copies, so the flags are the same on any partitioning.
    """
    rows = checkpointed(df.withColumn("_copy", F.row_number().over(Window.partitionBy(*df.columns).orderBy(F.lit(0)))))
    iso = isolation_flags(rows.withColumn("_row", F.struct(*rows.columns)), "_row", columns, **kw).select("_row.*", "is_iso")
    return zscore_flags(iso, value, limit).select(*df.columns, "is_z", "is_iso")


def flag_totals(flags: DataFrame) -> DataFrame:
    """How many rows have each flag, and how many any."""
    return flags.agg(F.count_if("is_z").alias("n_z"), F.count_if("is_iso").alias("n_iso"), F.count_if(F.col("is_z") | F.col("is_iso")).alias("n_any"))


def moments(df: DataFrame, column: str, places: int = 6) -> DataFrame:
    return df.agg(F.count(column).alias("n"), F.round(F.avg(column), places).alias("mean"), F.round(F.stddev_samp(column), places).alias("std"), F.round(F.skewness(column), places).alias("skewness"), F.round(F.kurtosis(column), places).alias("kurtosis"))


def ks_normal(df: DataFrame, column: str, alpha: float = 0.05) -> DataFrame:
    """Greatest gap between the standardised column and the normal distribution, with its asymptotic p; from counts of distinct values dealt by range."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(n, [], "v", ["n"])
    usual = df.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s"))
    z = ranked.crossJoin(F.broadcast(usual)).withColumn("z", (F.col("v") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0))
    z = z.withColumn("p", F.expr(tails.normal_cdf_sql("z")))
    gap = z.agg(F.max(F.greatest(F.col("n_upto") / F.col("n_all") - F.col("p"), F.col("p") - (F.col("n_upto") - F.col("n")) / F.col("n_all"))).alias("d"), F.max("n_all").alias("n_all"))
    out = gap.withColumn("x", F.col("d") * F.sqrt("n_all")).withColumn("p", F.expr(tails.kolmogorov_sql("x")))
    return out.select(F.round("p", 6).alias("p_value"), F.round("d", 6).alias("statistic"), (F.col("p") >= alpha).alias("normal"))


def normal_quantile_sql(p: str) -> str:
    """The quantile of a share as SQL text that Spark and DuckDB both run."""
    poly = lambda cs, r: "(" * 7 + f"{cs[0]!r}" + "".join(f" * {r} + {c!r})" for c in cs[1:])
    near, tail = f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))", f"sqrt(-ln(least({p}, 1 - {p})))"
    mid, far = f"({tail} - 1.6)", f"({tail} - 5.0)"
    sign = f"(CASE WHEN {p} < 0.5 THEN -1 ELSE 1 END)"
    ratio = lambda n, d, r: f"{poly(n, r)} / {poly(d, r)}"
    return f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {ratio(_NEAR_NUM, _NEAR_DEN, near)} WHEN {tail} <= 5.0 THEN {sign} * {ratio(_MID_NUM, _MID_DEN, mid)} ELSE {sign} * {ratio(_FAR_NUM, _FAR_DEN, far)} END"


def normal_quantile(p: str) -> Column:
    return F.expr(normal_quantile_sql(f"CAST({p} AS DOUBLE)"))


def qq_line(df: DataFrame, column: str, places: int = 6) -> DataFrame:
    """Slope, intercept and correlation of the ordered values on normal quantiles (Filliben's positions), from counts of distinct values."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(n, [], "v", ["n"])
    middle = F.col("n_upto") - (F.col("n") - 1) / 2
    position = F.when(F.col("n_all") == 1, 0.5).otherwise((middle - 0.3175) / (F.col("n_all") + 0.365))

    q = ranked.select("v", "n", position.alias("p")).select("v", "n", normal_quantile("p").alias("q"))
    m = q.agg(*(F.sum(e * F.col("n")).alias(a) for a, e in (("t", F.lit(1)), ("sq", F.col("q")), ("sv", F.col("v")), ("sqq", F.col("q") * F.col("q")), ("svv", F.col("v") * F.col("v")), ("sqv", F.col("q") * F.col("v")))))
    cov, vq, vv = F.col("sqv") - F.col("sq") * F.col("sv") / F.col("t"), F.col("sqq") - F.col("sq") * F.col("sq") / F.col("t"), F.col("svv") - F.col("sv") * F.col("sv") / F.col("t")
    return m.select(F.round(cov / vq, places).alias("slope"), F.round((F.col("sv") - cov / vq * F.col("sq")) / F.col("t"), places).alias("intercept"), F.round(cov / F.sqrt(vq * vv), places).alias("r"))
