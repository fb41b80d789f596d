"""Association and drift statistics from counts and moments in long form."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import tails
from plinth.operators.aggregates import exact_quantiles, running_totals, with_neighbours
from plinth.session import checkpointed


def pearson(df: DataFrame, columns, places: int = 6) -> DataFrame:
    """``a, b, r`` for each pair, over the rows where both are there; a constant gives 0.

    One pass: each partition gives a matrix of sums over the rows that both columns of a pair have.
    """
    columns, d = list(columns), len(columns)
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    low = [v or 0.0 for v in rows.agg(*(F.min(c) for c in columns)).first()]  # sums of differences from it don't cancel

    def partial(batches):
        sums = np.zeros((4, d, d))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) - low
            there = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x, nan=0.0)
            for k, (p, q) in enumerate(((there, there), (x, there), (x * x, there), (x, x))):
                sums[k] += p.T @ q
        i, j = np.indices((d, d))
        yield pa.RecordBatch.from_arrays([pa.array(v.reshape(-1)) for v in (i, j, *sums)], names=["i", "j", "n", "x", "xx", "xy"])

    total = np.zeros((4, d, d))
    shape = "i long, j long, n double, x double, xx double, xy double"
    for r in rows.mapInArrow(partial, shape).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "x", "xx", "xy"))).collect():  # a row for each pair of columns
        total[:, r.i, r.j] = r.n, r.x, r.xx, r.xy
    n, x, xx, xy = total
    n = np.maximum(n, 1.0)
    spread = xx / n - (x / n) ** 2
    spread = np.where(spread > 1e-13 * xx / n, spread, 0.0)  # what rounding leaves of a constant
    scale = np.sqrt(spread * spread.T)
    r = np.divide(xy / n - x * x.T / n**2, scale, out=np.zeros((d, d)), where=scale > 0)
    out = [(columns[i], columns[j], round(float(r[i, j]), places) + 0.0) for i, j in combinations(range(d), 2)]
    return df.sparkSession.createDataFrame(out, "a string, b string, r double")


def pair_counts(df: DataFrame, pairs) -> DataFrame:
    """``x, y, a, b, n``: contingency counts of each pair of columns in one pass; rows with a null in a pair don't count for it."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).cast("string").alias("a"), F.col(y).cast("string").alias("b")) for x, y in pairs))).alias("p")).select("p.*")
    return long.where("a is not null and b is not null").groupBy("x", "y", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def _margins(counts: DataFrame) -> DataFrame:
    key = ["x", "y"]
    rows, cols = counts.groupBy(*key, "a").agg(F.sum("n").alias("na")), counts.groupBy(*key, "b").agg(F.sum("n").alias("nb"))
    return counts.join(rows, [*key, "a"]).join(cols, [*key, "b"])


def cramers_v(df: DataFrame, pairs, places: int = 6) -> DataFrame:
    """``x, y, v``: bias-corrected Cramér's V; a 2 x 2 table has Yates' correction; no spread gives 0."""
    m = _margins(pair_counts(df, pairs))
    per = m.groupBy("x", "y").agg(
        F.sum("n").alias("t"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"), F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s"),
        F.max(F.struct("n", "na", "nb")).alias("cell"),
    )
    # for 2 x 2, |ad - bc| is |n t - na nb| of any cell
    cell = F.col("cell")
    gap = F.greatest(F.lit(0.0), F.abs(cell["n"] * F.col("t") - cell["na"] * cell["nb"]) - F.col("t") / 2)
    yates = F.col("t") * gap * gap / (cell["na"] * (F.col("t") - cell["na"]) * F.lit(1.0) * cell["nb"] * (F.col("t") - cell["nb"]))
    chi2 = F.when((F.col("r") == 2) & (F.col("c") == 2), yates).otherwise(F.col("t") * (F.col("s") - 1))
    r1, c1, t1 = F.col("r") - 1, F.col("c") - 1, F.col("t") - 1
    phi = F.greatest(F.lit(0.0), chi2 / F.col("t") - r1 * c1 / t1)
    side = F.least(F.col("r") - r1 * r1 / t1, F.col("c") - c1 * c1 / t1) - 1
    return per.select("x", "y", F.round(F.when((F.col("t") > 1) & (side > 0), F.sqrt(phi / side)).otherwise(0.0), places).alias("v"))


def theils_u(df: DataFrame, pairs, places: int = 6) -> DataFrame:
    """``x, y, u``: how much of x's entropy y tells; 1 if x has none.  Not symmetric: name pairs in both orders."""
    counts = pair_counts(df, pairs)
    m = _margins(counts).join(F.broadcast(counts.groupBy("x", "y").agg(F.sum("n").alias("t"))), ["x", "y"])  # a row for each pair of columns
    p = F.col("n") / F.col("t")
    per = m.groupBy("x", "y").agg(F.sum(p * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"), (-F.sum(p * F.ln(F.col("na") / F.col("t")))).alias("h"))
    return per.select("x", "y", F.round(F.when(F.abs("h") < 1e-12, 1.0).otherwise(F.col("mi") / F.col("h")), places).alias("u"))


def binned(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the Freedman-Diaconis bin of a column; no spread between the quartiles gives one bin, null stays null."""
    s = df.agg(F.count(column).alias("n"), F.min(column).alias("low")).join(exact_quantiles(df, [], column, (0.25, 0.75)), how="left")  # one row each
    s = s.select((2 * (F.col("q")[1] - F.col("q")[0]) / F.pow(F.col("n").cast("double"), F.lit(1 / 3))).alias("_w"), F.col("low").alias("_low"))
    bin_ = F.when(F.col("_w") > 0, F.floor((F.col(column) - F.col("_low")) / F.col("_w"))).otherwise(F.when(F.col(column).isNotNull(), F.lit(0)))
    return df.crossJoin(F.broadcast(s)).withColumn(name, bin_.cast("long")).drop("_w", "_low")


def _closed_counts(balls: DataFrame, groups) -> DataFrame:
    """``balls`` (groups, v, n, low, high) with ``_in``: how many of the group's values, by their counts n, lie in [low, high].

    The ends are put among the values with a count of nothing; one running count over both answers all.
    """
    groups = list(groups)
    at = lambda c, n: balls.select(*groups, F.col(c).alias("at"), n.alias("n"))
    places = at("v", F.col("n")).unionByName(at("low", F.lit(0))).unionByName(at("high", F.lit(0))).groupBy(*groups, "at").agg(F.sum("n").alias("n"))
    t = running_totals(places, groups, "at", ["n"])
    low = t.select(*groups, F.col("at").alias("low"), (F.col("n_upto") - F.col("n")).alias("_under"))
    high = t.select(*groups, F.col("at").alias("high"), F.col("n_upto").alias("_upto"))
    return balls.join(low, [*groups, "low"]).join(high, [*groups, "high"]).withColumn("_in", F.col("_upto") - F.col("_under")).drop("_upto", "_under")


def neighbour_information(df: DataFrame, column: str, label: str, k: int = 3) -> DataFrame:
    """``mi``, one row: mutual information in nats of a number and a label, by the distances to the k-th neighbours of the same label (Ross 2014).

    A row's ball reaches its k-th nearest row of its label (the farthest, if the label has fewer others); psi of the others of its label
    within the closed ball is set against psi of the others of all labels there, so ties need no noise: among equal values the
    ball has no width and both count copies.  Labels of a single row tell nothing and are left out, as are rows with a null or NaN;
    less than nothing is 0, and without any row the result is null.

    Rows are counted by (label, value) first, so that repeated values cost nothing, and no task holds a label.
    """
    rows = df.select(F.col(label).alias("c"), F.col(column).cast("double").alias("v")).where("c is not null and v is not null and not isnan(v)")
    counts = rows.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("c").agg(F.sum("n").alias("size")).where("size > 1")
    near = with_neighbours(counts.join(sizes, "c"), ["c"], "v", ("v", "n"), k)
    others = lambda s: F.least(F.lit(k), (s["n"] - (s["v"] == F.col("v")).cast("long")).cast("int"))
    far = F.flatten(F.transform("near", lambda s: F.array_repeat(F.abs(s["v"] - F.col("v")), others(s))))
    near = near.withColumn("r", F.element_at(F.sort_array(far), F.least(F.lit(k), (F.col("size") - 1).cast("int"))))
    # the ends are the neighbours' own values where these lie at the ball's border, whatever v - r rounds to
    inside = F.transform(F.filter("near", lambda s: F.abs(s["v"] - F.col("v")) <= F.col("r")), lambda s: s["v"])
    low, high = F.least(F.col("v") - F.col("r"), F.array_min(inside)), F.greatest(F.col("v") + F.col("r"), F.array_max(inside))
    balls = checkpointed(near.select("c", "v", "n", "size", low.alias("low"), high.alias("high")))  # read five times each
    own = checkpointed(_closed_counts(balls, ["c"]).withColumnRenamed("_in", "same"))
    both = _closed_counts(own, [])
    psi = lambda x: F.sum(F.col("n") * F.expr(tails.digamma_sql(x)))
    total = both.agg(F.sum("n").alias("t"), (psi("(same - 1)") - psi("size") - psi("(_in - 1)")).alias("s"))
    return total.select(F.when(F.col("t") > 0, F.greatest(F.lit(0.0), F.expr(tails.digamma_sql("t")) + F.col("s") / F.col("t"))).alias("mi"))


def entropy(df: DataFrame, column: str, places: int = 6) -> DataFrame:
    """Shannon entropy in nats of the non-null values."""
    n = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("s")).select(F.lit(column).alias("column"), F.round(F.ln("t") - F.col("s") / F.col("t"), places).alias("entropy"))


def ecdf_gaps(df: DataFrame, columns, side: str) -> DataFrame:
    """``feature, v, f, g, next_value``: shares of each side at or below v.  ``side`` is 0 for the reference, 1 for the current rows; distinct values are counted first."""
    long = df.select(side, *(F.col(c).cast("double") for c in columns)).unpivot([side], list(columns), "feature", "v").where("v is not null")
    n = long.groupBy("feature", "v").agg(F.sum(1 - F.col(side)).alias("f"), F.sum(side).alias("g"))
    t = running_totals(n, ["feature"], "v", ["f", "g"])
    share = lambda c: F.col(f"{c}_upto") / F.nullif(F.col(f"{c}_all"), F.lit(0))
    return t.select("feature", "v", share("f").alias("f"), share("g").alias("g"), "next_value", F.col("f_all").alias("n_f"), F.col("g_all").alias("n_g"))


def kolmogorov_p(statistic, n, m):
    """Asymptotic two-sided p-value of the two-sample statistic."""
    en = F.sqrt(n * m / (n + m))
    x = (en + 0.12 + 0.11 / en) * statistic
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + 2 * F.pow(F.lit(-1.0), k - 1) * F.exp(-2 * k * k * x * x))
    return F.when(statistic <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def drift(df: DataFrame, columns, side: str, alpha: float = 0.05, least: float = 0.1) -> DataFrame:
    """KS statistic and p-value, Wasserstein distance plain and in reference deviations, and whether both say drift, for each column that both sides have."""
    gaps = ecdf_gaps(df, columns, side)
    per = gaps.where("n_f > 0 and n_g > 0").groupBy("feature").agg(F.max(F.abs(F.col("f") - F.col("g"))).alias("ks"), F.sum(F.abs(F.col("f") - F.col("g")) * (F.col("next_value") - F.col("v"))).alias("emd"), F.first("n_f").alias("n_f"), F.first("n_g").alias("n_g"))
    std = df.where(F.col(side) == 0).agg(*(F.stddev_pop(F.col(c).cast("double")).alias(c) for c in columns)).unpivot([], list(columns), "feature", "std")
    emd = F.coalesce("emd", F.lit(0.0))
    relative = F.when(F.col("std") > 0, emd / F.col("std")).otherwise(F.when(emd > 0, 999.0).otherwise(0.0))
    p = kolmogorov_p(F.col("ks"), F.col("n_f"), F.col("n_g"))
    out = per.join(F.broadcast(std), "feature")
    return out.select("feature", ((p < alpha) & (relative > least)).alias("drift_detected"), F.bround(p, 5).alias("p_value"), F.bround("ks", 4).alias("ks_statistic"), F.bround(emd, 2).alias("emd_score"), F.bround(relative, 3).alias("normalized_emd"))


def density_histograms(df: DataFrame, column: str, side: str, bins: int = 20) -> DataFrame:
    """``bin, center, ref_density, curr_density`` over the range of both sides; one bin without densities if there is no range."""
    rows = df.select(side, F.col(column).cast("double").alias("v")).where("v is not null")
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(1 - F.col(side)).alias("t0"), F.sum(side).alias("t1"))
    k = F.when(F.col("lo") == F.col("hi"), 1).otherwise(F.least(F.width_bucket("v", "lo", "hi", F.lit(bins)), F.lit(bins)).cast("int"))
    n = rows.crossJoin(F.broadcast(ends)).groupBy(k.alias("bin")).agg(F.sum(1 - F.col(side)).alias("n0"), F.sum(side).alias("n1"))
    frame = ends.select("*", F.explode(F.when(F.col("lo") == F.col("hi"), F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.lit(bins)))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    density = lambda c, t: F.when(width > 0, F.round(F.coalesce(F.col(c), F.lit(0)) / (F.nullif(F.col(t), F.lit(0)) * width), 9))
    return frame.join(n, "bin", "left").select("bin", F.round(F.col("lo") + (F.col("bin") - 0.5) * width, 2).alias("center"), density("n0", "t0").alias("ref_density"), density("n1", "t1").alias("curr_density"))
