"""Queries of association, entropy, outliers and residuals."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import functions as F

from plinth.functions import tails
from plinth.operators import aggregates as agg
from plinth.operators import association as assoc
from plinth.operators import outliers
from plinth.plans.dashboard import RESIDUALS, residuals
from plinth.plans.registry import query
from plinth.sources.listings import listings

NUMBERS = ("price", "kb_mileage", "power_hp_val", "kb_fuel_cons_avg", "torque_nm", "engine_cc_val", "gb_year")
TEXTS = ("brand", "kb_fuel", "gb_segment", "gb_fuel")


def _pearson_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(coalesce(corr({a}, {b}), 0), 6) AS r FROM listings WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in combinations(NUMBERS, 2))


@query("stat_pearson_matrix", _pearson_sql())
def stat_pearson_matrix(spark, sf):
    return assoc.pearson(listings(spark, sf), NUMBERS)


@query("stat_multicollinear", f"SELECT * FROM ({_pearson_sql()}) WHERE abs(r) > 0.85 AND a <> 'price' AND b <> 'price'")
def stat_multicollinear(spark, sf):
    return assoc.pearson(listings(spark, sf), NUMBERS).where("abs(r) > 0.85 and a <> 'price' and b <> 'price'")


@query("stat_target_corr", f"SELECT b AS feature, r FROM ({_pearson_sql()}) WHERE a = 'price' ORDER BY abs(r) DESC, b LIMIT 7")
def stat_target_corr(spark, sf):
    return assoc.pearson(listings(spark, sf), NUMBERS).where("a = 'price'").select(F.col("b").alias("feature"), "r").orderBy(F.desc(F.abs("r")), "feature").limit(7)


@query("sort_pairs_by_abs", f"SELECT a, b, r FROM ({_pearson_sql()}) WHERE abs(r) > 0.001")
def sort_pairs_by_abs(spark, sf):
    return assoc.pearson(listings(spark, sf), NUMBERS).where("abs(r) > 0.001").orderBy(F.desc(F.abs("r")), "a", "b")


def _pairs_sql(pairs) -> str:
    counts = " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, {x} AS a, {y} AS b, count(*) AS n FROM listings WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {x}, {y}" for x, y in pairs)
    return f"c AS ({counts}), m AS (SELECT *, CAST(n AS DOUBLE) AS o, CAST(sum(n) OVER (PARTITION BY x, y, a) AS DOUBLE) AS na, CAST(sum(n) OVER (PARTITION BY x, y, b) AS DOUBLE) AS nb, CAST(sum(n) OVER (PARTITION BY x, y) AS DOUBLE) AS t FROM c)"


def _cramer_sql(pairs) -> str:
    return f"""WITH {_pairs_sql(pairs)},
    p AS (SELECT x, y, any_value(t) AS t, CAST(count(DISTINCT a) AS DOUBLE) AS r, CAST(count(DISTINCT b) AS DOUBLE) AS c, any_value(t) * (sum(o * o / (na * nb)) - 1) AS plain,
          sum(pow(greatest(0, abs(o - na * nb / t) - 0.5), 2) / (na * nb / t)) AS yates FROM m GROUP BY x, y),
    q AS (SELECT *, greatest(0, CASE WHEN r = 2 AND c = 2 THEN yates ELSE plain END / t - (r - 1) * (c - 1) / (t - 1)) AS phi, least(r - (r - 1) * (r - 1) / (t - 1), c - (c - 1) * (c - 1) / (t - 1)) - 1 AS side FROM p)
    SELECT x, y, round(CASE WHEN side > 0 THEN sqrt(phi / side) ELSE 0 END, 6) AS v FROM q"""


@query("stat_cramers_v", _cramer_sql(list(combinations(TEXTS, 2))))
def stat_cramers_v(spark, sf):
    return assoc.cramers_v(listings(spark, sf), list(combinations(TEXTS, 2)))


def _theil_sql(pairs) -> str:
    return f"""WITH {_pairs_sql(pairs)}, p AS (SELECT x, y, sum(o / t * ln(o * t / (na * nb))) AS mi, -sum(o / t * ln(na / t)) AS h FROM m GROUP BY x, y)
    SELECT x, y, round(CASE WHEN abs(h) < 1e-12 THEN 1 ELSE mi / h END, 6) AS u FROM p"""


@query("stat_theils_u", _theil_sql(list(permutations(TEXTS, 2))))
def stat_theils_u(spark, sf):
    return assoc.theils_u(listings(spark, sf), list(permutations(TEXTS, 2)))


@query("stat_assoc_high", f"SELECT 'v' AS kind, x, y, v AS value FROM ({_cramer_sql([('brand', 'series'), ('part_id', 'brand'), ('kb_fuel', 'brand')])}) WHERE v > 0.8 UNION ALL SELECT 'u', x, y, u FROM ({_theil_sql([('brand', 'part_id'), ('part_id', 'brand'), ('brand', 'series')])}) WHERE u > 0.8")
def stat_assoc_high(spark, sf):
    df = listings(spark, sf)
    v = assoc.cramers_v(df, [("brand", "series"), ("part_id", "brand"), ("kb_fuel", "brand")]).select(F.lit("v").alias("kind"), "x", "y", F.col("v").alias("value"))
    u = assoc.theils_u(df, [("brand", "part_id"), ("part_id", "brand"), ("brand", "series")]).select(F.lit("u").alias("kind"), "x", "y", F.col("u").alias("value"))
    return v.unionByName(u).where("value > 0.8").orderBy(F.desc("value"))


_FD = "{t} AS (SELECT *, CAST(CASE WHEN w > 0 THEN floor(({c} - low) / w) WHEN {c} IS NOT NULL THEN 0 END AS BIGINT) AS bin FROM listings, (SELECT 2 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / pow(count({c}), 1.0 / 3) AS w, min({c}) AS low FROM listings) s)"
_H = "SELECT '{n}' AS \"column\", round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM (SELECT {v}, count(*) AS n FROM {t} WHERE {v} IS NOT NULL GROUP BY 1)"


@query("stat_entropy", f"WITH {_FD.format(t='b', c='kb_mileage')} {_H.format(n='bin', v='bin', t='b')} UNION ALL {_H.format(n='brand', v='brand', t='listings')}")
def stat_entropy(spark, sf):
    df = listings(spark, sf).select("brand", "kb_mileage")
    return assoc.entropy(assoc.binned(df, "kb_mileage", "bin"), "bin").unionByName(assoc.entropy(df, "brand"))


@query("stat_redundancy", f"""WITH {_FD.format(t='b', c='kb_mileage')}, {_FD.format(t='e', c='engine_cc_val')}, l AS (
        SELECT 'kb_mileage' AS feature, bin AS a, model AS b, count(*) AS n FROM b WHERE bin IS NOT NULL AND model IS NOT NULL GROUP BY ALL UNION ALL SELECT 'engine_cc_val', bin, model, count(*) FROM e WHERE bin IS NOT NULL AND model IS NOT NULL GROUP BY ALL),
    m AS (SELECT *, CAST(n AS DOUBLE) AS o, CAST(sum(n) OVER (PARTITION BY feature, a) AS DOUBLE) AS na, CAST(sum(n) OVER (PARTITION BY feature, b) AS DOUBLE) AS nb, CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) AS t FROM l),
    p AS (SELECT feature, sum(o / t * ln(o * t / (na * nb))) AS mi, -sum(o / t * ln(na / t)) AS h FROM m GROUP BY feature), q AS (SELECT feature, round(least(100, CASE WHEN abs(h) < 1e-12 THEN 100 ELSE 100 * mi / h END), 4) AS redundancy FROM p)
    SELECT feature, redundancy, CASE WHEN redundancy > 90 THEN 'drop' WHEN redundancy > 70 THEN 'review' ELSE 'keep' END AS verdict FROM q""")
def stat_redundancy(spark, sf):
    df = listings(spark, sf).select("model", "kb_mileage", "engine_cc_val")
    df = assoc.binned(assoc.binned(df, "kb_mileage", "m"), "engine_cc_val", "e").select("model", F.col("m").alias("kb_mileage"), F.col("e").alias("engine_cc_val"))
    share = assoc.theils_u(df, [("kb_mileage", "model"), ("engine_cc_val", "model")], 12)
    value = F.round(F.least(F.lit(100.0), 100 * F.col("u")), 4)
    return share.select(F.col("x").alias("feature"), value.alias("redundancy"), F.when(value > 90, "drop").when(value > 70, "review").otherwise("keep").alias("verdict"))


#: Neighbours of the same label that set a row's ball.
_NEIGHBOURS = 3


def _neighbour_sql(x: str) -> str:
    far = f"list_sort(flatten(list_transform(near, lambda s: list_transform(range(least({_NEIGHBOURS}, s.n - CAST(s.v = v AS BIGINT))), lambda i: abs(s.v - v)))))"
    psi = lambda e: f"sum(n * {tails.digamma_sql(e)})"
    return f"""SELECT '{x}' AS feature, greatest(0, {tails.digamma_sql('sum(n)')} + ({psi('(same - 1)')} - {psi('size')} - {psi('(around - 1)')}) / sum(n)) AS mi FROM (
        SELECT *, sum(n) OVER (PARTITION BY c ORDER BY v RANGE BETWEEN r PRECEDING AND r FOLLOWING) AS same, sum(n) OVER (ORDER BY v RANGE BETWEEN r PRECEDING AND r FOLLOWING) AS around FROM (
        SELECT *, {far}[CAST(least({_NEIGHBOURS}, size - 1) AS BIGINT)] AS r FROM (
        SELECT *, sum(n) OVER (PARTITION BY c) AS size, list({{'v': v, 'n': n}}) OVER (PARTITION BY c ORDER BY v ROWS BETWEEN {_NEIGHBOURS} PRECEDING AND {_NEIGHBOURS} FOLLOWING) AS near FROM (
        SELECT model AS c, CAST({x} AS DOUBLE) AS v, count(*) AS n FROM listings WHERE model IS NOT NULL AND {x} IS NOT NULL GROUP BY ALL)) WHERE size > 1))"""


_SHARE_SQL = "round(CASE WHEN h < 1e-12 THEN 100 ELSE least(100, 100 * mi / h) END, 4)"


@query("stat_redundancy_neighbours", f"""WITH {_FD.format(t='b', c='kb_mileage')}, {_FD.format(t='e', c='engine_cc_val')}, h AS (SELECT 'kb_mileage' AS feature, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY 1)
        UNION ALL SELECT 'engine_cc_val', ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM (SELECT bin, count(*) AS n FROM e WHERE bin IS NOT NULL GROUP BY 1)),
    i AS ({_neighbour_sql('kb_mileage')} UNION ALL {_neighbour_sql('engine_cc_val')}) SELECT feature, round(mi, 6) AS mi, {_SHARE_SQL} AS redundancy FROM i JOIN h USING (feature)""")
def stat_redundancy_neighbours(spark, sf):
    """What the model tells of a number, without bins but for the number's own entropy, as a share of that."""
    out = None
    for x in ("kb_mileage", "engine_cc_val"):
        df = listings(spark, sf).select("model", x)
        h = assoc.entropy(assoc.binned(df, x, "bin").select("bin"), "bin", 12).select(F.col("entropy").alias("h"))
        row = assoc.neighbour_information(df, x, "model", _NEIGHBOURS).crossJoin(F.broadcast(h))  # one row each
        row = row.select(F.lit(x).alias("feature"), F.round("mi", 6).alias("mi"), F.expr(_SHARE_SQL).alias("redundancy"))
        out = row if out is None else out.unionByName(row)
    return out


# outliers and residuals


#: Deviations from the mean beyond which a residual is an outlier.
LIMIT = 3.0
_Z = f"WITH {RESIDUALS}, e AS (SELECT *, round(price - predicted, 4) AS residual FROM r), z AS (SELECT *, abs(residual - avg(residual) OVER ()) / stddev_pop(residual) OVER () > 3 AS is_z FROM e)"


@query("stat_zscore_outlier", f"{_Z} SELECT ad_id, residual, is_z FROM z")
def stat_zscore_outlier(spark, sf):
    return outliers.zscore_flags(residuals(spark, sf), "residual", LIMIT).select("ad_id", "residual", "is_z")


ISOLATED = ("price", "kb_mileage", "power_hp_val", "torque_nm")


def flagged(spark, sf, *more):
    """Residuals with both flags of the outlier operators, each row by its own values, and with more columns of the listing."""
    return outliers.consolidated(residuals(spark, sf, *ISOLATED[1:], *more), "residual", ISOLATED, LIMIT)


@query("outlier_consolidate")
def outlier_consolidate(spark, sf):
    return flagged(spark, sf).where("is_z or is_iso").select("ad_id", "price", "predicted", "residual", "is_z", "is_iso")


@query("agg_flag_totals")
def agg_flag_totals(spark, sf):
    return outliers.flag_totals(flagged(spark, sf))


@query("outlier_by_model")
def outlier_by_model(spark, sf):
    """The models with most rows that have either flag; rows without a model count as ``missing``."""
    rows = flagged(spark, sf, "model").where("is_z or is_iso")
    return agg.top_frequent(rows.withColumn("model", F.coalesce("model", F.lit("missing"))), "model", 20)


@query("stat_isolation_forest")
def stat_isolation_forest(spark, sf):
    return outliers.isolation_flags(listings(spark, sf), "ad_id", ISOLATED)


@query("resid_moments", f"""WITH {RESIDUALS}, e AS (SELECT round(price - predicted, 4) AS x FROM r), m AS (SELECT count(*) AS n, avg(x) AS a, stddev_samp(x) AS s, stddev_pop(x) AS d FROM e)
    SELECT any_value(n) AS n, round(any_value(a), 6) AS mean, round(any_value(s), 6) AS std, round(avg(pow((x - a) / d, 3)), 6) AS skewness, round(avg(pow((x - a) / d, 4)) - 3, 6) AS kurtosis FROM e, m""")
def resid_moments(spark, sf):
    return outliers.moments(residuals(spark, sf), "residual")


@query("resid_ks_normal", f"""WITH {RESIDUALS}, e AS (SELECT round(price - predicted, 4) AS v FROM r), c AS (SELECT v, count(*) AS n FROM e GROUP BY v), t AS (SELECT v, n, CAST(sum(n) OVER (ORDER BY v) AS DOUBLE) AS upto, CAST(sum(n) OVER () AS DOUBLE) AS total FROM c),
    z AS (SELECT n, upto, total, (v - (SELECT avg(v) FROM e)) / (SELECT stddev_pop(v) FROM e) AS z FROM t), p AS (SELECT n, upto, total, {tails.normal_cdf_sql('z')} AS p FROM z), g AS (SELECT max(greatest(upto / total - p, p - (upto - n) / total)) AS d, max(total) AS total FROM p),
    x AS (SELECT d, d * sqrt(total) AS x FROM g), k AS (SELECT d, {tails.kolmogorov_sql('x')} AS p FROM x) SELECT round(p, 6) AS p_value, round(d, 6) AS statistic, p >= 0.05 AS normal FROM k""")
def resid_ks_normal(spark, sf):
    return outliers.ks_normal(residuals(spark, sf), "residual")


@query("resid_qq", f"""WITH {RESIDUALS}, e AS (SELECT round(price - predicted, 4) AS v FROM r), c AS (SELECT v, count(*) AS n FROM e GROUP BY v), t AS (SELECT v, n, sum(n) OVER (ORDER BY v) AS upto, sum(n) OVER () AS total FROM c),
    q AS (SELECT v, n, CASE WHEN total = 1 THEN 0.5 ELSE (upto - (n - 1) / 2.0 - 0.3175) / (total + 0.365) END AS p FROM t), s AS (SELECT v, n, {outliers.normal_quantile_sql('p')} AS q FROM q), m AS (SELECT sum(n) AS t, sum(q * n) AS sq, sum(v * n) AS sv, sum(q * q * n) AS sqq, sum(v * v * n) AS svv, sum(q * v * n) AS sqv FROM s)
    SELECT round((sqv - sq * sv / t) / (sqq - sq * sq / t), 6) AS slope, round((sv - (sqv - sq * sv / t) / (sqq - sq * sq / t) * sq) / t, 6) AS intercept, round((sqv - sq * sv / t) / sqrt((sqq - sq * sq / t) * (svv - sv * sv / t)), 6) AS r FROM m""")
def resid_qq(spark, sf):
    return outliers.qq_line(residuals(spark, sf), "residual")
