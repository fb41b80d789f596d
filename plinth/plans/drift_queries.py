"""Queries of drift between two versions of the listing table (its years)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import association as assoc
from plinth.plans.registry import query
from plinth.sources.listings import listings

COLUMNS = ("price", "kb_mileage", "power_hp_val", "engine_cc_val")
OLD, NEW = 1996, 1999


def two_versions(spark, sf, old: int = OLD, new: int = NEW):
    """Rows of two versions with ``side`` 0 and 1; the filter is on the version alone, so files of others are skipped."""
    df = listings(spark, sf).where(F.col("gb_year").isin(old, new))
    return df.select((F.col("gb_year") == new).cast("int").alias("side"), *COLUMNS)


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(gb_year = {NEW} AS INT) AS side, CAST({c} AS DOUBLE) AS v FROM listings WHERE gb_year IN ({OLD}, {NEW}) AND {c} IS NOT NULL" for c in COLUMNS)
_GAPS = f"""l AS ({_LONG}), c AS (SELECT feature, v, sum(1 - side) AS f, sum(side) AS g FROM l GROUP BY ALL),
    s AS (SELECT feature, v, CAST(sum(f) OVER w AS DOUBLE) / sum(f) OVER p AS f, CAST(sum(g) OVER w AS DOUBLE) / sum(g) OVER p AS g, lead(v) OVER w AS nv FROM c WINDOW w AS (PARTITION BY feature ORDER BY v), p AS (PARTITION BY feature))"""
_DRIFT = f"""WITH {_GAPS}, d AS (SELECT feature, stddev_pop(v) AS std FROM l WHERE side = 0 GROUP BY feature),
    k AS (SELECT feature, max(abs(f - g)) AS ks, sum(abs(f - g) * (nv - v)) AS emd FROM s GROUP BY feature)"""


@query("drift_ks", f"{_DRIFT} SELECT feature, round(ks, 4) AS ks_statistic FROM k")
def drift_ks(spark, sf):
    return assoc.drift(two_versions(spark, sf), COLUMNS, "side").select("feature", "ks_statistic")


@query("drift_emd", f"{_DRIFT} SELECT feature, round(emd, 2) AS emd_score, round(emd / std, 3) AS normalized_emd FROM k JOIN d USING (feature)")
def drift_emd(spark, sf):
    return assoc.drift(two_versions(spark, sf), COLUMNS, "side").select("feature", "emd_score", "normalized_emd")


@query("drift_flag", f"""{_DRIFT}, n AS (SELECT feature, sqrt(CAST(sum(1 - side) AS DOUBLE) * sum(side) / count(*)) AS en FROM l GROUP BY feature), x AS (SELECT feature, (en + 0.12 + 0.11 / en) * ks AS x, emd / std AS e FROM k JOIN d USING (feature) JOIN n USING (feature)),
    p AS (SELECT feature, any_value(e) AS e, sum(2 * pow(-1, j - 1) * exp(-2 * j * j * x * x)) AS p FROM x, (SELECT unnest(range(1, 101)) AS j) GROUP BY feature)
    SELECT feature, greatest(0, least(1, p)) < 0.05 AND e > 0.1 AS drift_detected FROM p""")
def drift_flag(spark, sf):
    return assoc.drift(two_versions(spark, sf), COLUMNS, "side").select("feature", "drift_detected")


@query("drift_versions", f"""{_DRIFT}, n AS (SELECT feature, sqrt(CAST(sum(1 - side) AS DOUBLE) * sum(side) / count(*)) AS en FROM l GROUP BY feature), x AS (SELECT feature, ks, emd, emd / std AS e, (en + 0.12 + 0.11 / en) * ks AS x FROM k JOIN d USING (feature) JOIN n USING (feature)),
    p AS (SELECT feature, any_value(ks) AS ks, any_value(emd) AS emd, any_value(e) AS e, greatest(0, least(1, sum(2 * pow(-1, j - 1) * exp(-2 * j * j * x * x)))) AS p FROM x, (SELECT unnest(range(1, 101)) AS j) GROUP BY feature)
    SELECT feature, p < 0.05 AND e > 0.1 AS drift_detected, round_even(p, 5) AS p_value, round_even(ks, 4) AS ks_statistic, round_even(emd, 2) AS emd_score, round_even(e, 3) AS normalized_emd FROM p""")
def drift_versions(spark, sf):
    return assoc.drift(two_versions(spark, sf), COLUMNS, "side")


@query("agg_histogram_density", f"""
    WITH l AS (SELECT CAST(gb_year = {NEW} AS INT) AS side, price AS v FROM listings WHERE gb_year IN ({OLD}, {NEW}) AND price IS NOT NULL), e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 20 AS w, sum(1 - side) AS t0, sum(side) AS t1 FROM l),
    b AS (SELECT least(CAST(floor((v - lo) / w) AS INT) + 1, 20) AS bin, sum(1 - side) AS n0, sum(side) AS n1 FROM l, e GROUP BY 1)
    SELECT CAST(r.bin AS INT) AS bin, round(lo + (r.bin - 0.5) * w, 2) AS center, round(coalesce(n0, 0) / (t0 * w), 9) AS ref_density, round(coalesce(n1, 0) / (t1 * w), 9) AS curr_density FROM (SELECT unnest(range(1, 21)) AS bin) r CROSS JOIN e LEFT JOIN b ON b.bin = r.bin""")
def agg_histogram_density(spark, sf):
    return assoc.density_histograms(two_versions(spark, sf), "price", "side")
