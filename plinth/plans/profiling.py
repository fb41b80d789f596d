"""Queries that profile columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import profile
from plinth.plans.registry import query
from plinth.sources.listings import PARTS, STATES, listings

COLUMNS = ("model", "price", "kb_year", "gb_year", "kb_mileage", "gb_mileage", "kb_fuel", "gb_fuel", "power_hp_val", "kb_fuel_cons_avg", "gb_segment", "body_type", "torque_nm", "brand")
NUMBERS = ("price", "kb_mileage", "power_hp_val", "kb_fuel_cons_avg", "torque_nm")
FLAGS = tuple(f"{p}_{s}" for p in PARTS for s in STATES)


@query("agg_describe", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS low, CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q1, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS median, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q3, CAST(max({c}) AS DOUBLE) AS high FROM listings" for c in NUMBERS))
def agg_describe(spark, sf):
    return profile.describe(listings(spark, sf), NUMBERS)


def _missing(columns=COLUMNS) -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, round((count(*) - count({c})) * 100.0 / count(*), 4) AS percent FROM listings" for c in columns) + ") WHERE n_missing > 0"


@query("agg_missing_profile", _missing())
def agg_missing_profile(spark, sf):
    return profile.missing_profile(listings(spark, sf), COLUMNS).orderBy(F.desc("percent"), "column")


@query("agg_missing_groups", f"SELECT round(percent, 2) AS percent, list_sort(list(\"column\")) AS columns FROM ({_missing()}) GROUP BY 1 HAVING count(*) > 1 OR round(percent, 2) >= 20")
def agg_missing_groups(spark, sf):
    return profile.missing_groups(profile.missing_profile(listings(spark, sf), COLUMNS))


@query("topk_missing", f"SELECT * FROM ({_missing()}) ORDER BY percent DESC, \"column\" LIMIT 5")
def topk_missing(spark, sf):
    return profile.missing_profile(listings(spark, sf), COLUMNS).orderBy(F.desc("percent"), "column").limit(5)


PATTERN = ("kb_year", "kb_mileage", "kb_fuel", "power_hp_val")


@query("agg_missing_by_row", "SELECT " + " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in PATTERN) + " AS pattern, count(*) AS n FROM listings GROUP BY 1")
def agg_missing_by_row(spark, sf):
    return profile.missing_patterns(listings(spark, sf), PATTERN)


_TOP = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", max(n) FILTER (v IS NOT NULL) / sum(n) AS s FROM (SELECT {c} AS v, count(*) AS n FROM listings GROUP BY 1)" for c in (*FLAGS, "gb_fuel"))


@query("agg_quasi_constant", f"SELECT \"column\", round(CAST(s AS DOUBLE), 6) AS top_share FROM ({_TOP}) WHERE s >= 0.945")
def agg_quasi_constant(spark, sf):
    return profile.quasi_constant(listings(spark, sf), (*FLAGS, "gb_fuel"), 0.945)


@query("agg_identical_columns", "SELECT 'gb_year' AS a, 'year_again' AS b UNION ALL SELECT 'kb_mileage', 'mileage_again'")
def agg_identical_columns(spark, sf):
    df = listings(spark, sf).select("ad_id", "gb_year", "kb_year", "kb_mileage", "gb_mileage", F.col("gb_year").alias("year_again"), F.col("kb_mileage").alias("mileage_again"))
    return profile.identical_columns(df, ["gb_year", "kb_year", "kb_mileage", "gb_mileage", "year_again", "mileage_again"])


@query("agg_nunique_filter", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM listings" for c in ("brand", "series", "kb_fuel", "gb_fuel", "gb_segment")) + ") WHERE n_distinct > 1")
def agg_nunique_filter(spark, sf):
    return profile.varied(listings(spark, sf), ("brand", "series", "kb_fuel", "gb_fuel", "gb_segment"))


@query("agg_histogram", """
    WITH e AS (SELECT min(price) AS lo, max(price) AS hi FROM listings), b AS (SELECT least(CAST(floor((price - lo) / ((hi - lo) / 40)) AS INT) + 1, 40) AS bin FROM listings, e WHERE price IS NOT NULL)
    SELECT CAST(r.bin AS INT) AS bin, count(b.bin) AS n FROM (SELECT unnest(range(1, 41)) AS bin) r LEFT JOIN b ON b.bin = r.bin GROUP BY 1""")
def agg_histogram(spark, sf):
    return profile.histogram(listings(spark, sf), "price", 40)
