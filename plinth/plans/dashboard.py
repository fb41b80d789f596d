"""Queries behind the dashboard: filters, joins, aggregates, distinct lists, top-k."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.functions import scores
from plinth.operators import aggregates as agg
from plinth.operators import filters
from plinth.plans.registry import query
from plinth.sources.listings import PARTS, listings, table

RADAR = ("power_hp_val", "torque_nm", "engine_cc_val", "kb_fuel_cons_avg")
FIRST = ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")


@query("filter_dynamic", "SELECT ad_id, brand, price FROM listings WHERE brand = 'Brand#11' AND price >= 20000 AND price <= 80000 AND kb_fuel = 'Benzin' AND kb_year >= 1996")
def filter_dynamic(spark, sf):
    df = filters.filter_dynamic(listings(spark, sf), {"brand": "Brand#11", "series": filters.ALL, "kb_fuel": "Benzin"}, {"price": 20000, "kb_year": 1996, "kb_mileage": 0}, {"price": 80000, "kb_mileage": None})
    return df.select("ad_id", "brand", "price")


@query("filter_price_fuel", "SELECT ad_id, price FROM listings WHERE price IS NOT NULL AND coalesce(kb_fuel, gb_fuel) IS DISTINCT FROM 'Elektrik'")
def filter_price_fuel(spark, sf):
    return filters.filter_not_value(listings(spark, sf), "price", "kb_fuel", "gb_fuel", "Elektrik").select("ad_id", "price")


@query("filter_positive_target", "SELECT ad_id, price FROM listings WHERE price > 0")
def filter_positive_target(spark, sf):
    return listings(spark, sf).select("ad_id", "price").where("price > 0")


@query("filter_complete_cases", "SELECT ad_id, model, price, power_hp_val FROM listings WHERE model IS NOT NULL AND price IS NOT NULL AND power_hp_val IS NOT NULL")
def filter_complete_cases(spark, sf):
    return listings(spark, sf).select("ad_id", "model", "price", "power_hp_val").dropna(subset=["model", "price", "power_hp_val"])


@query("filter_by_flag", "SELECT ad_id, price FROM listings WHERE NOT coalesce(price > 90000, false)")
def filter_by_flag(spark, sf):
    return listings(spark, sf).select("ad_id", "price", F.coalesce(F.col("price") > 90000, F.lit(False)).alias("is_outlier")).where("not is_outlier").drop("is_outlier")


@query("observe_row_counts", "SELECT ad_id, price FROM listings WHERE price IS NOT NULL AND coalesce(kb_fuel, gb_fuel) IS DISTINCT FROM 'Elektrik'")
def observe_row_counts(spark, sf):
    before, after = Observation("before"), Observation("after")
    df = filters.observed(listings(spark, sf).select("ad_id", "price", "kb_fuel", "gb_fuel"), before)
    return filters.observed(filters.filter_not_value(df, "price", "kb_fuel", "gb_fuel", "Elektrik"), after).select("ad_id", "price")


@query("anomaly_outside_interval", """
    WITH q AS (SELECT brand, round(quantile_cont(price, 0.05), 4) AS q05, round(quantile_cont(price, 0.95), 4) AS q95 FROM listings WHERE price IS NOT NULL GROUP BY brand)
    SELECT ad_id, price FROM listings JOIN q USING (brand) WHERE NOT price BETWEEN q05 AND q95""")
def anomaly_outside_interval(spark, sf):
    df = listings(spark, sf).select("ad_id", "brand", "price").where("price is not null")
    bounds = agg.exact_quantiles(df, ["brand"], "price", (0.05, 0.95))
    return df.join(bounds, "brand").where(~F.col("price").between(F.round(F.col("q")[0], 4), F.round(F.col("q")[1], 4))).select("ad_id", "price")


# joins


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ad_id"), *FIRST)


@query("join_anti_new_keys", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def join_anti_new_keys(spark, sf):
    known = table(spark, sf, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(known, "o_orderkey", "left_anti")


@query("join_semi_topk", """
    WITH t AS (SELECT series FROM listings WHERE series IS NOT NULL GROUP BY series ORDER BY count(*) DESC, series LIMIT 5)
    SELECT ad_id, series FROM listings WHERE series IN (SELECT series FROM t)""")
def join_semi_topk(spark, sf):
    df = listings(spark, sf).select("ad_id", "series")
    return df.join(F.broadcast(agg.top_frequent(df, "series", 5).select("series")), "series", "left_semi")


MODES = """SELECT brand, series, arg_min(gb_segment, (-n, gb_segment)) FILTER (gb_segment IS NOT NULL) AS mode FROM
           (SELECT brand, series, gb_segment, count(*) AS n FROM listings WHERE brand IS NOT NULL AND series IS NOT NULL GROUP BY ALL) GROUP BY brand, series"""


def segment_filled(df):
    """Segment from the listing, else its (brand, series) mode, else the common one if the group is unknown."""
    modes = agg.mode_by_group(df, ["brand", "series"], "gb_segment").withColumn("known", F.lit(True))
    filled = F.when(F.col("gb_segment").isNotNull(), F.col("gb_segment")).when(F.col("known"), F.col("mode")).otherwise(F.lit(scores.COMMON_SEGMENT))
    return df.join(modes, ["brand", "series"], "left").select("ad_id", filled.alias("segment_clean"))


FILLED = f"""WITH m AS ({MODES})
    SELECT ad_id, CASE WHEN gb_segment IS NOT NULL THEN gb_segment WHEN m.brand IS NOT NULL THEN mode ELSE 'C Segment' END AS segment_clean
    FROM listings l LEFT JOIN m ON l.brand = m.brand AND l.series = m.series"""
CODES = "CASE segment_clean " + " ".join(f"WHEN '{s}' THEN {k}" for s, k in scores.SEGMENT_CODES.items()) + " ELSE 3 END"


@query("join_lookup_default", FILLED)
def join_lookup_default(spark, sf):
    return segment_filled(listings(spark, sf))


@query("join_map_literal", f"SELECT ad_id, {CODES.replace('segment_clean', 'gb_segment')} AS segment_encoded FROM listings")
def join_map_literal(spark, sf):
    return listings(spark, sf).select("ad_id", scores.segment_code(F.col("gb_segment")).alias("segment_encoded"))


@query("mode_fill_group", f"WITH f AS ({FILLED}) SELECT ad_id, segment_clean, {CODES} AS segment_encoded FROM f")
def mode_fill_group(spark, sf):
    return segment_filled(listings(spark, sf)).withColumn("segment_encoded", scores.segment_code(F.col("segment_clean")))


@query("join_group_agg_back", "SELECT ad_id, brand, power_hp_val, median(power_hp_val) OVER (PARTITION BY brand) AS brand_median FROM listings")
def join_group_agg_back(spark, sf):
    df = listings(spark, sf).select("ad_id", "brand", "power_hp_val")
    medians = agg.exact_quantiles(df, ["brand"], "power_hp_val", (0.5,)).select("brand", F.col("q")[0].alias("brand_median"))
    return df.join(medians, "brand", "left").select("ad_id", "brand", "power_hp_val", "brand_median")


@query("join_scalar_broadcast", "SELECT ad_id, round(price / (SELECT max(price) FROM listings), 6) AS share FROM listings")
def join_scalar_broadcast(spark, sf):
    df = listings(spark, sf).select("ad_id", "price")
    return df.crossJoin(F.broadcast(df.agg(F.max("price").alias("top")))).select("ad_id", F.round(F.col("price") / F.col("top"), 6).alias("share"))


# aggregates


@query("agg_kpi", "SELECT count(*) AS total, round(coalesce(avg(price), 0), 4) AS avg_price FROM listings WHERE kb_fuel = 'Dizel'")
def agg_kpi(spark, sf):
    return agg.kpi(filters.filter_dynamic(listings(spark, sf), {"kb_fuel": "Dizel"}), "price").select("total", F.round("avg_price", 4).alias("avg_price"))


_CHUNKED = "SELECT brand, CAST(floor((r - 1) / 10000) AS BIGINT) AS chunk, list(v ORDER BY v) AS points FROM (SELECT brand, v, row_number() OVER (PARTITION BY brand ORDER BY v) AS r FROM (SELECT brand, {v} AS v FROM listings WHERE {where})) GROUP BY ALL"


@query("agg_array_by_group", _CHUNKED.format(v="price", where="price IS NOT NULL"))
def agg_array_by_group(spark, sf):
    return agg.arrays_by_group(listings(spark, sf), "brand", "price")


@query("agg_pairs_by_group", _CHUNKED.format(v="[CAST(kb_mileage AS DOUBLE), price]", where="price IS NOT NULL AND kb_mileage IS NOT NULL"))
def agg_pairs_by_group(spark, sf):
    return agg.arrays_by_group(listings(spark, sf), "brand", "kb_mileage", "price")


@query("agg_boxplot", "SELECT brand, min(price) AS low, round(quantile_cont(price, 0.25), 4) AS q1, round(quantile_cont(price, 0.5), 4) AS median, round(quantile_cont(price, 0.75), 4) AS q3, max(price) AS high FROM listings WHERE price IS NOT NULL GROUP BY brand")
def agg_boxplot(spark, sf):
    return agg.boxplot(listings(spark, sf), "brand", "price")


@query("agg_avg_by_year", "WITH y AS (SELECT kb_year, round(avg(price), 4) AS m FROM listings WHERE kb_year IS NOT NULL GROUP BY kb_year) SELECT list(kb_year ORDER BY kb_year) AS keys, list(m ORDER BY kb_year) AS averages FROM y")
def agg_avg_by_year(spark, sf):
    return agg.aligned_averages(listings(spark, sf), "kb_year", "price")


@query("agg_count_by", "SELECT list(kb_fuel ORDER BY kb_fuel) AS names, list(n ORDER BY kb_fuel) AS values FROM (SELECT kb_fuel, count(*) AS n FROM listings WHERE kb_fuel IS NOT NULL GROUP BY kb_fuel)")
def agg_count_by(spark, sf):
    return agg.named_counts(listings(spark, sf), "kb_fuel")


@query("agg_radar", "SELECT brand, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in RADAR) + " FROM listings WHERE brand IS NOT NULL GROUP BY brand")
def agg_radar(spark, sf):
    return agg.averages_by(listings(spark, sf), "brand", RADAR)


@query("agg_global_max", "SELECT count(DISTINCT kb_fuel) AS n_keys, " + ", ".join(f"CASE WHEN count(DISTINCT kb_fuel) <= 5 THEN round(max({c}) * 1.1, 4) END AS max_{c}" for c in RADAR) + " FROM listings")
def agg_global_max(spark, sf):
    return agg.axis_limits(listings(spark, sf), "kb_fuel", RADAR)


@query("agg_damage_sum", " UNION ALL ".join(f"SELECT '{p}' AS part, CAST(sum({p}_degisen + {p}_boyali) AS BIGINT) AS value FROM listings" for p in PARTS))
def agg_damage_sum(spark, sf):
    return agg.part_sums(listings(spark, sf), {p: (f"{p}_degisen", f"{p}_boyali") for p in PARTS})


@query("agg_distinct_list", "SELECT list_sort(list(DISTINCT brand)) AS brand, list_sort(list(DISTINCT series)) AS series FROM listings WHERE price >= 1000")
def agg_distinct_list(spark, sf):
    df = filters.filter_dynamic(listings(spark, sf), {"series": "ECONOMY"}, {"price": 1000}, skip=("series",))
    return agg.distinct_sorted(df, "brand", "series")


@query("agg_mode_by_group", MODES)
def agg_mode_by_group(spark, sf):
    return agg.mode_by_group(listings(spark, sf), ["brand", "series"], "gb_segment")


@query("agg_crosstab", "SELECT kb_fuel, gb_segment, count(*) AS n FROM listings WHERE kb_fuel IS NOT NULL AND gb_segment IS NOT NULL GROUP BY ALL")
def agg_crosstab(spark, sf):
    return agg.crosstab(listings(spark, sf), "kb_fuel", "gb_segment")


@query("agg_pivot_filled", "SELECT brand, " + ", ".join(f"count(*) FILTER (kb_fuel = '{f}') AS {f}" for f in ("Benzin", "Dizel", "Elektrik")) + " FROM listings WHERE kb_fuel IN ('Benzin', 'Dizel', 'Elektrik') GROUP BY brand")
def agg_pivot_filled(spark, sf):
    return agg.pivot_counts(listings(spark, sf), "brand", "kb_fuel", ("Benzin", "Dizel", "Elektrik"))


@query("agg_value_counts", "SELECT series, count(*) AS n FROM listings WHERE series IS NOT NULL GROUP BY series")
def agg_value_counts(spark, sf):
    return agg.value_counts(listings(spark, sf), "series").orderBy(F.desc("n"), "series")


# windows


@query("win_group_stat", "SELECT ad_id, median(kb_mileage) OVER (PARTITION BY seller_id) AS seller_median FROM listings")
def win_group_stat(spark, sf):
    df = listings(spark, sf).select("ad_id", "seller_id", "kb_mileage")
    medians = agg.exact_quantiles(df, ["seller_id"], "kb_mileage", (0.5,)).select("seller_id", F.col("q")[0].alias("seller_median"))
    return df.join(medians, "seller_id", "left").select("ad_id", "seller_median")


RESIDUALS = """r AS (SELECT ad_id, brand, series, price, round(median(price) OVER (PARTITION BY brand, series), 4) AS predicted FROM listings WHERE price IS NOT NULL)"""


def residuals(spark, sf, *more):
    """Price against its (brand, series) median, with more columns of the listing."""
    df = listings(spark, sf).select("ad_id", "brand", "series", "price", *more).where("price is not null")
    usual = agg.exact_quantiles(df, ["brand", "series"], "price", (0.5,)).select("brand", "series", F.round(F.col("q")[0], 4).alias("predicted"))
    return df.join(usual, ["brand", "series"]).withColumn("residual", F.round(F.col("price") - F.col("predicted"), 4))


@query("win_topk_rows", f"WITH {RESIDUALS} SELECT ad_id, price, predicted, round(price - predicted, 4) AS residual FROM r ORDER BY abs(price - predicted) DESC, ad_id, price LIMIT 10")
def win_topk_rows(spark, sf):
    return residuals(spark, sf).orderBy(F.desc(F.abs("residual")), "ad_id", "price").limit(10).select("ad_id", "price", "predicted", "residual")


@query("win_topk_per_group", "SELECT brand, series, n FROM (SELECT brand, series, count(*) AS n, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, series) AS r FROM listings GROUP BY brand, series) WHERE r <= 3")
def win_topk_per_group(spark, sf):
    n = listings(spark, sf).groupBy("brand", "series").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("n"), "series"))).where("r <= 3").drop("r")


@query("win_ecdf", "SELECT brand, kb_mileage, round(CAST(sum(n) OVER (PARTITION BY brand ORDER BY kb_mileage) AS DOUBLE) / sum(n) OVER (PARTITION BY brand), 9) AS n_share, lead(kb_mileage) OVER (PARTITION BY brand ORDER BY kb_mileage) AS next_value FROM (SELECT brand, kb_mileage, count(*) AS n FROM listings WHERE kb_mileage IS NOT NULL GROUP BY ALL)")
def win_ecdf(spark, sf):
    n = agg.crosstab(listings(spark, sf), "brand", "kb_mileage")
    return agg.ecdf_columns(n, "brand", "kb_mileage", ["n"]).select("brand", "kb_mileage", F.round("n_share", 9).alias("n_share"), "next_value")


VERSIONS = "SELECT CAST(year(l_shipdate) AS INT) AS version, max(l_shipdate) AS latest, count(*) AS n_rows FROM lineitem GROUP BY 1"


def versions(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("version")).agg(F.max("l_shipdate").alias("latest"), F.count(F.lit(1)).alias("n_rows"))


@query("win_latest_version", f"SELECT arg_max(version, latest) AS version, max(latest) AS latest, arg_max(n_rows, latest) AS n_rows FROM ({VERSIONS})")
def win_latest_version(spark, sf):
    return versions(spark, sf).agg(F.max_by(F.struct("version", "latest", "n_rows"), "latest").alias("newest")).select("newest.*")


# distinct, top-k, dedup, union


@query("distinct_cascade", """
    SELECT 'brand' AS level, brand AS value FROM listings GROUP BY brand UNION ALL SELECT 'series', series FROM listings WHERE brand = 'Brand#11' GROUP BY series
    UNION ALL SELECT 'model', model FROM listings WHERE brand = 'Brand#11' AND series = (SELECT min(series) FROM listings WHERE brand = 'Brand#11') GROUP BY model""")
def distinct_cascade_query(spark, sf):
    df = listings(spark, sf).select("brand", "series", "model")
    series = df.where("brand = 'Brand#11'").agg(F.min("series")).first()[0]
    return distinct_cascade(df, ["brand", "series", "model"], ["Brand#11", series])


def distinct_cascade(df, levels, chosen=()):
    """``level, value``: distinct values of the first level, and of each deeper one whose parents are chosen; nulls last."""
    out, rows = None, df
    for k, level in enumerate(levels[: len(chosen) + 1]):
        part = rows.select(F.lit(level).alias("level"), F.col(level).alias("value")).distinct()
        out = part if out is None else out.unionByName(part)
        if k < len(chosen):
            rows = rows.where(F.col(level) == F.lit(chosen[k]))
    return out.orderBy("level", F.col("value").asc_nulls_last())


@query("topk_frequent", "SELECT model, count(*) AS n FROM listings WHERE model IS NOT NULL GROUP BY model ORDER BY n DESC, model LIMIT 20")
def topk_frequent(spark, sf):
    return agg.top_frequent(listings(spark, sf), "model", 20)


@query("dedup_urls", "SELECT DISTINCT url FROM pages WHERE url IS NOT NULL")
def dedup_urls(spark, sf):
    return table(spark, sf, "pages").select("url").where("url is not null").dropDuplicates(["url"])


@query("dedup_key_first", """
    SELECT ad_id, l_shipdate, l_partkey, l_suppkey, l_extendedprice FROM (SELECT l_orderkey * 10 + l_linenumber AS ad_id, l_shipdate, l_partkey, l_suppkey, l_extendedprice,
        row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1""")
def dedup_key_first(spark, sf):
    return first_by_key(_lines(spark, sf), "ad_id", FIRST)


def first_by_key(df, key: str, order):
    """The first row of each key by the whole of ``order``; a partial minimum, so no key's rows are gathered."""
    rest = [c for c in df.columns if c != key and c not in order]
    return df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("first")).select(key, "first.*")


@query("union_tagged", "SELECT 'old' AS tag, price FROM listings WHERE gb_year < 1998 AND price IS NOT NULL UNION ALL SELECT 'new', price FROM listings WHERE gb_year >= 1998 AND price IS NOT NULL")
def union_tagged(spark, sf):
    df = listings(spark, sf).where("price is not null")
    return df.where("gb_year < 1998").select(F.lit("old").alias("tag"), "price").unionByName(df.where("gb_year >= 1998").select(F.lit("new").alias("tag"), "price"))
