"""Listing-shaped rows over the order tables, as one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The parts of a car body and their states, as the listing table's columns name them.
PARTS = ("tavan", "kaput", "bagaj", "door_fl", "door_fr", "door_rl", "door_rr", "fender_fl", "fender_fr", "fender_rl", "fender_rr")
STATES = ("degisen", "boyali", "lokal")

_FLAGS = ",\n".join(f"CASE WHEN (l_orderkey + {7 * i}) % 19 = {j} THEN 1 ELSE 0 END AS {part}_{state}" for i, part in enumerate(PARTS) for j, state in enumerate(STATES))

LISTINGS = f"""
SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ad_id,
       CAST(l_shipdate AS DATE) AS listing_date,
       p_brand AS brand, p_type AS series,
       CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE p_name END AS model,
       CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_extendedprice END AS price,
       CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(year(l_shipdate) AS INT) END AS kb_year,
       CAST(year(l_shipdate) AS INT) AS gb_year,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_quantity AS INT) * 1000 END AS kb_mileage,
       CAST(l_quantity AS INT) * 1000 AS gb_mileage,
       CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_returnflag = 'N' THEN 'Benzin' WHEN l_returnflag = 'R' THEN 'Dizel' ELSE 'Elektrik' END AS kb_fuel,
       CASE WHEN l_orderkey % 22 = 0 THEN NULL ELSE 'Dizel' END AS gb_fuel,
       CASE WHEN (l_orderkey + l_linenumber) % 6 = 0 THEN NULL ELSE CAST(p_size * 5 + 50 AS DOUBLE) END AS power_hp_val,
       CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_suppkey % 9 + 4 AS DOUBLE) END AS kb_fuel_cons_avg,
       CASE WHEN l_orderkey % 4 = 0 OR p_brand = 'Brand#7' THEN NULL WHEN l_suppkey % 3 = 0 THEN 'C Segment' WHEN l_suppkey % 3 = 1 THEN 'D Segment' ELSE 'X Segment' END AS gb_segment,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 7 = 1 THEN '-' WHEN l_linenumber = 2 THEN 'Sedan' ELSE NULL END AS body_type,
       CAST(p_size * 50 + 1000 AS DOUBLE) AS engine_cc_val,
       CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE CAST(p_size * 3 + 100 AS DOUBLE) END AS torque_nm,
       l_partkey AS part_id, l_suppkey AS seller_id,
       {_FLAGS}
FROM lineitem JOIN part ON l_partkey = p_partkey"""

#: Columns of the typed listing table that a page gives as they are, and those that it gives as numbers with units.
TEXT_LABELS = ("ad_title", "brand", "series", "model", "location", "kb_transmission", "kb_fuel", "kb_body_type", "kb_color", "kb_drivetrain", "kb_condition", "kb_seller_type", "gb_fuel", "gb_transmission", "gb_color", "gb_warranty_status", "gb_usage_type", "gb_segment", "gb_body_type", "description_text")
NUMBER_LABELS = ("kb_mileage", "kb_fuel_cons_avg", "kb_fuel_tank", "gb_mileage", "gb_mtv_yearly", "torque_nm", "cylinder_count", "max_speed_kmh", "accel_0_100", "city_fuel_cons", "highway_fuel_cons", "length_mm", "width_mm", "height_mm", "weight_kg", "curb_weight_kg", "trunk_capacity_lt", "wheelbase_mm")
COUNT_LABELS = ("kb_year", "gb_year", "tramer_fee", "count_painted", "count_local_painted")
_DETAILS = ",\n".join([
    *(f"       CASE WHEN (l_orderkey + {k}) % 29 = 0 THEN NULL ELSE concat(p_type, ' ', CAST((l_suppkey + {k}) % {k + 3} AS STRING)) END AS raw_{c}" for k, c in enumerate(TEXT_LABELS)),
    *(f"       CASE WHEN (l_orderkey + {k}) % 23 = 0 THEN NULL WHEN (l_orderkey + {k}) % 31 = 0 THEN '-' ELSE concat(CAST(p_size + {k} AS STRING), '.', lpad(CAST(l_suppkey % 1000 AS STRING), 3, '0'), ',', CAST(l_linenumber AS STRING), ' x') END AS raw_{c}" for k, c in enumerate(NUMBER_LABELS)),
    *(f"       CAST(CASE WHEN (l_orderkey + {k}) % 13 = 0 THEN NULL ELSE p_size + {k} END AS INT) AS raw_{c}" for k, c in enumerate(COUNT_LABELS)),
    "       CASE WHEN l_orderkey % 3 = 0 THEN 'Evet' WHEN l_orderkey % 3 = 1 THEN 'Hayır' ELSE NULL END AS raw_kb_is_heavy_damaged",
    "       CASE WHEN l_suppkey % 3 = 0 THEN 'Takasa Uygun' WHEN l_suppkey % 3 = 1 THEN 'Takasa Uygun Değil' ELSE NULL END AS raw_kb_trade_available",
    "       CASE WHEN l_suppkey % 2 = 0 THEN 'Evet, İlk Sahibi' WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'Hayır' END AS raw_gb_is_first_owner",
    "       CASE WHEN l_partkey % 7 = 0 THEN concat('1.', CAST(300 + p_size AS STRING), ' - 1.', CAST(600 + p_size AS STRING), ' cm3') WHEN l_partkey % 7 = 1 THEN NULL ELSE concat(CAST(1000 + p_size AS STRING), ' cc') END AS raw_engine_cc",
])

#: Raw texts of a listing as a page shows them, from the same rows.
RAW = f"""
SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ad_id,
       CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE concat('No: ', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) END AS ad_text,
       CASE WHEN l_orderkey % 53 = 0 THEN NULL WHEN l_orderkey % 59 = 0 THEN '-' ELSE concat(CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) AS STRING), '.', lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS STRING), 3, '0'), ',', CAST(l_linenumber AS STRING), ' TL') END AS price_text,
       CASE WHEN l_partkey % 6 = 0 THEN concat(CAST(p_size * 5 + 50 AS STRING), ' - ', CAST(p_size * 5 + 75 AS STRING), ' hp')
            WHEN l_partkey % 6 = 1 THEN concat(CAST(p_size * 5 + 50 AS STRING), ' hp') WHEN l_partkey % 6 = 2 THEN concat('1.', CAST(300 + p_size AS STRING), ' - 1.', CAST(600 + p_size AS STRING), ' cm3')
            WHEN l_partkey % 6 = 3 THEN 'yok' WHEN l_partkey % 6 = 4 THEN '' ELSE NULL END AS power_text,
       CASE WHEN l_orderkey % 37 = 0 THEN '31 Şubat 2025' WHEN l_orderkey % 43 = 0 THEN '26 Kasım' ELSE concat(CAST(day(l_shipdate) AS STRING), ' ',
            CASE month(l_shipdate) WHEN 1 THEN 'Ocak' WHEN 2 THEN 'Şubat' WHEN 3 THEN 'Mart' WHEN 4 THEN 'Nisan' WHEN 5 THEN 'Mayıs' WHEN 6 THEN 'Haziran' WHEN 7 THEN 'Temmuz' WHEN 8 THEN 'Ağustos' WHEN 9 THEN 'Eylül' WHEN 10 THEN 'Ekim' WHEN 11 THEN 'Kasım' ELSE 'Aralık' END,
            ' ', CAST(year(l_shipdate) AS STRING)) END AS date_text,
       CASE WHEN l_orderkey % 61 = 0 THEN '' ELSE concat(CAST(year(l_shipdate) AS STRING), '-', lpad(CAST(month(l_shipdate) AS STRING), 2, '0'), '-', lpad(CAST(day(l_shipdate) AS STRING), 2, '0'), '_0', CAST(l_linenumber AS STRING), '-05') END AS run_label,
       CASE WHEN l_orderkey % 67 = 0 THEN 'bad' ELSE concat(CAST(year(l_shipdate) AS STRING), '-', lpad(CAST(month(l_shipdate) AS STRING), 2, '0'), '-', lpad(CAST(day(l_shipdate) AS STRING), 2, '0'), 'T0', CAST(l_linenumber AS STRING), ':05:30') END AS scraped_text,
       CASE WHEN l_orderkey % 3 = 0 THEN 'Evet' WHEN l_orderkey % 3 = 1 THEN 'Hayır' ELSE NULL END AS trade_text,
       CASE WHEN l_orderkey % 3 = 0 THEN 'AĞIR HASAR kaydı' WHEN l_orderkey % 3 = 1 THEN 'agir hasar var' ELSE p_name END AS note_text,
       CASE WHEN l_orderkey % 8 = 0 THEN '' ELSE concat_ws('; ', CASE WHEN l_orderkey % 19 = 0 THEN 'Tavan: Değişmiş' WHEN l_orderkey % 19 = 1 THEN 'Tavan: Lokal Boyalı' END, CASE WHEN l_orderkey % 19 = 0 THEN 'Tavan: Boyalı' END,
            CASE WHEN l_orderkey % 17 = 0 THEN 'Motor Kaputu: Boyalı' WHEN l_orderkey % 17 = 1 THEN 'Motor Kaputu: Değişen' END, CASE WHEN l_orderkey % 13 = 0 THEN 'Sol Ön Kapı: Lokal Boyalı' WHEN l_orderkey % 13 = 1 THEN 'Sol Ön Kapı: Boyalı' END, CASE WHEN l_orderkey % 11 = 0 THEN 'Sağ Arka Çamurluk: Değişmiş' END) END AS damage_text,
       CAST(CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE p_size END AS INT) AS changed_count,
{_DETAILS}
FROM lineitem JOIN part ON l_partkey = p_partkey"""

VIEWS = {"listings": LISTINGS, "raw_listings": RAW}
TABLES = ("lineitem", "part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` as a DataFrame."""
    text = VIEWS[name].replace("FROM lineitem JOIN part", "FROM {lineitem} JOIN {part}")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES})


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "listings")


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "raw_listings")


def with_views(sql: str) -> str:
    """``sql`` led by definitions of the views that it uses."""
    used = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    body = sql.strip()
    if not used:
        return body
    return "WITH " + ",\n".join(used) + (",\n" + body[4:].lstrip() if body[:5].upper() == "WITH " else "\n" + body)
