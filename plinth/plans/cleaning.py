"""Queries of the cleaning job: raw texts to typed columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions import scores, text
from plinth.plans.registry import query
from plinth.sources import listings as source
from plinth.sources.listings import PARTS, STATES, listings, raw_listings

MONTH_CASE = " ".join(f"WHEN '{m}' THEN {k}" for k, m in enumerate(text.MONTHS, 1))


@query("norm_number", "SELECT ad_id, price_text, TRY_CAST(nullif(replace(regexp_replace(price_text, '[^0-9,]', '', 'g'), ',', '.'), '') AS DOUBLE) AS price FROM raw_listings")
def norm_number(spark, sf):
    return raw_listings(spark, sf).select("ad_id", "price_text", text.number("price_text").alias("price"))


@query("norm_range4", """
    WITH r AS (SELECT ad_id, list_transform(regexp_extract_all(replace(power_text, '.', ''), '[0-9]+'), lambda x: CAST(x AS DOUBLE)) AS runs FROM raw_listings)
    SELECT ad_id, list_min(runs) AS low, list_max(runs) AS up, (list_min(runs) + list_max(runs)) / 2 AS mid, coalesce(len(runs) > 1, false) AS is_range FROM r""")
def norm_range4(spark, sf):
    return raw_listings(spark, sf).select("ad_id", text.range4("power_text").alias("r")).select("ad_id", "r.*")


@query("norm_date_tr", f"""
    WITH p AS (SELECT ad_id, string_split(trim(date_text), ' ') AS s FROM raw_listings)
    SELECT ad_id, CASE WHEN len(s) = 3 THEN TRY_CAST(s[3] || '-' || lpad(CAST(CASE s[2] {MONTH_CASE} END AS VARCHAR), 2, '0') || '-' || lpad(s[1], 2, '0') AS DATE) END AS listing_date FROM p""")
def norm_date_tr(spark, sf):
    return raw_listings(spark, sf).select("ad_id", text.turkish_date("date_text").alias("listing_date"))


@query("norm_run_ts", "SELECT ad_id, try_strptime(run_label, '%Y-%m-%d_%H-%M') AS search_ts FROM raw_listings")
def norm_run_ts(spark, sf):
    return raw_listings(spark, sf).select("ad_id", text.run_timestamp("run_label").alias("search_ts"))


@query("norm_first_int", "SELECT ad_id, TRY_CAST(nullif(regexp_extract(ad_text, '([0-9]+)', 1), '') AS BIGINT) AS ad_no FROM raw_listings")
def norm_first_int(spark, sf):
    return raw_listings(spark, sf).select("ad_id", text.first_integer("ad_text").alias("ad_no"))


@query("norm_iso_ts", "SELECT ad_id, TRY_CAST(scraped_text AS TIMESTAMP) AS scraped_at FROM raw_listings")
def norm_iso_ts(spark, sf):
    return raw_listings(spark, sf).select("ad_id", text.iso_timestamp("scraped_text").alias("scraped_at"))


@query("flag_equals", "SELECT ad_id, coalesce(trade_text = 'Evet', false) AS trade_available FROM raw_listings")
def flag_equals(spark, sf):
    return raw_listings(spark, sf).select("ad_id", text.equals("trade_text", "Evet").alias("trade_available"))


@query("flag_contains", "SELECT ad_id, coalesce(contains(lower(trade_text), 'hay'), false) AS refused FROM raw_listings")
def flag_contains(spark, sf):
    return raw_listings(spark, sf).select("ad_id", text.contains_any("trade_text", ("hay",)).alias("refused"))


@query("page_heavy_flag", "SELECT ad_id, coalesce(contains(lower(note_text), 'ağır hasar') OR contains(lower(note_text), 'agir hasar'), false) AS is_heavy FROM raw_listings")
def page_heavy_flag(spark, sf):
    return raw_listings(spark, sf).select("ad_id", text.contains_any("note_text", text.HEAVY_PHRASES).alias("is_heavy"))


@query("page_fee_digits", "SELECT ad_id, TRY_CAST(nullif(regexp_replace(price_text, '[^0-9]', '', 'g'), '') AS BIGINT) AS fee FROM raw_listings")
def page_fee_digits(spark, sf):
    return raw_listings(spark, sf).select("ad_id", text.all_digits("price_text").alias("fee"))


@query("default_on_missing", "SELECT ad_id, coalesce(changed_count, 0) AS changed_count FROM raw_listings")
def default_on_missing(spark, sf):
    return raw_listings(spark, sf).select("ad_id", text.or_zero("changed_count").alias("changed_count"))


def _damage_sql() -> str:
    t, out = "coalesce(lower(damage_text), '')", []
    for part, name in text.PART_NAMES.items():
        deg = f"(contains({t}, '{name}: değişen') OR contains({t}, '{name}: değişmiş'))"
        lok = f"(contains({t}, '{name}: lokal') AND NOT {deg})"
        out += [f"CAST({deg} AS INT) AS {part}_degisen", f"CAST({lok} AS INT) AS {part}_lokal", f"CAST((contains({t}, '{name}: boyalı') AND NOT {deg} AND NOT {lok}) AS INT) AS {part}_boyali"]
    return f"SELECT ad_id, {', '.join(out)} FROM raw_listings"


@query("damage_flags", _damage_sql())
def damage_flags(spark, sf):
    return raw_listings(spark, sf).select("ad_id", *text.damage_flags("damage_text"))


def _same(c):
    return F.col(c)


_NUMBER = "TRY_CAST(nullif(replace(regexp_replace({c}, '[^0-9,]', '', 'g'), ',', '.'), '') AS DOUBLE)"
#: The typed listing table: for each column its raw column, the expression, and the same in SQL.
SILVER = {
    "ad_id": ("ad_text", text.first_integer, "TRY_CAST(nullif(regexp_extract(ad_text, '([0-9]+)', 1), '') AS BIGINT)"),
    "listing_date": ("date_text", text.turkish_date, f"(SELECT CASE WHEN len(s) = 3 THEN TRY_CAST(s[3] || '-' || lpad(CAST(CASE s[2] {MONTH_CASE} END AS VARCHAR), 2, '0') || '-' || lpad(s[1], 2, '0') AS DATE) END FROM (SELECT string_split(trim(date_text), ' ') AS s))"),
    "price": ("price_text", text.number, _NUMBER.format(c="price_text")),
    **{n: (f"raw_{n}", _same, f"raw_{n}") for n in source.TEXT_LABELS},
    **{n: (f"raw_{n}", text.number, _NUMBER.format(c=f"raw_{n}")) for n in source.NUMBER_LABELS},
    **{n: (f"raw_{n}", text.or_zero, f"coalesce(raw_{n}, 0)") for n in source.COUNT_LABELS},
    "count_changed": ("changed_count", text.or_zero, "coalesce(changed_count, 0)"),
    "kb_is_heavy_damaged": ("raw_kb_is_heavy_damaged", lambda c: text.equals(c, "Evet"), "coalesce(raw_kb_is_heavy_damaged = 'Evet', false)"),
    "kb_trade_available": ("raw_kb_trade_available", lambda c: text.equals(c, "Takasa Uygun"), "coalesce(raw_kb_trade_available = 'Takasa Uygun', false)"),
    "gb_is_first_owner": ("raw_gb_is_first_owner", lambda c: F.coalesce(F.contains(c, F.lit("İlk Sahibi")), F.lit(False)), "coalesce(contains(raw_gb_is_first_owner, 'İlk Sahibi'), false)"),
    "is_heavy_damaged": ("note_text", lambda c: text.contains_any(c, text.HEAVY_PHRASES), "coalesce(contains(lower(note_text), 'ağır hasar') OR contains(lower(note_text), 'agir hasar'), false)"),
    "scraped_at": ("scraped_text", text.iso_timestamp, "TRY_CAST(scraped_text AS TIMESTAMP)"),
    "search_date": ("run_label", lambda c: text.run_timestamp(c).cast("date"), "CAST(try_strptime(run_label, '%Y-%m-%d_%H-%M') AS DATE)"),
}
#: Raw columns that give four columns each: least, largest, middle, and whether there is a range.
RANGES = {"engine_cc": "raw_engine_cc", "power_hp": "power_text"}


def _silver_sql() -> str:
    runs = ", ".join(f"list_transform(regexp_extract_all(replace({c}, '.', ''), '[0-9]+'), lambda x: CAST(x AS DOUBLE)) AS {n}_runs" for n, c in RANGES.items())
    four = [e for n in RANGES for e in (f"list_min({n}_runs) AS {n}_low", f"list_max({n}_runs) AS {n}_up", f"(list_min({n}_runs) + list_max({n}_runs)) / 2 AS {n}_val", f"coalesce(len({n}_runs) > 1, false) AS {n}_is_range")]
    flags = _damage_sql().removeprefix("SELECT ad_id, ").removesuffix(" FROM raw_listings")
    return f"SELECT {', '.join([*(f'{e} AS {n}' for n, (_, _, e) in SILVER.items()), *four])}, {flags} FROM (SELECT *, {runs} FROM raw_listings)"


def _apart(df, name):
    """The same rows, counted: a node that keeps the projections on either side from being merged into one too large to compile."""
    return df.observe(name, F.count(F.lit(1)).alias("n"))


@query("rename_project", _silver_sql())
def rename_project(spark, sf):
    """All columns of the typed listing table, in three projections."""
    ranges = {n: text.range4(c) for n, c in RANGES.items()}
    four = [r[a].alias(f"{n}_{b}") for n, r in ranges.items() for a, b in (("low", "low"), ("up", "up"), ("mid", "val"), ("is_range", "is_range"))]
    used = sorted({c for c, _, _ in SILVER.values()} | set(RANGES.values()) | {"damage_text"})
    raw = _apart(raw_listings(spark, sf).select(*used), "raw")
    first = [n for n in SILVER if n not in source.NUMBER_LABELS]
    later = [c for n, (c, _, _) in SILVER.items() if n in source.NUMBER_LABELS]
    typed = _apart(raw.select(*(SILVER[n][1](SILVER[n][0]).alias(n) for n in first), *four, *later, "damage_text"), "typed")
    typed = _apart(typed.select(*(c for c in typed.columns if c not in later), *(SILVER[n][1](SILVER[n][0]).alias(n) for n in source.NUMBER_LABELS)), "numbers")
    return typed.select(*(c for c in typed.columns if c != "damage_text"), *text.damage_flags("damage_text"))


@query("derive_const_minus", "SELECT ad_id, 2026 - gb_year AS vehicle_age FROM listings")
def derive_const_minus(spark, sf, ref_year: int = 2026):
    return listings(spark, sf).select("ad_id", (F.lit(ref_year) - F.col("gb_year")).alias("vehicle_age"))


@query("rescale_column", "SELECT ad_id, engine_cc_val / 10 AS engine_cc_val FROM listings")
def rescale_column(spark, sf):
    return listings(spark, sf).select("ad_id", (F.col("engine_cc_val") / 10).alias("engine_cc_val"))


def downcast(df, keep=()):
    """double to float, bigint to int, boolean to int."""
    to = {"double": "float", "bigint": "int", "boolean": "int"}
    return df.select(*(F.col(c).cast(to[t]) if t in to and c not in keep else F.col(c) for c, t in df.dtypes))


@query("downcast", "SELECT ad_id, CAST(engine_cc_val AS FLOAT) AS engine_cc_val, CAST(part_id AS INT) AS part_id, CAST(kb_fuel = 'Dizel' AS INT) AS diesel FROM listings")
def downcast_query(spark, sf):
    return downcast(listings(spark, sf).select("ad_id", "engine_cc_val", "part_id", (F.col("kb_fuel") == "Dizel").alias("diesel")), keep=("ad_id",))


def drop_existing(df, names=(), substrings=()):
    """Drops the named columns that exist, and those whose names hold one of the substrings."""
    return df.drop(*(c for c in df.columns if c in names or any(s in c for s in substrings)))


@query("drop_existing", "SELECT ad_id, brand, price, kb_year FROM listings")
def drop_existing_query(spark, sf):
    df = listings(spark, sf).select("ad_id", "brand", "price", "kb_year", "series", *(f"{p}_{s}" for p in PARTS for s in STATES))
    return drop_existing(df, ("series", "no_such_column"), ("tavan_", "kaput_", "bagaj_", "door_", "fender_"))


def select_by_type(df, numeric: bool = True, exclude=()):
    """The numeric columns, or the others, without those excluded; by schema, without a job."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return df.select(*(c for c, t in df.dtypes if (t in kinds or t.startswith("decimal")) == numeric and c not in exclude))


@query("select_by_type", "SELECT kb_fuel, gb_fuel, gb_segment, brand, series, model, body_type FROM listings")
def select_by_type_query(spark, sf):
    return select_by_type(listings(spark, sf), numeric=False, exclude=("listing_date",))


@query("log_target", "SELECT ad_id, round(ln(1 + price), 6) AS log_price, round(exp(ln(1 + price)) - 1, 4) AS price_again FROM listings")
def log_target(spark, sf):
    log = F.log1p("price")
    return listings(spark, sf).select("ad_id", F.round(log, 6).alias("log_price"), F.round(F.expm1(log), 4).alias("price_again"))


@query("coalesce_pairs", "SELECT ad_id, coalesce(kb_year, gb_year) AS year, coalesce(kb_mileage, gb_mileage) AS mileage, coalesce(kb_fuel, gb_fuel) AS fuel FROM listings")
def coalesce_pairs_query(spark, sf):
    df = listings(spark, sf).select("ad_id", "kb_year", "gb_year", "kb_mileage", "gb_mileage", "kb_fuel", "gb_fuel")
    return coalesce_pairs(df, {"year": ("kb_year", "gb_year"), "mileage": ("kb_mileage", "gb_mileage"), "fuel": ("kb_fuel", "gb_fuel")})


def coalesce_pairs(df, pairs: dict[str, tuple[str, str]]):
    """Each fact from its first source, else its second; the sources go."""
    gone = {c for p in pairs.values() for c in p}
    return df.select(*(c for c in df.columns if c not in gone), *(F.coalesce(*p).alias(n) for n, p in pairs.items()))


_BODY = " ".join(f"WHEN regexp_matches(t, '{'|'.join(ws)}') THEN '{n}'" for n, ws in scores.BODY_WORDS)


@query("keyword_category", f"""
    WITH x AS (SELECT ad_id, body_type, lower(concat_ws(' ', coalesce(series, ''), coalesce(brand, ''), coalesce(model, ''))) AS t FROM listings)
    SELECT ad_id, CASE WHEN body_type IS NOT NULL AND body_type NOT IN ('nan', 'None', '', '-') THEN body_type {_BODY} ELSE 'Sedan' END AS body_type FROM x""")
def keyword_category(spark, sf):
    return listings(spark, sf).select("ad_id", scores.keyword_category(F.col("body_type"), F.col("series"), F.col("brand"), F.col("model")).alias("body_type"))


def _pieces_sql() -> str:
    return " + ".join(f"{w} * {g}_{side}_{s}" for g in ("door", "fender") for side in scores.SIDES for s, w in zip(scores.STATES, scores.WEIGHTS[g]))


@query("risk_score_ladder", "SELECT ad_id, " + " + ".join("CASE " + " ".join(f"WHEN {p}_{s} = 1 THEN {w}" for s, w in zip(scores.STATES, scores.WEIGHTS[p])) + " ELSE 0 END" for p in scores.SINGLE) + f" + {_pieces_sql()} AS expert_risk_score FROM listings")
def risk_score_ladder(spark, sf):
    return listings(spark, sf).select("ad_id", scores.risk_ladder().alias("expert_risk_score"))


@query("risk_score_linear", "SELECT ad_id, " + " + ".join(f"{w} * {p}_{s}" for p in scores.SINGLE for s, w in zip(scores.STATES, scores.WEIGHTS[p])) + f" + {_pieces_sql()} AS damage_score FROM listings")
def risk_score_linear(spark, sf):
    return listings(spark, sf).select("ad_id", scores.risk_linear().alias("damage_score"))


def _status(p):
    return F.when(F.col(f"{p}_degisen") == 1, "Değişen").when(F.col(f"{p}_boyali") == 1, "Boyalı").when(F.col(f"{p}_lokal") == 1, "Lokal").otherwise("Orjinal")


@query("risk_score_status", """
    SELECT ad_id, CAST(150 * tavan_degisen + 75 * tavan_boyali + 60 * kaput_degisen + 30 * kaput_boyali + 40 * bagaj_degisen + 20 * bagaj_boyali
           + 10 * (part_id % 5) + 5 * (seller_id % 5) + 2 * (part_id % 3) + 8 * (seller_id % 3) + 4 * (part_id % 2) + 2 * (seller_id % 2) AS DOUBLE) AS risk FROM listings""")
def risk_score_status(spark, sf):
    part, seller = F.col("part_id"), F.col("seller_id")
    score = scores.risk_status(_status("tavan"), _status("kaput"), _status("bagaj"), [part % 5, seller % 5, part % 3], [seller % 3, part % 2, seller % 2])
    return listings(spark, sf).select("ad_id", score.cast("double").alias("risk"))


@query("boundary_value", """
    WITH r AS (SELECT ad_id, CASE WHEN ad_id % 3 = 0 THEN NULL ELSE engine_cc_val END AS low, CASE WHEN ad_id % 7 = 0 THEN NULL ELSE engine_cc_val + 50 END AS up FROM listings)
    SELECT ad_id, (coalesce(low, 0) + coalesce(up, 0)) / nullif(CAST(low IS NOT NULL AS INT) + CAST(up IS NOT NULL AS INT), 0) AS mean_value, up AS upper_value FROM r""")
def boundary_value(spark, sf):
    low, up = F.when(F.col("ad_id") % 3 != 0, F.col("engine_cc_val")), F.when(F.col("ad_id") % 7 != 0, F.col("engine_cc_val") + 50)
    rows = listings(spark, sf).select("ad_id", low.alias("low"), up.alias("up"))
    return rows.select("ad_id", mean_skipping_nulls("low", "up").alias("mean_value"), F.col("up").alias("upper_value"))


def mean_skipping_nulls(*names):
    """Mean of the columns that aren't null; null if all are."""
    total, n = F.lit(0.0), F.lit(0)
    for c in names:
        total, n = total + F.coalesce(F.col(c), F.lit(0)), n + F.col(c).isNotNull().cast("int")
    return total / F.nullif(n, F.lit(0))


@query("interval_adjust", """
    SELECT ad_id, CAST(trunc(price) AS BIGINT) AS price, CAST(trunc(price * 0.9 * 0.98) AS BIGINT) AS min, CAST(trunc(price * 1.1 * 1.02) AS BIGINT) AS max,
           round_even((price * 1.1 * 1.02 - price * 0.9 * 0.98) / 2 / price * 100, 1) AS margin_percent FROM listings WHERE price > 0""")
def interval_adjust(spark, sf):
    p = F.col("price")
    return listings(spark, sf).where("price > 0").select("ad_id", *scores.interval(p * 0.9, p, p * 1.1))


@query("agg_two_part_sums", "SELECT ad_id, " + " + ".join(f"door_{x}_degisen" for x in scores.SIDES) + " AS doors_changed, " + " + ".join(f"fender_{x}_boyali" for x in scores.SIDES) + " AS fenders_painted FROM listings")
def agg_two_part_sums(spark, sf):
    df = listings(spark, sf)
    return df.select("ad_id", sum_matching(df, "door_", "_degisen").alias("doors_changed"), sum_matching(df, "fender_", "_boyali").alias("fenders_painted"))


def sum_matching(df, prefix: str, suffix: str):
    """Row-wise sum of the columns whose names begin and end so; nulls count 0."""
    out = F.lit(0)
    for c in df.columns:
        if c.startswith(prefix) and c.endswith(suffix):
            out = out + F.coalesce(F.col(c), F.lit(0))
    return out
