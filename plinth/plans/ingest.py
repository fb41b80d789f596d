"""Queries of sources, sinks, page extraction, the crawl frontier and streaming ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.plans.dashboard import FIRST, _lines
from plinth.plans.registry import query
from plinth.session import shared_path
from plinth.sources import io, pages
from plinth.sources.listings import listings, raw_listings, table
from plinth.streaming import ingest

#: Price bands by brand (least, most, step), and the row for any other brand.
BANDS = {"audi": (300000, 6500000, 100000), "bmw": (300000, 6500000, 100000), "mercedes": (800000, 5000000, 300000), "fiat": (200000, 900000, 100000), "ford": (300000, 1500000, 150000), "renault": (300000, 1200000, 100000), "volkswagen": (400000, 2000000, 150000)}
OTHER_BANDS = (200000, 1000000, 200000)


@query("scan_jdbc_day", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE CAST(l_shipdate AS DATE) = DATE '1996-05-05'")
def scan_jdbc_day(spark, sf):
    return io.scan_day(table(spark, sf, "lineitem"), "l_shipdate", "1996-05-05").select("l_orderkey", "l_linenumber", "l_quantity")


@query("scan_keys", "SELECT o_orderkey FROM orders")
def scan_keys(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey")


def _raw_json(spark, sf):
    """Raw records as files of JSON lines in a fresh folder."""
    folder = shared_path(spark, "raw")
    error = F.when(F.col("ad_id") % 29 == 0, "timeout")
    raw_listings(spark, sf).select(F.col("ad_text").alias("ad"), F.col("price_text").alias("price"), "scraped_text", error.alias("error")).write.json(folder)
    return folder


RAW_SCHEMA = "ad string, price string, scraped_text string, error string"


@query("scan_jsonl", "SELECT ad_text AS ad, price_text AS price FROM raw_listings WHERE price_text IS NOT NULL AND price_text <> ''")
def scan_jsonl(spark, sf):
    return io.scan_jsonl(spark, _raw_json(spark, sf), RAW_SCHEMA, "price").select("ad", "price")


@query("quarantine_errors", "SELECT 'error' AS part, count(*) AS n FROM raw_listings WHERE ad_id % 29 = 0 UNION ALL SELECT 'record', count(*) FROM raw_listings WHERE ad_id % 29 <> 0")
def quarantine_errors(spark, sf):
    good, bad = io.split_errors(spark.read.schema(RAW_SCHEMA).json(_raw_json(spark, sf)))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count(bad, "error").unionByName(count(good, "record"))


@query("scan_csv", "SELECT ad_id, brand, gb_year FROM listings")
def scan_csv(spark, sf):
    folder = shared_path(spark, "csv")
    listings(spark, sf).select("ad_id", "brand", "gb_year").write.option("header", True).csv(folder)
    return io.scan_csv(spark, folder, "ad_id bigint, brand string, gb_year int")


@query("sink_append_new", """
    SELECT ad_id, l_shipdate, l_partkey, l_suppkey, l_extendedprice FROM (SELECT l_orderkey * 10 + l_linenumber AS ad_id, l_shipdate, l_partkey, l_suppkey, l_extendedprice,
        row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY l_shipdate >= TIMESTAMP '1998-01-01', l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1""")
def sink_append_new(spark, sf):
    """Two batches, the second of them loaded twice."""
    target, lines = shared_path(spark, "target"), _lines(spark, sf)
    io.append_new(lines.where("l_shipdate < timestamp '1998-01-01'"), target, "ad_id", FIRST)
    for _ in range(2):
        io.append_new(lines.where("l_shipdate >= timestamp '1998-01-01'"), target, "ad_id", FIRST)
    return spark.read.parquet(target)


@query("sink_csv_split", "SELECT gb_year AS version, CASE WHEN ad_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, round(sum(price), 2) AS total FROM listings WHERE price IS NOT NULL GROUP BY ALL")
def sink_csv_split(spark, sf):
    folder = shared_path(spark, "splits")
    df = listings(spark, sf).where("price is not null").select("ad_id", "price", F.col("gb_year").alias("version"), F.when(F.col("ad_id") % 5 == 0, "test").otherwise("train").alias("split"))
    io.write_splits(df, folder, "version", "split")
    back = spark.read.schema("ad_id bigint, price double, version int, split string").option("header", True).csv(folder)
    return back.groupBy("version", "split").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


REGISTRY = "SELECT brand AS version_id, max(listing_date) AS at, count(*) AS train_size FROM listings WHERE {} GROUP BY brand"


@query("upsert_registry", f"WITH a AS ({REGISTRY.format('gb_year < 1998')}), b AS ({REGISTRY.format('gb_year >= 1998 AND ad_id % 3 = 0')}) SELECT * FROM b UNION ALL SELECT * FROM a WHERE version_id NOT IN (SELECT version_id FROM b)")
def upsert_registry(spark, sf):
    versions = lambda df: df.groupBy(F.col("brand").alias("version_id")).agg(F.max("listing_date").alias("at"), F.count(F.lit(1)).alias("train_size"))
    df = listings(spark, sf)
    return io.upsert(versions(df.where("gb_year < 1998")), versions(df.where("gb_year >= 1998 and ad_id % 3 = 0")), "version_id", "at")


@query("enrich_ingest_meta", "SELECT ad_id, 'audi' AS brand, TIMESTAMP '2026-01-18 01:05:00' AS scraped_at, regexp_extract(run_label, '([0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]{2}-[0-9]{2})', 1) AS run_label FROM raw_listings")
def enrich_ingest_meta(spark, sf):
    df = raw_listings(spark, sf).select("ad_id", F.concat(F.lit("data/audi/"), "run_label", F.lit("/details.jsonl")).alias("path"))
    return io.stamped(df, "audi", F.to_timestamp(F.lit("2026-01-18 01:05:00")), F.col("path")).drop("path")


# pages


@query("page_extract_links", """
    WITH a AS (SELECT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1)) AS href FROM pages)
    SELECT DISTINCT CASE WHEN starts_with(href, '/') THEN host || href ELSE href END AS url FROM a""")
def page_extract_links(spark, sf):
    return pages.links(table(spark, sf, "pages"))


def listing_pages(spark, sf):
    """Listing pages made from the raw texts."""
    cell = lambda cls, c, tag="div": F.concat(F.lit(f'<{tag} class="{cls}"> '), F.coalesce(c, F.lit("")), F.lit(f" </{tag}>"))
    item = F.concat(F.lit('<div class="property-item">'), cell("property-key", F.lit("Motor Gücü")), cell("property-value", F.col("power_text")), F.lit("</div>"))
    section = F.concat(F.lit('<div id="tab-car-information"><div class="tab-content-car-information-container"><h3>Genel Bakış</h3><ul><li>'), cell("property-key", F.lit("Takas"), "span"), cell("property-value", F.col("trade_text"), "span"), F.lit("</li></ul></div></div>"))
    by = lambda word: F.filter(F.split("damage_text", "; "), lambda x: F.endswith(x, F.lit(word)))
    block = lambda word: F.concat(F.lit(f'<div class="car-damage-info-item"><p>{word}</p><ul><li>-</li>'), F.concat_ws("", F.transform(by(f": {word}"), lambda x: F.concat(F.lit("<li>"), F.substring_index(x, ":", 1), F.lit("</li>")))), F.lit("</ul></div>"))
    damage = F.concat(F.lit('<div class="car-damage-info">'), block("Değişmiş"), block("Lokal Boyalı"), block("Boyalı"), F.lit("</div>"))
    fee = F.concat(F.lit('<div class="tramer-info"><p>'), "note_text", F.lit("</p>"), cell("property-value", F.col("price_text"), "span"), F.lit("</div>"))
    page = F.concat(F.lit("<html><body>"), cell("desktop-information-price x", F.col("price_text")), cell("product-name-container", F.col("ad_text")), F.lit('<div class="product-location"><span>A</span> <span>'), F.coalesce("date_text", F.lit("")), F.lit("</span></div>"), F.lit('<div class="product-properties-details">'), item, F.lit("</div>"), section, F.lit('<div id="tab-description"><p>Temiz &amp; az <b>km</b></p></div>'), fee, damage, F.lit("</body></html>"))
    # the rows are few bytes and their pages take long to parse, so they are dealt evenly first
    return raw_listings(spark, sf).repartition("ad_id").select(F.col("ad_id").alias("page_id"), page.alias("html"))


@query("page_extract_attrs", "SELECT ad_id AS page_id, coalesce(price_text, '') AS price, coalesce(ad_text, '') AS title, date_text AS location, coalesce(power_text, '') AS power, coalesce(trade_text, '') AS trade, '<p>Temiz &amp; az <b>km</b></p>' AS description, note_text AS note FROM raw_listings")
def page_extract_attrs(spark, sf):
    r = pages.extract_records(listing_pages(spark, sf))
    return r.select("page_id", "price", "title", "location", F.col("attributes")["KısaBilgi - Motor Gücü"].alias("power"), F.col("attributes")["Genel Bakış - Takas"].alias("trade"), "description", "note")


_HAS = "len(list_filter(string_split(damage_text, '; '), lambda x: ends_with(x, ': {}')))"


@query("page_damage_parts", f"SELECT ad_id AS page_id, CAST({_HAS.format('Değişmiş')} AS INT) AS count_changed, CAST({_HAS.format('Lokal Boyalı')} AS INT) AS count_local_painted, CAST({_HAS.format('Boyalı')} AS INT) AS count_painted FROM raw_listings")
def page_damage_parts(spark, sf):
    return pages.extract_records(listing_pages(spark, sf)).select("page_id", *pages.damage_counts())


@query("page_text")
def page_text(spark, sf):
    return pages.visible_text(table(spark, sf, "pages"))


# the crawl frontier


def frontier(brands, configs: dict, other, pages_per_band: int = 50):
    """Price bands times pages for each brand; a brand without a row of its own takes the other one."""
    row = F.create_map(*[x for b, r in configs.items() for x in (F.lit(b), F.array(*map(F.lit, r)))])
    bands = brands.select("brand", F.coalesce(F.try_element_at(row, F.col("brand")), F.array(*map(F.lit, other))).alias("c"))
    bands = bands.select("brand", F.col("c")[2].alias("step"), F.explode(F.sequence(F.col("c")[0], F.col("c")[1] - 1, F.col("c")[2])).alias("min_price"))
    return bands.select("brand", "min_price", (F.col("min_price") + F.col("step")).alias("max_price"), F.explode(F.sequence(F.lit(1), F.lit(pages_per_band))).alias("page"))





@query("frontier_bands", "WITH b AS (SELECT DISTINCT lower(c_mktsegment) AS brand FROM customer UNION SELECT 'audi'), c AS (SELECT brand, CASE brand " + " ".join(f"WHEN '{b}' THEN {list(r)}" for b, r in BANDS.items()) + f" ELSE {list(OTHER_BANDS)} END AS c FROM b), " + """
    m AS (SELECT brand, c[3] AS step, unnest(range(c[1], c[2], c[3])) AS min_price FROM c)
    SELECT brand, CAST(min_price AS INT) AS min_price, CAST(min_price + step AS INT) AS max_price, CAST(unnest(range(1, 51)) AS INT) AS page FROM m""")
def frontier_bands(spark, sf):
    brands = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("brand")).union(spark.sql("select 'audi'")).distinct()
    return frontier(brands, BANDS, OTHER_BANDS)


@query("frontier_pending", "SELECT DISTINCT url FROM pages WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0 AND url IS NOT NULL)")
def frontier_pending(spark, sf):
    found = table(spark, sf, "pages").select("url", "page_id").where("url is not null")
    return found.select("url").dropDuplicates(["url"]).join(found.where("page_id % 3 = 0").select("url"), "url", "left_anti")


# streams


EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _event_stream(spark, sf, parts: int = 4):
    """Events as files of a folder, repeated keys among them."""
    folder = shared_path(spark, "events")
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    e.union(e.where("event_id % 10 = 0")).repartition(parts, "event_id").write.json(folder)
    return ingest.file_stream(spark, folder, EVENTS)


@query("stream_ingest", "SELECT event_id, user_id, event_type FROM events UNION ALL SELECT event_id, user_id, event_type FROM events WHERE event_id % 10 = 0")
def stream_ingest(spark, sf):
    target = shared_path(spark, "ingested")
    ingest.run_available(_event_stream(spark, sf), target, shared_path(spark, "state"))
    return spark.read.parquet(target).select("event_id", "user_id", "event_type")


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, sf):
    target = shared_path(spark, "deduplicated")
    ingest.run_available(ingest.deduplicated(_event_stream(spark, sf), "event_id", "ts", "60 days"), target, shared_path(spark, "state"))
    return spark.read.parquet(target).select("event_id", "user_id", "event_type")


@query("stream_insert_only", "SELECT event_id, user_id, event_type FROM events")
def stream_insert_only(spark, sf):
    target = shared_path(spark, "inserted")
    ingest.run_insert_only(_event_stream(spark, sf), target, shared_path(spark, "state"), "event_id", ["ts"])
    return spark.read.parquet(target).select("event_id", "user_id", "event_type")


