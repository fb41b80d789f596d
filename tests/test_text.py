"""Golden rows of the scalar families."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plinth.functions import scores, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


def test_numbers(spark):
    rows = {"1.620": 1620.0, "11,8": 11.8, "1.620,5 TL": 1620.5, "-": None, "1,2,3": None, "-5": 5.0, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in rows], "c string")
    assert {r.c: r.v for r in df.select("c", text.number("c").alias("v")).collect()} == rows
    assert one(spark, "1 200 TL", text.all_digits) == 1200 and one(spark, "TL", text.all_digits) is None
    assert one(spark, "No: 123-45", text.first_integer) == 123 and one(spark, "x", text.first_integer) is None


def test_ranges(spark):
    rows = {"1598 cc": (1598, 1598, 1598, False), "101 - 125 hp": (101, 125, 113, True), "1301 - 1600 cm3": (3, 1600, 801.5, True), "1.598": (1598, 1598, 1598, False), "": (None, None, None, False), "yok": (None, None, None, False), None: (None, None, None, False)}
    df = spark.createDataFrame([(k,) for k in rows], "c string")
    assert {r.c: tuple(r.v) for r in df.select("c", text.range4("c").alias("v")).collect()} == rows
    assert tuple(one(spark, "1301 - 1600 cm3", lambda c: text.range4(c, strip_units=True))) == (1301, 1600, 1450.5, True)


def test_dates(spark):
    rows = {"26 Kasım 2025": dt.date(2025, 11, 26), " 6  Ocak 2025": dt.date(2025, 1, 6), "31 Şubat 2025": None, "26 kasım 2025": None, "26 Kasım": None, "": None, None: None, "x Ocak 2025": None}
    df = spark.createDataFrame([(k,) for k in rows], "c string")
    assert {r.c: r.v for r in df.select("c", text.turkish_date("c").alias("v")).collect()} == rows
    assert one(spark, "2026-01-18_01-05", text.run_timestamp) == dt.datetime(2026, 1, 18, 1, 5) and one(spark, "", text.run_timestamp) is None
    assert one(spark, "bad", text.iso_timestamp) is None


@pytest.mark.parametrize("entries,want", [("Tavan: Boyalı", {"tavan_boyali"}), ("Tavan: Lokal Boyalı", {"tavan_lokal"}), ("Tavan: Değişmiş; Tavan: Boyalı", {"tavan_degisen"}), ("Sağ Ön Kapı: Değişen", {"door_fr_degisen"}), ("", set()), (None, set())])
def test_damage_flags(spark, entries, want):
    row = spark.createDataFrame([(entries,)], "c string").select(*text.damage_flags("c")).first().asDict()
    assert len(row) == 33 and {k for k, v in row.items() if v} == want


def test_turkish_lower_case(spark):
    assert one(spark, "DEĞİŞMİŞ", lambda c: text.contains_any(c, ["değişmiş"])) is False
    assert one(spark, "DEĞİŞMİŞ", lambda c: text.contains_any(c, ["değişmiş"], locale="tr")) is True


@pytest.mark.parametrize("value,title,want", [("Sedan", "Coupe", "Sedan"), ("-", "320i Touring", "Station Wagon"), (None, "Coupe Cabrio", "Cabrio"), ("", "no word", "Sedan"), ("nan", "4x4", "SUV"), ("None", None, "Sedan")])
def test_keyword_category(spark, value, title, want):
    df = spark.createDataFrame([(value, title)], "v string, t string")
    assert df.select(scores.keyword_category(F.col("v"), F.col("t")).alias("r")).first().r == want


def _damage(spark, **on):
    names = [f"{p}_{s}" for p in (*scores.SINGLE, *(f"{g}_{x}" for g in ("door", "fender") for x in scores.SIDES)) for s in scores.STATES]
    return spark.createDataFrame([tuple(on.get(n, 0) for n in names)], ", ".join(f"{n} int" for n in names))


def test_risk_scores(spark):
    both = lambda **on: tuple(_damage(spark, **on).select(scores.risk_ladder(), scores.risk_linear()).first())
    assert both(tavan_degisen=1) == (150, 150)
    assert both(tavan_degisen=1, tavan_boyali=1) == (150, 225)
    assert both(door_fl_boyali=1, door_rr_boyali=1, fender_fl_lokal=1) == (12, 12)
    df = spark.range(1)
    status = lambda s: df.select(scores.risk_status(F.lit(s), F.lit(None), F.lit("Orjinal"), [F.lit(1)] * 3, [F.lit(0)] * 3).alias("r")).first().r
    assert status("Değişen") == 167 and status("Lokal") == 17


def test_segment_codes_and_labels(spark):
    df = spark.createDataFrame([("A Segment",), ("K Segment",), ("X Segment",), (None,)], "c string")
    assert [r[0] for r in df.select(scores.segment_code(F.col("c"))).collect()] == [1, 9, 3, 3]
    label = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(scores.status_label(F.col("a"), F.col("b"), "Torque", "HP", ("Tq", "HP")).alias("r")).first().r
    assert [label("Original", "Original"), label("m", "m"), label("Original", "m"), label("m", "Original"), label("m", "n")] == ["Original Data", "Both: m", "HP: m", "Torque: m", "Mixed (HP:n, Tq:m)"]
