"""Scores and categories of listings, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of a part's state (replaced, painted, locally painted).
WEIGHTS = {"tavan": (150, 75, 40), "kaput": (60, 30, 15), "bagaj": (40, 20, 10), "door": (10, 5, 2), "fender": (8, 4, 2)}
STATES = ("degisen", "boyali", "lokal")
SINGLE = ("tavan", "kaput", "bagaj")
SIDES = ("fl", "fr", "rl", "rr")
#: Status texts of a request, in the order of the weights.
STATUS = ("Değişen", "Boyalı", "Lokal Boyalı")
#: Body types by words in title, brand and model; the first that matches counts.
BODY_WORDS = (
    ("Cabrio", ("cabrio", "kabrio", "roadster")), ("Coupe", ("coupe",)), ("Station Wagon", ("station", "sw", "touring")), ("SUV", ("suv", "jeep", "4x4")), ("Hatchback", ("hatchback", "hb")),
)
OTHER_BODY, NO_VALUE = "Sedan", ("nan", "None", "", "-")
#: Ordinal codes of segments.
SEGMENT_CODES = {"A Segment": 1, "B Segment": 2, "C Segment": 3, "D Segment": 4, "E Segment": 5, "F Segment": 6, "G Segment": 7, "H Segment": 8, "K Segment": 9, "J Segment": 9, "S Segment": 10, "M Segment": 10}
OTHER_SEGMENT_CODE, COMMON_SEGMENT = 3, "C Segment"


def _total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _flag(part: str, state: str) -> Column:
    return F.coalesce(F.col(f"{part}_{state}"), F.lit(0))


def pieces(group: str) -> Column:
    """Weighted count of damaged doors or fenders; every piece and state counts."""
    return _total(w * _flag(f"{group}_{side}", s) for side in SIDES for s, w in zip(STATES, WEIGHTS[group]))


def risk_ladder() -> Column:
    """Roof, hood and boot count their worst state only; doors and fenders by piece."""
    def worst(part):
        w = WEIGHTS[part]
        return F.when(_flag(part, STATES[0]) == 1, w[0]).when(_flag(part, STATES[1]) == 1, w[1]).when(_flag(part, STATES[2]) == 1, w[2]).otherwise(0)

    return _total([*map(worst, SINGLE), pieces("door"), pieces("fender")])


def risk_linear() -> Column:
    """Every state of every part counts."""
    return _total([*(w * _flag(p, s) for p in SINGLE for s, w in zip(STATES, WEIGHTS[p])), pieces("door"), pieces("fender")])


def risk_status(roof: Column, hood: Column, boot: Column, doors: list[Column], fenders: list[Column]) -> Column:
    """From status texts and counts by state; a text that isn't one of ``STATUS`` counts nothing."""
    def of(c, part):
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in zip(STATUS, WEIGHTS[part]) for x in pair]), c), F.lit(0))

    counted = [w * F.coalesce(c, F.lit(0)) for group, cs in (("door", doors), ("fender", fenders)) for w, c in zip(WEIGHTS[group], cs)]
    return _total([of(roof, "tavan"), of(hood, "kaput"), of(boot, "bagaj"), *counted])


def keyword_category(value: Column, *texts: Column, rungs=BODY_WORDS, other: str = OTHER_BODY) -> Column:
    """The value unless it is missing; else the first rung with a word in the lower-cased texts."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts)))
    out = F.when(value.isNotNull() & ~value.isin(*NO_VALUE), value)
    for name, words in rungs:
        out = out.when(text.rlike("|".join(words)), F.lit(name))
    return out.otherwise(F.lit(other))


def segment_code(c: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in SEGMENT_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, c), F.lit(OTHER_SEGMENT_CODE))


def interval(low: Column, mid: Column, up: Column, down_factor: float = 0.98, up_factor: float = 1.02) -> list[Column]:
    """Price, widened range and margin (half width in percent of the price), whole units cut off."""
    a, b = low * down_factor, up * up_factor
    return [mid.cast("long").alias("price"), a.cast("long").alias("min"), b.cast("long").alias("max"), F.bround((b - a) / 2 / mid * 100, 1).alias("margin_percent")]


def status_label(a: Column, b: Column, name_a: str, name_b: str, short: tuple[str, str] | None = None, original: str = "Original") -> Column:
    """One label for where the values of two columns came from."""
    is_a, is_b = a.eqNullSafe(original), b.eqNullSafe(original)
    short_a, short_b = short or (name_a, name_b)
    mixed = F.concat(F.lit(f"Mixed ({short_b}:"), b, F.lit(f", {short_a}:"), a, F.lit(")"))
    return F.when(is_a & is_b, F.lit(f"{original} Data")).when(a == b, F.concat(F.lit("Both: "), a)).when(is_a, F.concat(F.lit(f"{name_b}: "), b)).when(is_b, F.concat(F.lit(f"{name_a}: "), a)).otherwise(mixed)
