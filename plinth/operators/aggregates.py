"""Grouped and global aggregates of a dashboard, by column name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.session import checkpointed


def kpi(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.avg(value), F.lit(0.0)).alias("avg_price"))


def arrays_by_group(df: DataFrame, key: str, *values: str, size: int = 10_000) -> DataFrame:
    """``key, chunk, points``: the sorted values (or tuples) of each key in arrays of at most ``size``; rows with a null among them are left out.

    Places come from running counts of distinct values, so no task holds a key's rows.
    """
    item = F.col(values[0]) if len(values) == 1 else F.array(*(F.col(v).cast("double") for v in values))
    n = df.dropna(subset=[key, *values]).select(key, item.alias("_v")).groupBy(key, "_v").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(n, [key], "_v", ["n"])
    first, last = F.col("n_upto") - F.col("n"), F.col("n_upto") - 1
    # a value's copies fall into consecutive chunks
    whole = F.lit(size)
    parts = ranked.select(key, "_v", first.alias("_a"), last.alias("_b"), F.explode(F.sequence(F.floor(first / whole), F.floor(last / whole))).alias("chunk"))
    copies = F.least("_b", (F.col("chunk") + 1) * size - 1) - F.greatest("_a", F.col("chunk") * size) + 1
    parts = parts.select(key, "chunk", "_v", copies.cast("int").alias("_n")).groupBy(key, "chunk").agg(F.sort_array(F.collect_list(F.struct("_v", "_n"))).alias("p"))
    return parts.select(key, F.col("chunk").cast("long").alias("chunk"), F.flatten(F.transform("p", lambda s: F.array_repeat(s["_v"], s["_n"]))).alias("points"))


def exact_quantiles(df: DataFrame, keys, value: str, shares) -> DataFrame:
    """``keys, q``: for each group the interpolated quantiles of the non-null values, exactly.

    From running counts of distinct values dealt by range, so no task holds a group's values; a group without values is left out.
    """
    keys = list(keys)
    n = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("n"))
    return counted_quantiles(n, keys, shares)


def counted_quantiles(counts: DataFrame, keys, shares) -> DataFrame:
    """``exact_quantiles`` of distinct values ``_v`` that come with their counts ``n``."""
    keys = list(keys)
    ranked = running_totals(counts, keys, "_v", ["n"])
    at = [(F.col("n_all") - 1) * F.lit(float(p)) for p in shares]
    ends = [F.min(F.when(F.col("n_upto") > f(h), F.col("_v"))).alias(f"_{name}{k}") for k, h in enumerate(at) for name, f in (("lo", F.floor), ("hi", F.ceil))]
    out = ranked.groupBy(*keys).agg(F.first("n_all").alias("n_all"), *ends)
    q = [F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * (h - F.floor(h)) for k, h in enumerate(at)]
    return out.select(*keys, F.array(*q).alias("q"))


def as_map(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias(name))


def boxplot(df: DataFrame, key: str, value: str) -> DataFrame:
    return exact_quantiles(df.dropna(subset=[key, value]), [key], value, (0.0, 0.25, 0.5, 0.75, 1.0)).select(key, *(F.round(F.col("q")[k], 4).alias(n) for k, n in enumerate(("low", "q1", "median", "q3", "high"))))


def aligned_averages(df: DataFrame, key: str, value: str) -> DataFrame:
    """Two arrays: keys ascending, and the average of the value for each."""
    means = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.round(F.avg(value), 4).alias("m"))
    pairs = means.agg(F.sort_array(F.collect_list(F.struct(key, "m"))).alias("p"))
    return pairs.select(F.col(f"p.{key}").alias("keys"), F.col("p.m").alias("averages"))


def value_counts(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))


def top_frequent(df: DataFrame, key: str, k: int, name: str = "n") -> DataFrame:
    return value_counts(df, key, name).orderBy(F.desc(name), key).limit(k)


def named_counts(df: DataFrame, key: str) -> DataFrame:
    return value_counts(df, key).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("name"), F.col("n").alias("value")))).alias("items")).select(F.col("items.name").alias("names"), F.col("items.value").alias("values"))


def averages_by(df: DataFrame, key: str, values, places: int = 4) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.round(F.avg(v), places).alias(v) for v in values))


def axis_limits(df: DataFrame, key: str, values, most_keys: int = 5, factor: float = 1.1) -> DataFrame:
    """The largest of each value times a factor; null if there are more keys than a chart can show."""
    shown = F.count_distinct(F.col(key)) <= most_keys
    return df.agg(F.count_distinct(F.col(key)).alias("n_keys"), *(F.when(shown, F.round(F.max(v) * factor, 4)).alias(f"max_{v}") for v in values))


def part_sums(df: DataFrame, parts: dict[str, tuple[str, ...]]) -> DataFrame:
    """``part, value``: for each part the sum of its columns over all rows, in one pass."""
    total = lambda cs: sum((F.coalesce(F.col(c), F.lit(0)) for c in cs[1:]), F.coalesce(F.col(cs[0]), F.lit(0)))
    one = df.agg(*(F.sum(total(cs)).alias(p) for p, cs in parts.items()))
    return one.unpivot([], list(parts), "part", "value")


def distinct_sorted(df: DataFrame, *columns: str) -> DataFrame:
    """Sorted distinct non-null values of each column, as arrays."""
    return df.agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in columns))


def mode_by_group(df: DataFrame, keys, value: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each group, the least of ties; null if all are null; rows with null keys are left out."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.mode(value, True).alias(name))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts in long form, rows with nulls left out."""
    return df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def pivot_counts(df: DataFrame, key: str, by: str, values) -> DataFrame:
    """Counts of the named values as columns, 0 where there are none."""
    return df.where(F.col(by).isin(*values)).groupBy(key).pivot(by, list(values)).count().fillna(0)


def running_totals(df: DataFrame, groups, value: str, counts) -> DataFrame:
    """Adds ``<c>_upto`` and ``<c>_all`` for each count, and ``next_value``, to rows with distinct values in each group.

    Rows are dealt by ranges of (group, value), summed within a range, and
    moved by the totals of the ranges before, so that a group of any size is
    spread over many tasks.
    """
    groups = list(groups)
    dealt = checkpointed(df.repartitionByRange(*groups, value).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(*groups, "_part").agg(F.min(value).alias("_first"), *(F.sum(c).alias(f"_s_{c}") for c in counts))
    over = Window.partitionBy(*groups).orderBy("_part")
    before, whole = over.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*groups)
    parts = parts.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_part").alias("_p"), F.lead("_first").over(over).alias("_next"), *(F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in counts), *(F.sum(f"_s_{c}").over(whole).alias(f"{c}_all") for c in counts))
    on = [F.col("_part") == F.col("_p"), *(F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups))]
    own = Window.partitionBy(*groups, "_part").orderBy(value)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(parts, on).select(*df.columns, *((F.sum(c).over(upto) + F.col(f"_before_{c}")).alias(f"{c}_upto") for c in counts), *(f"{c}_all" for c in counts), F.coalesce(F.lead(value).over(own), F.col("_next")).alias("next_value"))


def with_neighbours(df: DataFrame, groups, value: str, columns, k: int, name: str = "near") -> DataFrame:
    """Adds an array of structs of ``columns``: the row's own, the up to k before it and the up to k after it in its group, by ``value``, which must be distinct there.

    Rows are dealt by ranges of (group, value) and sorted within a range; each range of a group also gets a halo of the k rows
    on either side, from the ends of the k ranges next to it, so that a group of any size is spread over many tasks.
    """
    groups, item = list(groups), F.struct(*columns)
    dealt = checkpointed(df.repartitionByRange(*groups, value).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*groups, "_part").orderBy(value)
    ends = dealt.select(*groups, "_part", F.struct(value, item.alias("item")).alias("_e"), F.row_number().over(inside).alias("_up"), F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(F.desc(value))).alias("_down"))
    side = lambda c: F.sort_array(F.collect_list(F.when(F.col(c) <= k, F.col("_e"))))  # noqa: E731  at most k of a range
    ends = ends.where((F.col("_up") <= k) | (F.col("_down") <= k)).groupBy(*groups, "_part").agg(side("_up").alias("_first"), side("_down").alias("_last"))
    parts = Window.partitionBy(*groups).orderBy("_part")  # a row for each range of a group; each has a row at least, so k of them have the k nearest
    before = F.slice(F.reverse(F.flatten(F.collect_list("_last").over(parts.rowsBetween(-k, -1)))), 1, k)
    after = F.slice(F.flatten(F.collect_list("_first").over(parts.rowsBetween(1, k))), 1, k)
    halo = ends.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_part").alias("_p"), before.alias("_before"), after.alias("_after"))
    on = [F.col("_part") == F.col("_p"), *(F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups))]
    below, above = (F.collect_list(item).over(inside.rowsBetween(*ends_)) for ends_ in ((-k, -1), (1, k)))
    here = dealt.withColumn("_below", below).withColumn("_above", above).join(halo, on)
    left = F.slice(F.concat(F.reverse("_below"), F.col("_before.item")), 1, k)
    right = F.slice(F.concat("_above", F.col("_after.item")), 1, k)
    return here.select(*df.columns, F.concat(left, F.array(item), right).alias(name))


def ecdf_columns(df: DataFrame, feature: str, value: str, counts) -> DataFrame:
    """Adds to distinct (feature, value) rows with counts the cumulative share of each count, and the next value."""
    t = running_totals(df, [feature], value, counts)
    return t.select(*df.columns, *((F.col(f"{c}_upto") / F.col(f"{c}_all")).alias(f"{c}_share") for c in counts), "next_value")


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))
