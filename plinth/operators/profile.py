"""Profiles of columns: missing values, constants, duplicates, distributions.  One pass over the table each."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.aggregates import exact_quantiles


def describe(df: DataFrame, columns, places: int = 4) -> DataFrame:
    """``column`` with count, mean, sample deviation, minimum, quartiles and maximum of each."""
    long = df.select(*(F.col(c).cast("double") for c in columns)).unpivot([], list(columns), "column", "v")
    out = long.groupBy("column").agg(F.count("v").alias("n"), F.round(F.avg("v"), places).alias("mean"), F.round(F.stddev_samp("v"), places).alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))
    out = out.join(F.broadcast(exact_quantiles(long, ["column"], "v", (0.25, 0.5, 0.75))), "column", "left")  # a row for each column
    return out.select("column", "n", "mean", "std", "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")


def missing_profile(df: DataFrame, columns=None, places: int = 4) -> DataFrame:
    """``column, n_missing, percent`` of the columns that miss values."""
    columns = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *(F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias(c) for c in columns))
    long = one.unpivot(["_n"], columns, "column", "n_missing").where("n_missing > 0")
    return long.select("column", "n_missing", F.round(F.col("n_missing") * 100.0 / F.col("_n"), places).alias("percent"))


def missing_groups(profile: DataFrame, places: int = 2, large: float = 20.0) -> DataFrame:
    """Columns that miss the same share; reported if they are several or miss much."""
    groups = profile.groupBy(F.round("percent", places).alias("percent")).agg(F.sort_array(F.collect_list("column")).alias("columns"))
    return groups.where((F.size("columns") > 1) | (F.col("percent") >= large))


def missing_patterns(df: DataFrame, columns) -> DataFrame:
    """How often each combination of missing columns occurs, as a text of 0 and 1."""
    bits = F.concat(*(F.col(c).isNull().cast("int").cast("string") for c in columns))
    return df.select(bits.alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def quasi_constant(df: DataFrame, columns, tolerance: float = 0.99, of_all_rows: bool = True) -> DataFrame:
    """``column, top_share`` of columns whose commonest value has at least that share."""
    long = df.select(*(F.col(c).cast("string") for c in columns)).unpivot([], list(columns), "column", "v")
    n = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n") if of_all_rows else F.sum(F.when(F.col("v").isNotNull(), F.col("n")))
    top = n.groupBy("column").agg((F.max(F.when(F.col("v").isNotNull(), F.col("n"))) / total).alias("top_share"))
    return top.where(F.col("top_share") >= tolerance).select("column", F.round("top_share", 6).alias("top_share"))


def identical_columns(df: DataFrame, columns) -> DataFrame:
    """``a, b``: pairs equal on every row, null equal to null.

    One pass takes fingerprints of the columns; a second counts the differing
    rows of just those pairs whose types and fingerprints agree.
    """
    kinds = dict(df.dtypes)
    row = F.xxhash64(*(F.col(c) for c in columns))
    marks = df.agg(*(F.bit_xor(F.xxhash64(F.col(c).isNull(), F.col(c), row)).alias(c) for c in columns)).first()
    pairs = [(a, b) for a, b in combinations(columns, 2) if kinds[a] == kinds[b] and marks[a] == marks[b]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string")
    differing = df.agg(*(F.sum((~F.col(a).eqNullSafe(F.col(b))).cast("long")).alias(f"{k}") for k, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{k}`").alias("n")) for k, (a, b) in enumerate(pairs)))
    return differing.select(F.explode(rows).alias("p")).where("p.n = 0").select("p.a", "p.b")


def varied(df: DataFrame, columns) -> DataFrame:
    """``column, n_distinct`` of the columns with more than one value."""
    one = df.agg(*(F.count_distinct(F.col(c)).alias(c) for c in columns))
    return one.unpivot([], list(columns), "column", "n_distinct").where("n_distinct > 1")


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """``bin, n``: equal bins from the least to the largest value, the last one closed; empty bins too."""
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    k = F.least(F.width_bucket("v", "lo", "hi", F.lit(bins)), F.lit(bins)).cast("int")
    n = rows.crossJoin(F.broadcast(ends)).groupBy(F.when(F.col("lo") == F.col("hi"), F.lit(1)).otherwise(k).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
