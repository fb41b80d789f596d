"""Splits, folds, encoders and scalers whose outcome doesn't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.session import broadcast_if_small, checkpointed


def hashed(key: str, seed: int, parts: int) -> Column:
    """A number below ``parts`` from the first 32 bits of the key's MD5, which other engines make alike."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % parts).cast("int")


def hashed_sql(key: str, seed: int, parts: int) -> str:
    return f"CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST({key} AS VARCHAR), '')), 1, 8) AS BIGINT) % {parts} AS INTEGER)"


def holdout(df: DataFrame, key: str, train_percent: int = 80, seed: int = 42, name: str = "is_train") -> DataFrame:
    return df.withColumn(name, hashed(key, seed, 100) < train_percent)


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    return df.withColumn(name, hashed(key, seed, k))


def target_encoded(df: DataFrame, column: str, target: str, fold: str, name: str) -> DataFrame:
    """Category means of the target shrunk to the global mean, from the other folds only.

    The weight of a category is n t / (s + n t), with t the variance of the
    target and s that within the category; a category the other folds don't
    have gets their global mean.
    """
    y = F.col(target)
    per = df.where(y.isNotNull()).groupBy(column, fold).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    per = checkpointed(per)  # a row for each category and fold
    whole = per.where(F.col(fold).isNotNull()).groupBy(F.col(column).alias("_c")).agg(*(F.sum(c).alias(f"{c}_all") for c in "nsq"))
    by_fold = per.groupBy(fold).agg(*(F.sum(c).alias(f"{c}_fold") for c in "nsq"))
    every = per.agg(*(F.sum(c).alias(f"{c}_total") for c in "nsq"))
    by_fold = by_fold.crossJoin(F.broadcast(every)).select(F.col(fold).alias("_f"), *((F.col(f"{c}_total") - F.col(f"{c}_fold")).alias(f"g_{c}") for c in "nsq"))
    # the value of each category in each fold, from their sums; rows only look it up
    cells = df.select(F.col(column).alias("_c"), F.col(fold).alias("_f")).distinct().join(per.select(F.col(column).alias("_pc"), F.col(fold).alias("_pf"), *(F.col(c) for c in "nsq")), F.col("_c").eqNullSafe(F.col("_pc")) & F.col("_f").eqNullSafe(F.col("_pf")), "left").drop("_pc", "_pf")
    cells = cells.join(whole.withColumnRenamed("_c", "_wc"), F.col("_c").eqNullSafe(F.col("_wc")), "left").drop("_wc").join(by_fold.withColumnRenamed("_f", "_bf"), F.col("_f") == F.col("_bf"), "left").drop("_bf")
    rest = {c: F.coalesce(F.col(f"{c}_all"), F.lit(0)) - F.coalesce(F.col(c), F.lit(0)) for c in "nsq"}
    g_mean = F.col("g_s") / F.col("g_n")
    tau = F.col("g_q") / F.col("g_n") - g_mean * g_mean
    mean = rest["s"] / F.nullif(rest["n"], F.lit(0))
    within = F.greatest(F.lit(0.0), rest["q"] / F.nullif(rest["n"], F.lit(0)) - mean * mean)
    weight = rest["n"] * tau / F.nullif(within + rest["n"] * tau, F.lit(0.0))
    value = F.when(rest["n"] > 0, F.coalesce(weight, F.lit(1.0)) * mean + (1 - F.coalesce(weight, F.lit(1.0))) * g_mean).otherwise(g_mean)
    values = broadcast_if_small(checkpointed(cells.select("_c", "_f", value.alias("_value"))))
    out = df.join(values, F.col(column).eqNullSafe(F.col("_c")) & F.col(fold).eqNullSafe(F.col("_f")), "left")
    return out.select(*(df[c] for c in df.columns), F.col("_value").alias(name))


def levels_of(df: DataFrame, column: str, most: int = 1000) -> list:
    """The distinct non-null values of a column; more than ``most`` are an error, as they would all become columns."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return sorted(found)


def one_hot(df: DataFrame, column: str, levels) -> DataFrame:
    """0/1 columns for the levels but the first; unknown and null are all zeros."""
    return df.select("*", *(F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in sorted(levels)[1:]))


def standardized(df: DataFrame, columns, fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation, of ``fit_on`` if given; no deviation divides by 1."""
    s = (fit_on if fit_on is not None else df).agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    z = lambda c: ((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)).alias(c)
    return df.crossJoin(F.broadcast(s)).select(*(z(c) if c in columns else F.col(c) for c in df.columns))


def gram(df: DataFrame, columns) -> DataFrame:
    """``a, b, v``: sums of products of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*(F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"{k}") for k, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{k}`").alias("v")) for k, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")
