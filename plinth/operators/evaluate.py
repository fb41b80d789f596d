"""Measures of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regression(df: DataFrame, y: str, prediction: str) -> DataFrame:
    e = F.col(y) - F.col(prediction)
    one = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("v"))
    return one.select(F.round("mse", 2).alias("mse"), F.round(F.sqrt("mse"), 2).alias("rmse"), F.round("mae", 2).alias("mae"), F.round(1 - F.col("mse") / F.col("v"), 4).alias("r2"))


def mape(df: DataFrame, y: str, prediction: str, places: int = 4) -> DataFrame:
    return df.agg(F.round(F.avg(F.abs((F.col(y) - F.col(prediction)) / F.nullif(F.col(y), F.lit(0.0)))) * 100, places).alias("mape"))


def coverage(df: DataFrame, y: str, low: str, up: str, places: int = 4) -> DataFrame:
    return df.agg(F.round(F.avg(F.col(y).between(F.col(low), F.col(up)).cast("double")) * 100, places).alias("coverage_percent"))


def pinball(y: Column, q: Column, level: float) -> Column:
    return F.greatest(level * (y - q), (level - 1) * (y - q))
