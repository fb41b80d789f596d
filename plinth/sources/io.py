"""Readers with explicit schemas, and sinks that are safe to run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def scan_jsonl(spark: SparkSession, path: str, schema: StructType | str, required: str) -> DataFrame:
    """Records whose required text is there and not empty; error records have none."""
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path).where(F.col(required).isNotNull() & (F.col(required) != ""))


def scan_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def scan_day(df: DataFrame, column: str, day) -> DataFrame:
    """Rows of one day, as a range on the column itself, so that files and partitions are skipped."""
    start = F.to_timestamp(F.lit(str(day)))
    return df.where((F.col(column) >= start) & (F.col(column) < start + F.expr("interval 1 day")))


def new_rows(batch: DataFrame, target_keys: DataFrame, key: str, order) -> DataFrame:
    """The first row of each key of the batch that the target doesn't have; null keys aren't loaded."""
    rest = [c for c in batch.columns if c != key and c not in order]
    first = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("first")).select(key, "first.*")
    return first.join(target_keys.select(key), key, "left_anti").select(*batch.columns)


def append_new(batch: DataFrame, target: str, key: str, order) -> None:
    """Insert-only load: existing rows never change, and a batch that is loaded again adds nothing."""
    spark = batch.sparkSession
    try:
        keys = spark.read.parquet(target).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        keys = spark.createDataFrame([], batch.select(key).schema)
    new_rows(batch, keys, key, order).write.mode("append").parquet(target)


def upsert(registry: DataFrame, entries: DataFrame, key: str, order: str) -> DataFrame:
    """Entries replace registry rows of their key; of several entries for a key the last by ``order`` counts; newest first."""
    both = registry.withColumn("_new", F.lit(0)).unionByName(entries.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new").orderBy(F.desc(order))


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Records without an error, and those with one."""
    return df.where(F.col(error).isNull()), df.where(F.col(error).isNotNull())


def stamped(df: DataFrame, brand: str, at, path) -> DataFrame:
    """Adds brand, scrape time (UTC) and the run label that the path ends in."""
    return df.select("*", F.lit(brand).alias("brand"), at.alias("scraped_at"), F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2}_\d{2}-\d{2})", 1).alias("run_label"))


def write_splits(df: DataFrame, folder: str, version: str, split: str) -> None:
    df.write.mode("overwrite").option("header", True).partitionBy(version, split).csv(folder)


def write_metrics(metrics: DataFrame, folder: str) -> None:
    metrics.write.mode("overwrite").json(folder)
