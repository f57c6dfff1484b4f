"""Lookups that are kept by key and version, as Parquet in buckets; a write touches only the buckets of its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import last_wins
from ..operators.tables import lasting

#: Of a new store. An existing one keeps the number that its folder was made with.
BUCKETS = 64
_ROW = "cache_key string, version int, value string"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _touched(keys: DataFrame, buckets: int) -> list[int]:
    """The buckets of keys: as many numbers as there are buckets, at most."""
    return [r[0] for r in keys.select(_bucket("cache_key", buckets)).distinct().collect()]


def write(results: DataFrame, path: str, version: int, order: str, buckets: int = BUCKETS) -> None:
    """Keep results (cache_key, status, value and an order column): found ones with their value, misses (status 'missed')
    without; anything else is an error and isn't kept. Of a key the last row in the order counts, and replaces what the store had of it,
    of whatever version. Rows without a key are left out. Write with the number of buckets that the store was made with.
    """
    spark = results.sparkSession
    good = results.where(F.col("status").isin("found", "missed") & F.col("cache_key").isNotNull())
    last = last_wins(good.select("cache_key", F.when(F.col("status") == "found", F.col("value")).alias("value"), order), [F.col("cache_key")], [order])
    new = lasting(last.select("cache_key", F.lit(version).cast("int").alias("version"), "value"))
    touched = _touched(new, buckets)
    if not touched:
        return
    rows = new
    if _exists(spark, path):
        old = spark.read.schema(_ROW + ", bucket int").parquet(path).where(F.col("bucket").isin(touched))
        kept = old.select("cache_key", "version", "value").join(new.select("cache_key"), "cache_key", "left_anti")
        rows = lasting(new.unionByName(kept))  # whole before a bucket is replaced
    out = rows.withColumn("bucket", _bucket("cache_key", buckets)).repartition("bucket")
    out.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, version: int, keys: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """cache_key, value (null: a miss) of one version; with keys (cache_key) only the buckets that these are in. A store that isn't there is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "cache_key string, value string")
    rows = spark.read.schema(_ROW + ", bucket int").parquet(path)
    if keys is not None:
        rows = rows.where(F.col("bucket").isin(_touched(keys, buckets)))
    return rows.where(F.col("version") == version).select("cache_key", "value")
