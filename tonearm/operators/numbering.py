"""Row numbers in an order, over all rows or within keys, without a task that all rows of a key go through."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import lasting

#: Bytes of a range, by the planner's estimate of the tables behind it; above the second it knows nothing of one of them. The most ranges.
RANGE_BYTES, UNKNOWN_BYTES, MOST_RANGES = 128 << 20, 1 << 50, 1 << 15
#: monotonically_increasing_id() has the partition above this bit and the row in it below.
ROW_BITS = 33


def ranges(df: DataFrame) -> int:
    """How many ranges: those of any shuffle, more where what df is made from is too large for them. Joins aren't asked for their size, as the planner multiplies those of both sides."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(usual, min(MOST_RANGES, size // RANGE_BYTES)) if size < UNKNOWN_BYTES else usual


def numbered(df: DataFrame, order: list[str | Column], name: str = "number") -> DataFrame:
    """df with the number (from 0) of each row in an order that tells rows apart.

    One shuffle into sorted ranges, which are written down; each range's rows are counted there, the counts are summed up over
    the ranges (a row for each), and a row's number is what stands before its range plus its place in it.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = lasting(df.repartitionByRange(ranges(df), *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    range_ = F.shiftrightunsigned("_m", ROW_BITS)
    sizes = rows.groupBy(range_.alias("_range")).agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    out = rows.join(F.broadcast(before), range_ == F.col("_range"))  # a row for each range
    return out.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND((1 << ROW_BITS) - 1)).drop("_m", "_range", "_before")


def numbered_within(df: DataFrame, keys: list[str], order: str, name: str = "number") -> DataFrame:
    """The same within keys (nulls are a key): the number over all rows less that of the key's first, a minimum that is combined before the shuffle."""
    rows = numbered(df, [*keys, order], name)
    first = rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min(name).alias("_first"))
    met = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    return rows.join(first, met).withColumn(name, F.col(name) - F.col("_first")).select(*rows.columns)
