"""Joins of requests, files, indexes and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .dedup import last_wins

#: A side is broadcast only up to so many rows, counted first; beyond that the join is left to the planner.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows. Counting stops there."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def with_latest(wants: DataFrame, index: DataFrame, key: Column, index_key: Column, order: list[str]) -> DataFrame:
    """Each want with the last index row of its key, if any; wants that repeat are all kept."""
    right = last_wins(index, [index_key], order)
    right = right.select(index_key.alias("_key"), *(F.col(c).alias(f"index_{c}") for c in index.columns))
    return wants.join(right, key == F.col("_key"), "left").drop("_key")


def split_known(wants: DataFrame, library: DataFrame, key: Column, library_key: Column, forced: bool = False) -> DataFrame:
    """Wants with action DUPLICATE where the library has the key, else WORK. forced: everything is WORK."""
    if forced:
        return wants.withColumn("action", F.lit("WORK"))
    known = library.select(library_key.alias("_key")).distinct()
    return wants.join(known, key == F.col("_key"), "left").withColumn("action", F.when(F.col("_key").isNotNull(), "DUPLICATE").otherwise("WORK")).drop("_key")


def keep_if_any(df: DataFrame, keep: Column, by: str) -> DataFrame:
    """Of each group the rows that pass, or all rows if none passes. Whether any passes is combined before the join."""
    marked = df.withColumn("_pass", F.coalesce(keep, F.lit(False)))
    some = marked.groupBy(F.col(by).alias("_by")).agg(F.bool_or("_pass").alias("_some"))
    return marked.join(some, F.col(by) == F.col("_by")).where(F.col("_pass") | ~F.col("_some")).drop("_pass", "_by", "_some")


def route(signals: DataFrame, item: str, signal: str, position: str, keywords: DataFrame) -> DataFrame:
    """Item, folder. keywords: folder, keyword, priority.

    A keyword fits where its words stand in a row in the signal. The longest keyword wins, then the first folder, then
    the first signal. Runs of words of the signal meet keywords by equality, so there is no join of all with all: a signal
    of n words has at most n runs of each keyword length.
    """
    words = F.split(X.style_norm(F.col(signal)), " ")
    lengths = [r["n"] for r in keywords.select(F.size(F.split(X.style_norm(F.col("keyword")), " ")).alias("n")).distinct().collect()]  # as many rows as there are lengths
    if not lengths:
        return signals.select(item).distinct().withColumn("folder", F.lit(None).cast("string"))
    rows = signals.select(item, position, words.alias("_w")).where("_w[0] <> ''")

    def of(n: int) -> Column:
        """The runs of n words."""
        starts = F.sequence(F.lit(1), F.size("_w") - (n - 1))
        return F.when(F.size("_w") >= n, F.transform(starts, lambda i: F.array_join(F.slice("_w", i, n), " "))).otherwise(F.array().cast("array<string>"))

    runs = F.array_distinct(F.flatten(F.array(*map(of, lengths))))
    table = keywords.select(X.style_norm(F.col("keyword")).alias("_run"), "folder", "priority")
    hits = rows.select(item, position, F.explode(runs).alias("_run")).join(small(table), "_run")
    best = F.max_by("folder", F.struct(F.length("_run"), -F.col("priority"), -F.col(position)))
    found = hits.groupBy(item).agg(best.alias("folder"))
    return signals.select(item).distinct().join(found, item, "left")


def two_pass(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """The second pass answers what the first one missed (null); what the first one found or refused stands."""
    again = second.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    return first.join(again, F.col(key) == F.col("_key"), "left").withColumn(value, F.coalesce(value, "_value")).drop("_key", "_value")


#: Score bands [low, high) and thresholds.
BANDS = ((0.95, 1.01), (0.90, 0.95), (0.85, 0.90), (0.80, 0.85), (0.75, 0.80), (0.70, 0.75), (0.0, 0.70))
THRESHOLDS = (0.70, 0.75, 0.80, 0.85, 0.90, 0.95)


def _counts() -> list[Column]:
    n = F.count("score")
    right = F.count_if(F.col("label") == "correct")
    return [n.alias("n"), right.alias("correct"), F.count_if(F.col("label") == "diff-version").alias("diff"), F.count_if(F.col("label") == "wrong").alias("wrong"), F.when(n > 0, right / n).alias("precision")]


def by_band(rows: DataFrame, bands: tuple = BANDS) -> DataFrame:
    """Rows (score, label) counted by band (which don't overlap); empty bands show as 0. Rows are counted before they meet the bands."""
    table = rows.sparkSession.createDataFrame([(i, *b) for i, b in enumerate(bands)], "band int, low double, high double")
    own = F.coalesce(*(F.when((F.col("score") >= low) & (F.col("score") < high), i) for i, (low, high) in enumerate(bands)))
    counted = rows.groupBy(own.alias("band")).agg(*_counts()).where("band is not null")
    whole = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "correct", "diff", "wrong")]
    return table.join(counted, "band", "left").select("low", "high", *whole, "precision")


def by_threshold(rows: DataFrame, thresholds: tuple = THRESHOLDS, least_n: int = 20, least_precision: float = 0.99) -> DataFrame:
    """A10: rows at or above each threshold, precision, recall over all rows, and whether it is the recommended one.

    Rows are counted once for each stretch between thresholds, then added up from above: a threshold costs a handful of
    rows, not one more copy of the input.
    """
    spark = rows.sparkSession
    stretch = F.size(F.filter(F.array(*map(F.lit, sorted(thresholds))), lambda t: t <= F.col("score")))
    parts = rows.groupBy(stretch.alias("stretch")).agg(*_counts()[:4], F.count("*").alias("all"))
    table = spark.createDataFrame([(float(t), i + 1) for i, t in enumerate(sorted(thresholds))], "threshold double, rank int")
    total = parts.agg(F.sum("all").alias("all_rows"))
    out = table.join(parts, F.col("stretch") >= F.col("rank"), "left").groupBy("threshold").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "correct", "diff", "wrong")))
    out = out.join(F.broadcast(total)).withColumn("precision", F.when(F.col("n") > 0, F.col("correct") / F.col("n"))).withColumn("recall", F.col("n") / F.col("all_rows")).drop("all_rows")
    good = (F.col("n") >= least_n) & (F.col("precision") >= least_precision)
    best = F.min(F.when(good, F.col("threshold"))).over(Window.partitionBy(F.lit(0)))
    return out.withColumn("recommended", F.coalesce(F.col("threshold") == best, F.lit(False)))


def ranked_values(hits: DataFrame, item: str, position: str, values: str, top: int = 8) -> DataFrame:
    """Item, list: the values in the first `top` hits of each item, most frequent first, then first seen."""
    w = Window.partitionBy(item).orderBy(position)
    first = hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    each = first.select(item, "_r", F.posexplode(values).alias("_i", "value"))
    counted = each.groupBy(item, "value").agg(F.count("*").alias("n"), F.min(F.struct("_r", "_i")).alias("seen"))
    return counted.groupBy(item).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "seen", "value"))), lambda x: x["value"]).alias("list"))
