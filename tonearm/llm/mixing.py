"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words. The whole part of target / source size is the number of copies that every
document of the source gets for certain; the rest is a sample of a fixed number of words with unequal probabilities: a
document's inclusion probability grows with its size, up to 1, such that the words expected are the ones missing.
Documents are ranked by random odds divided by inclusion odds, and taken in that order until their words reach what is
missing.

Ranks are never sorted within a source. The order is cut into bins, bins are summed before the shuffle, and only the bin
in which the sample ends is looked into, twice finer; a source that holds a third of all rows costs as much as others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, saved

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, "mix"
#: Sources of which rows are broadcast, one row each.
MOST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """48 random bits, fixed by seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")


def _ranks(sources: DataFrame) -> DataFrame:
    """sources with rank, their place by code point from 0, nulls last. Beyond MOST_SOURCES by ranges, not in one task."""
    order = F.col("source").asc_nulls_last()
    if sources.count() <= MOST_SOURCES:
        return sources.withColumn("rank", F.row_number().over(Window.orderBy(order)) - 1)
    # written once: the ranges that Spark draws are the same for both readers
    ranged = saved(sources.repartitionByRange(64, order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranges")
    before, total = [], 0
    sizes = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # 64 rows
    for part in range(64):
        before.append(total)
        total += sizes.get(part, 0)
    return ranged.withColumn("rank", F.get(F.lit(before), F.col("_p")).cast("long") + F.col("_i")).drop("_p", "_i")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target: shares of share * all sizes by weight, none above most * its size.

    Sizes are summed before the shuffle. Each round gives every source level * weight or, where that is above it, its
    cap, and shares the excess among the others by a higher level, until no further source is above. A round is one sum
    over one row for each source.
    """
    s = _ranks(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    s = s.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("rank", F.lit(len(weights))).cast("int")))
    s = saved(s.withColumn("cap", F.col("source_size") * float(most)).drop("rank"), "sources")
    one = s.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("weight")).first()
    level, capped = (one["all"] or 0) * share / (one["weight"] or 1.0), 0
    while True:
        above = F.col("cap") < F.col("weight") * level
        now = s.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("cap"))).alias("cap"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        if now["n"] == capped or not now["weight"]:
            break
        level, capped = (one["all"] * share - now["cap"]) / now["weight"], now["n"]
    return s.select("source", "source_size", F.least(F.col("weight") * level, F.col("cap")).alias("target"))


def _odds(sized: DataFrame, goal: DataFrame, small: bool) -> DataFrame:
    """goal with factor: a document's inclusion probability is least(1, factor * its size).

    The probabilities are such that the words expected are the ones missing: largest documents first, those whose
    probability would reach 1 are certain, and the factor is what is missing beyond these over the sum of the other
    squared sizes. Only the distinct sizes of each source are looked at.
    """
    n = sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    n = n.withColumn("words", F.col("size") * F.col("n")).withColumn("squares", (wide("words") * wide("size")).cast("decimal(38,0)"))
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("larger", F.coalesce(F.sum("words").over(before), F.lit(0)))
    n = n.withColumn("rest", F.sum("squares").over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    n = _meet(n, goal.select(F.col("source").alias("at"), "missing"), small)
    n = n.withColumn("factor", (F.col("missing") - F.col("larger")) / F.col("rest").cast("double"))
    # the largest size that isn't certain
    fits = n.where(F.col("factor") * F.col("size") < 1).groupBy(F.col("source").alias("at")).agg(F.max_by("factor", "size").alias("factor"))
    return goal.join(fits, goal["source"].eqNullSafe(fits["at"]), "left").drop("at")


def place(drawn: Column, size: Column, factor: Column) -> Column:
    """A document's place in Pareto order, in 48 bits: q / (1 + q) of its random odds over its inclusion odds q; certain ones first."""
    u = (drawn + 0.5) / float(1 << 48)
    p = size * factor
    q = (u / (1 - u)) / (p / (1 - p))
    return F.when(p >= 1, 0).otherwise(F.floor(q / (1 + q) * float(1 << 48))).cast("long")


def _ranked(docs: DataFrame, key: str, text: str, source: str, weights: tuple[int, ...], share: float, most: int, seed: str) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Rows sure of their extra copy or of none, rows of the bins in which samples end, one row a source, and if those are few."""
    sized = saved(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")).withColumn("draw", draw(F.col("key"), seed)), "sizes")
    goal = targets(sized, weights, share, most).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    small = goal.count() <= MOST_SOURCES
    goal = saved(_odds(sized, goal, small), "targets")
    rows = _meet(sized, goal.withColumnRenamed("source", "at"), small)
    # documents without words and sources that miss none have no place
    rows = rows.withColumn("q", F.when((F.col("size") > 0) & (F.col("missing") > 0), place(F.col("draw"), F.col("size"), F.col("factor"))))
    bin1, bin2 = F.shiftright("q", 36), F.shiftright("q", 24)
    end1 = _where_it_ends(rows.where("q is not null"), bin1)
    one = _meet(rows, end1.select(F.col("source").alias("at"), F.col("bin").alias("e1"), F.col("before").alias("b1")), small, "left")
    inside = one.where(bin1 == F.col("e1")).withColumn("missing", F.col("missing") - F.col("b1"))
    end2 = _where_it_ends(inside, bin2).select(F.col("source").alias("at"), F.col("bin").alias("e2"), F.col("before").alias("b2"))
    two = _meet(one, end2, small, "left")
    last = F.coalesce(bin2 == F.col("e2"), F.lit(False))
    early = F.coalesce(bin2 < F.col("e2"), F.lit(False))
    sure = two.where(~last).withColumn("extra", early.cast("long"))
    order = Window.partitionBy("source", "e2").orderBy("q", "key", "size")
    run = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    need = F.col("missing") - F.col("b1") - F.col("b2")
    # a document is taken if that brings the sum nearer to what is missing than stopping before it
    some = two.where(last).withColumn("extra", ((run - need) * 2 <= F.col("size")).cast("long"))
    return sure, some, goal, small


def _meet(a: DataFrame, b: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """a with b's columns of its source (b's `at`); sources up to MOST_SOURCES are broadcast, more meet in a join that can be split."""
    return a.join(F.broadcast(b) if small else b, a["source"].eqNullSafe(b["at"]), how).drop("at")


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """key, source, size, source_size, target, taken (words that the mix takes, repeats counted), copies.

    Documents are taken whole, up to the one with which a source's words come nearest to its target. A null text has
    size 0 and no extra copy; a very long one is counted to its end and, if its size makes it certain, taken first. A null
    source is a source, the last in order; a source of size 0 has target 0. Rows that repeat a key and size have one place
    and follow each other; ties go by key, then size. Extra columns are not read, whatever their names. An empty table
    gives an empty result. The same table gives the same mix.
    """
    sure, some, _, _ = _ranked(docs, key, text, source, weights, share, most, seed)
    out = sure.unionByName(some).withColumn("copies", F.col("whole") + F.col("extra"))
    return out.select(F.col("key").alias(key), "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _where_it_ends(rows: DataFrame, part: Column) -> DataFrame:
    """For each source the bin in which the sum of sizes reaches what is missing, and the sum before that bin."""
    bins = rows.groupBy("source", part.alias("bin")).agg(F.sum("size").alias("size"), F.first("missing").alias("missing"))
    run = F.sum("size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bins = bins.withColumn("upto", run).where(F.col("upto") >= F.col("missing"))
    return bins.groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("size")).alias("before"))).alias("e")).select("source", "e.bin", "e.before")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, taken and copies beside their own columns; rows not taken stay with 0 copies.

    The same mix as sample(), but the rows of a source that repeat a key and size are taken alike. Each source's sample is known
    by the place where it ends, one row a source, so texts meet that row where they are read and aren't shuffled. If
    names clash, the new columns get underscores before them.
    """
    names = fresh(docs, "size", "source_size", "target", "taken", "copies")
    _, some, goal, small = _ranked(docs, key, text, source, weights, share, most, seed)
    # the bin in which a source's sample ends, and the last place in it that is taken, if any
    ends = some.groupBy("source").agg(F.first("e2").alias("bin"), F.max(F.when(F.col("extra") > 0, F.struct("q", "key", "size"))).alias("upto"))
    ends = ends.withColumnRenamed("source", "at")
    cuts = saved(_meet(goal, ends, small, "left").select(F.struct("source", "source_size", "target", "whole", "missing", "factor", "bin", "upto").alias("cut")), "cuts")
    held = fresh(docs, *names, "_cut", "_size", "_draw")[5:]
    cut, size, drawn = (F.col(f"`{c}`") for c in held)
    own = F.col(f"`{key}`")
    cuts = cuts.withColumnRenamed("cut", held[0])
    # words are counted below the join: a filter on copies can't move there, so it doesn't count them again
    out = docs.withColumns({held[1]: word_count(F.col(f"`{text}`")), held[2]: draw(own, seed)})
    out = out.join(F.broadcast(cuts) if small else cuts, F.col(f"`{source}`").cast("string").eqNullSafe(cut["source"]), "left")
    q = F.when((size > 0) & (cut["missing"] > 0), place(drawn, size, cut["factor"]))
    bin2 = F.shiftright(q, 24)
    inside = (bin2 == cut["bin"]) & (F.struct(q.alias("q"), own.alias("key"), size.alias("size")) <= cut["upto"])
    copies = cut["whole"] + F.coalesce((bin2 < cut["bin"]) | inside, F.lit(False)).cast("long")
    made = (size, cut["source_size"], cut["target"], copies * size, copies)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *(c.alias(n) for c, n in zip(made, names, strict=True)))
