"""Chains of rows that name the next one, followed for all starts at once by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import lasting


def followed(starts: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """list, step (from 1), key of what each start (list, key) meets on its way along links (key, next), at most `most` steps.

    A chain ends at a key that has no link row, after one whose next is null, and before a key that it has met. Keys of links are
    unique. A key that several starts of a list lead to counts once, at its least step.

    Round after round, links are joined with themselves and lead twice as far; what is reached by then is joined once and
    doubles too: as many joins as the length of the longest chain has bits, whatever the number of chains. Each round is
    written down, so that plans don't double as well.
    """
    each = links.where(F.col("key").isNotNull())
    known = each.select(F.col("key").alias("_known"))
    # a next that has no row of its own leads nowhere
    jump = lasting(each.select("key", "next").join(known, F.col("next") == F.col("_known"), "left").select("key", F.col("_known").alias("next")))
    at = starts.where(F.col("key").isNotNull()).select("list", F.lit(1).cast("long").alias("step"), "key")
    found, far = lasting(at.join(known, F.col("key") == F.col("_known"), "left_semi")), 1
    more = not found.isEmpty()
    while more and (most is None or far < most):
        # what is within `far` steps leads to what is within twice as many
        hop = jump.where(F.col("next").isNotNull()).select(F.col("key").alias("_key"), "next")
        ahead = found.join(hop, F.col("key") == F.col("_key")).select("list", (F.col("step") + far).alias("step"), F.col("next").alias("key"))
        both = found.unionByName(ahead.where(F.col("step") <= most) if most is not None else ahead)
        # a key that comes again is met first at its least step
        found = lasting(both.groupBy("list", "key").agg(F.min("step").alias("step")).select("list", "step", "key"))
        more, far = not found.where(F.col("step") > far).isEmpty(), far * 2
        if more and (most is None or far < most):
            jump = lasting(jump.select("key", F.col("next").alias("_via")).join(hop, F.col("_via") == F.col("_key"), "left").select("key", "next"))
    return found
