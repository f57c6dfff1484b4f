"""how alike two texts are by their matching blocks, with bounds that decide most pairs without Python."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import text as X


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of a batch; pairs that are null have been decided. Texts that come often on one side are looked into once."""
    out: dict[tuple[str, str], float] = {}
    matcher, last = difflib.SequenceMatcher(None), None
    for y, x in sorted({(y, x) for x, y in zip(a, b, strict=True) if x is not None and y is not None}):
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out[x, y] = matcher.ratio() if x and y else 0.0
    return pd.Series([None if x is None or y is None else out[x, y] for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """The share of matching blocks; 0 if either is empty."""
    return pandas_udf(_ratios, "double")(X.text(a), X.text(b))


def common_share(a: Column, b: Column) -> Column:
    """Twice the characters that both have, each as often as in the text that has it less, over those of both: no ratio is above it. 0 if either is empty."""
    times = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    each = F.array_distinct(F.regexp_extract_all(X.text(a), F.lit("(?s)."), 0))
    common = F.aggregate(F.transform(each, lambda c: F.least(times(X.text(a), c), times(X.text(b), c))), F.lit(0), lambda s, n: s + n)
    n = F.length(X.text(a)) + F.length(X.text(b))
    return F.when(n == 0, 0.0).otherwise(2.0 * common / F.when(n > 0, n))


def decided(a: Column, b: Column, least: float) -> Column:
    """Whether the ratio is at least `least`, where that needs no blocks, else null: equal and empty texts, lengths that are too different, too few characters that both have."""
    a, b = X.text(a), X.text(b)
    short = 2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))
    return F.when((a == "") | (b == ""), F.lit(least <= 0)).when(a == b, F.lit(least <= 1)).when(short < least, False).when(common_share(a, b) < least, False)


def at_least(a: Column, b: Column, least: float) -> Column:
    """Whether the ratio is at least `least`. Only what decided() leaves open is matched block by block."""
    known = decided(a, b, least)
    open_ = pandas_udf(_ratios, "double")(F.when(known.isNull(), X.text(a)), F.when(known.isNull(), X.text(b)))
    return F.coalesce(known, open_ >= least)
