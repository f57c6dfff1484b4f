"""Counts, tables and views of scanned files and outcomes. Counts are combined before a shuffle; limits are only where they are the feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as C
from ..functions import text as X

# Orders in which reports list their groups.
VERDICTS = ("LOSSLESS", "HQ", "DOUTEUX", "MAUVAIS", "SKIPPED", "ERROR")
NAMES = ("OK", "TAG_MISMATCH", "VERSION_MISMATCH", "NAME_ONLY", "UNPARSEABLE_NAME")


def place_in(c: Column, order: tuple[str, ...]) -> Column:
    """The place of a value in a fixed order, from 0; null if it has none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), c), F.lit(0)) - 1


def counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each group, most first, then by name."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def counts_in_order(df: DataFrame, by: str, order: tuple[str, ...] = VERDICTS) -> DataFrame:
    """A1: the groups of a fixed order that occur, in that order: place, group, n."""
    rows = df.sparkSession.createDataFrame(list(enumerate(order)), f"place int, `{by}` string")
    return F.broadcast(rows).join(df.groupBy(by).agg(F.count("*").alias("n")), by).select("place", by, "n").orderBy("place")


def health(df: DataFrame, verdict: str, size: str) -> DataFrame:
    """A1, A3: files of each verdict, in order, and how many of them share their size with another. Sizes are counted first, so a row is shuffled once."""
    n = F.col("n")
    sizes = df.groupBy(size, verdict).agg(F.count("*").alias("n"))
    all_ = sizes.groupBy(F.col(size).alias("_size")).agg(F.sum("n").alias("_all"))
    met = sizes.join(all_, F.col(size) == F.col("_size"), "left")
    out = met.groupBy(verdict).agg(F.sum("n").alias("files"), F.sum(F.when((F.col("_all") > 1) & (F.col(size) > 0), n).otherwise(0)).alias("same_size"))
    return out.orderBy(place_in(F.col(verdict), VERDICTS))


def transitions(df: DataFrame, old: Column, new: Column) -> DataFrame:
    """old_verdict, new_verdict, n of the rows whose verdict or confidence (structs) differs; most first."""
    both = df.select(old.alias("o"), new.alias("w")).where("o <> w")
    return both.groupBy(F.col("o.verdict").alias("old_verdict"), F.col("w.verdict").alias("new_verdict")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "old_verdict", "new_verdict")


def flagged(df: DataFrame, accepted: Column, verdict: str = "verdict", cutoff: str = "cutoff") -> DataFrame:
    """P5, O1: analysed rows that aren't accepted, by verdict and cutoff."""
    return df.where(~F.col(verdict).isin(C.SKIPPED, C.ERROR) & ~F.coalesce(accepted, F.lit(False))).orderBy(verdict, cutoff)


def first_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows, and beside them how many more there are. The limit is the view's; df stays whole."""
    more = df.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return df.orderBy(*order).limit(n).join(F.broadcast(more))


def view(df: DataFrame, kind: str, accepted: Column, verdict: str = "verdict") -> DataFrame:
    """Rows of a view: all, upgradable, or those of one verdict. Only analysed files are upgradable."""
    if kind == "all":
        return df
    if kind == "upgradable":
        return df.where(~F.col(verdict).isin(C.SKIPPED, C.ERROR) & ~F.coalesce(accepted, F.lit(False)))
    return df.where(F.col(verdict) == kind)


def totals(df: DataFrame, by: list[str], accepted: Column) -> DataFrame:
    """How many rows of each group are accepted and how many aren't."""
    ok = F.coalesce(accepted, F.lit(False))
    return df.groupBy(*by).agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


def megabytes(df: DataFrame, size: Column) -> DataFrame:
    """A14."""
    return df.agg((F.coalesce(F.sum(size), F.lit(0)) / 1048576.0).alias("mb"))


def mean_activations(df: DataFrame, patches: str, least: float = 0.08, top: int = 6) -> DataFrame:
    """Label (place in the vector), p: the highest means over all patches, of at least so much."""
    x = df.select(F.posexplode(patches).alias("label", "p")).groupBy("label").agg(F.avg(F.col("p").cast("double")).alias("p"))
    return x.where(F.col("p") >= least).orderBy(F.desc("p"), "label").limit(top)


def hit_rate(df: DataFrame, by: list[str], won: Column) -> DataFrame:
    """The percentage of rows that won."""
    return df.groupBy(*by).agg((F.count_if(won) * 100 / F.greatest(F.lit(1), F.count("*"))).alias("rate"))


def windows_of_files(df: DataFrame, file: str, place: str, cutoff: str, share: str) -> DataFrame:
    """Of each file's windows the highest cutoff, its deviation over all windows, and the share of the first window that has it."""
    return df.groupBy(file).agg(F.max(cutoff).alias("cutoff"), F.when(F.count(cutoff) > 1, F.stddev_pop(cutoff)).otherwise(0.0).alias("spread"), F.max_by(share, F.struct(cutoff, -F.col(place))).alias("share"))


def best_comments(df: DataFrame, video: str, place: str, text: str, pinned: str, least: int = 4) -> DataFrame:
    """Of each video's comments that are track lists of at least so many lines, the first pinned one, else the longest, the first of equals; with its tracks."""
    lines = df.withColumn("tracks", X.tracklist(F.col(text))).withColumn("_n", F.size("tracks")).where(F.col("_n") >= least)
    is_pinned = F.coalesce(F.col(pinned), F.lit(False))
    order = F.struct(is_pinned.cast("int"), F.when(is_pinned, 0).otherwise(F.col("_n")), -F.col(place))
    best = F.max_by(F.struct(place, "tracks"), order)
    return lines.groupBy(video).agg(best.alias("b")).select(video, f"b.{place}", "b.tracks")


def newest(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in order; without groups, of all."""
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def only(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs among keys."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key doesn't occur among keys; null keys stay."""
    return df.join(keys.select(F.col(key).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left_anti")


def selected(results: DataFrame, chosen: DataFrame, path: str = "path") -> DataFrame:
    """The results of the chosen paths, with what chosen has beside them."""
    return results.join(chosen, path)


def outcomes(*parts: DataFrame) -> DataFrame:
    """Outcomes that were settled before and after a download, as one table; columns that one hasn't are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def is_within(path: Column, parent: Column) -> Column:
    """Whether a path is its parent or below it; case and slashes at the end don't matter."""
    flat = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"(?<=.)/+$", ""))
    p, q = flat(path), flat(parent)
    return (p == q) | p.startswith(F.concat(F.regexp_replace(q, "/$", ""), F.lit("/")))


def to_wants(identified: DataFrame) -> DataFrame:
    """Want-list rows of what was matched for certain and has an artist and a title."""
    c = F.col
    rows = identified.where((c("status") == "MATCH") & (X.text(c("artist")) != "") & (X.text(c("title")) != ""))
    return rows.select(c("artist").alias("Artist"), c("title").alias("Title"), F.nullif(c("duration"), F.lit(0)).alias("Length"), F.lit("identify").alias("Source"))


def ground_truth(files: DataFrame, path: str = "path", artist: str = "tag_artist", title: str = "tag_title") -> DataFrame:
    """P10: path, known_artist, known_title of the files whose names are sure."""
    r = files.select(F.col(path).alias("path"), X.resolve(F.col(path), F.col(artist), F.col(title)).alias("r"))
    return r.where("r.confident and r.artist <> '' and r.title <> ''").select("path", F.col("r.artist").alias("known_artist"), F.col("r.title").alias("known_title"))


def sampled(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """N rows without replacement, the same for a seed however the table is dealt; all, if there are fewer."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def to_review(identified: DataFrame) -> DataFrame:
    """Matches first, then uncertain ones, each by falling score; others are left out."""
    place = place_in(F.col("status"), ("MATCH", "LOW_CONFIDENCE"))
    return identified.where(place.isNotNull()).orderBy(place, F.desc("score"))


def in_sequence(sequence: DataFrame, ids: str, cache: DataFrame, key: str, of: str | None = None) -> DataFrame:
    """The cached items in the order of an array of ids, position first; ids that the cache hasn't are left out. of: a column that tells sequences apart, which comes before it."""
    own = [of] if of else []
    each = sequence.select(*own, F.posexplode(ids).alias("position", "_id"))
    return each.join(cache, F.col("_id").cast("string") == F.col(key).cast("string")).drop("_id").orderBy(*own, "position")


# ---- labels ----------------------------------------------------------------------------------------------------------


def band_label(verdict: Column) -> Column:
    """The verdict as it is shown."""
    return F.when(verdict.isin(C.SKIPPED, C.ERROR), "SCAN").otherwise(F.upper(verdict))


def format_label(verdict: Column, ext: Column, format_class: Column, kbps: Column) -> Column:
    """.flac, mp3 320, or - if nothing was analysed."""
    low = F.lower(X.text(ext))
    codec = F.coalesce(F.nullif(F.regexp_replace(low, r"^\.+", ""), F.lit("")), F.lit("mp3"))
    rate = F.coalesce(F.bround(kbps, 0).cast("long"), F.lit(0))
    lossy = F.when(rate > 0, F.concat_ws(" ", codec, rate.cast("string"))).otherwise(codec)
    return F.when(verdict.isin(C.SKIPPED, C.ERROR), "-").when(format_class == "lossy", lossy).otherwise(F.coalesce(F.nullif(low, F.lit("")), F.lit("-")))


def status_label(verdict: Column, confidence: Column, accepted: Column, ext: Column, format_class: Column, kbps: Column, reason: Column) -> Column:
    """Struct label, problem: a file's state in one line."""
    row = lambda label, problem: F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"), F.lit(problem).alias("problem"))
    low = F.lower(X.text(ext))
    real = F.when(low == ".wav", "real WAV").when(low.isin(".aiff", ".aif"), "real AIFF").otherwise("real lossless")
    kept = F.when(verdict == C.LOSSLESS, real).when(format_class == "lossy", F.concat(format_label(verdict, ext, format_class, kbps), F.lit(" · club-ok"))).otherwise("club-ok")
    container = format_class == "lossless_container"
    return (
        F.when(verdict.isin(C.SKIPPED, C.ERROR), row(F.coalesce(F.nullif(reason, F.lit("")), F.lit("not analysed")), False))
        .when(X.text(confidence) == "suspect", row("suspect: codec artifacts -> verify", True))
        .when(F.coalesce(accepted, F.lit(False)), row(F.concat(kept, F.lit(" · kept")), False))
        .when((verdict == C.BAD) & container, row("upscale -> trash", True))
        .when(verdict == C.BAD, row("low bitrate -> trash", True))
        .when(container, row("fake lossless -> hunting slsk...", True))
        .otherwise(row("below bar -> hunting slsk...", True))
    )
