"""Sinks: CSV, JSON, pages and plans. Nothing here moves, renames or deletes a file; plans are tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.dedup import first_wins

# Column orders.
SCAN = ("path", "filename", "ext", "format_class", "size_bytes", "dup_count", "sample_rate", "channels", "duration_s", "cutoff_hz", "cutoff_std_hz", "hf_energy_ratio", "est_source_bitrate", "container_bitrate", "verdict", "confidence", "reason", "name_status", "name_reason")
OUTCOME = ("action", "artist", "title", "original", "new_file", "new_verdict", "new_cutoff_hz", "note")
RENAMES = ("action", "from", "to", "applied", "reason")
SORTS = ("action", "from", "to", "folder", "styles", "source", "applied", "reason")
IDENTIFIED = ("status", "file", "artist", "title", "score", "proposed_name", "applied", "mbid", "note")
VALIDATED = ("label", "score", "known_artist", "known_title", "cand_artist", "cand_title", "version_known", "version_cand", "file")
STAGING = ("Score", "Status", "File", "Requested", "FilePath", "BadName", "Duration", "ExpectedDuration", "TitleScore", "ArtistScore", "TitlePrecision", "ExtraWords", "VersionMatch", "ReqVersion", "FileVersion", "ShortTitleRisk", "MixMarker", "TagArtist", "TagTitle", "Reason")
WANTS = ("Artist", "Title", "Album", "Length", "Year", "Source", "SourceUrl")


def as_text(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """K1: the fields in order as text, null or absent ones empty, booleans as 1 and 0."""
    kinds = dict(df.dtypes)
    one = lambda c: F.lit("") if c not in kinds else F.coalesce((F.col(c).cast("int") if kinds[c] == "boolean" else F.col(c)).cast("string"), F.lit(""))
    return df.select(*(one(c).alias(c) for c in fields))


def write_csv(df: DataFrame, path: str, fields: tuple[str, ...], mode: str = "errorifexists") -> None:
    """K1, K3, K4, K5, K8, K9: as many files as df has partitions; every one has the header."""
    as_text(df, fields).write.mode(mode).csv(path, header=True, escape='"', emptyValue="")


def _thousandths(c: Column) -> Column:
    return F.format_string("%.3f", c.cast("double"))


def rename_log(ops: DataFrame) -> DataFrame:
    """K4: ops (action, path, target, reason, applied) as the rows of the log of renames."""
    return as_text(ops.withColumnsRenamed({"path": "from", "target": "to"}), RENAMES)


def sort_log(ops: DataFrame) -> DataFrame:
    """K4: ops (action, path, target, folder, styles, source, reason, applied) as the rows of the log of a sort; a list of styles is joined."""
    if dict(ops.dtypes).get("styles") == "array<string>":
        ops = ops.withColumn("styles", F.array_join("styles", ", "))
    return as_text(ops.withColumnsRenamed({"path": "from", "target": "to"}), SORTS)


def identify_log(results: DataFrame) -> DataFrame:
    """K9: results (status, path, artist, title, score, proposed_name, applied, recording_mbid, note); without a best candidate its fields are empty."""
    out = results.withColumn("score", F.when(F.col("score").isNotNull(), _thousandths(F.col("score"))))
    return as_text(out.withColumnsRenamed({"path": "file", "recording_mbid": "mbid"}), IDENTIFIED)


def validation_log(rows: DataFrame) -> DataFrame:
    """K5: labelled rows (label, score, known_artist, known_title, cand_artist, cand_title, path), best score first, with the versions of both titles."""
    version = lambda c: X.version_key(F.col(c))
    out = rows.withColumns({"version_known": version("known_title"), "version_cand": version("cand_title")}).orderBy(F.desc("score"), "path")
    return as_text(out.withColumn("score", _thousandths(F.col("score"))).withColumnRenamed("path", "file"), VALIDATED)


def append_log(df: DataFrame, path: str, fields: tuple[str, ...]) -> None:
    """K10."""
    write_csv(df, path, fields, mode="append")


def json_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """K2: one JSON array as lines of text, in order (columns that tell rows apart): [ or , before each object, ] at the end.

    Rows are sorted by ranges and stay dealt out; the files that write_json() makes of them are the array if they are put
    together by name.
    """
    place = F.struct(*(F.col(c).alias(c) for c in order))
    first = df.agg(F.min(place).alias("x")).first()["x"]
    if first is None:
        return df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1)
    kinds = df.select(*order).schema
    is_first = place.eqNullSafe(F.struct(*(F.lit(v).cast(kinds[c].dataType).alias(c) for c, v in zip(order, first, strict=True))))
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    lines = df.orderBy(*order).select(F.concat(F.when(is_first, "[").otherwise(","), text).alias("value"))
    return lines.unionByName(df.sparkSession.createDataFrame([("]",)], "value string").coalesce(1))


def write_json(df: DataFrame, path: str, order: list[str]) -> None:
    json_lines(df, order).write.text(path)


def buy_links(tracks: DataFrame, order: list[str]) -> DataFrame:
    """Artist, title, discogs, bandcamp; a track that repeats but for case and edges is listed once."""
    t = tracks.where(X.text(F.col("title")) != "")
    t = first_wins(t, [X.strip(F.lower(X.text(F.col("artist")))), X.strip(F.lower(F.col("title")))], order)
    return t.withColumn("l", X.store_links(F.col("artist"), F.col("title"))).select("artist", "title", "l.discogs", "l.bandcamp")


def unfindable(outcomes: DataFrame, order: list[str]) -> DataFrame:
    """K7: links for what wasn't found."""
    return buy_links(outcomes.where("action = 'NOT_FOUND'"), order)


def escaped(c: Column) -> Column:
    out = X.text(c)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def buy_cards(links: DataFrame) -> DataFrame:
    """K6: one line of HTML for each track."""
    shown = F.when(X.text(F.col("artist")) == "", "?").otherwise(F.col("artist"))
    link = lambda c, name: F.concat(F.lit('<a href="'), escaped(F.col(c)), F.lit(f'" target="_blank" rel="noopener">{name}</a>'))
    return links.select(F.concat(F.lit("<p><b>"), escaped(shown), F.lit("</b> "), escaped(F.col("title")), F.lit(" "), link("discogs", "Discogs"), F.lit(" "), link("bandcamp", "Bandcamp"), F.lit("</p>")).alias("value"))


def routing_json(df: DataFrame, order: list[str]) -> DataFrame:
    """Key, value: entries of a routing map, the first of each key wins."""
    first = first_wins(df, [F.lower("key")], order)
    return first.select(F.lower("key").alias("key"), F.to_json(F.struct("dossier", "origFile", "priorite", "tier")).alias("value"))


def cached(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests with what the cache has for them; hit tells a cached miss from no entry."""
    c = cache.select(F.col("cache_key").alias("_key"), F.col("value").alias("cached"), F.lit(True).alias("hit"))
    return requests.join(c, X.cache_key(F.col(key)) == F.col("_key"), "left").drop("_key").withColumn("hit", F.coalesce("hit", F.lit(False)))
