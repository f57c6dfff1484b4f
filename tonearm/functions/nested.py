"""Nested documents: JSON trees, release and album expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as X


#: Levels of a document that find_each() goes down, which are those that Spark parses.
DEPTH = 1000
#: A text between quotes, with the colon that makes it a name, or what stands between such texts.
_JSON_PART = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?|[^"]++|"'
_MEMBERS = "array<struct<key: string, value: variant>>"


def _numbered(doc: Column) -> Column:
    """The text with nine digits before each name, by its place: a VARIANT keeps the members of an object in order of their names, and so in that of the document."""
    named = lambda t, i: F.when(t.startswith('"') & t.endswith(":"), F.concat(F.lit('"'), F.lpad(i.cast("string"), 9, "0"), F.substr(t, F.lit(2)))).otherwise(t)
    return F.array_join(F.transform(F.regexp_extract_all(doc, F.lit(_JSON_PART), 0), named), "")


def _json_text(v: Column) -> Column:
    """A VARIANT whose names are numbered as JSON without the numbers, with a space after commas and colons."""
    spaced = lambda t: F.when(t.startswith('"') & t.endswith(":"), F.concat(F.lit('"'), F.substr(t, F.lit(11)), F.lit(" "))).when(t.startswith('"'), t).otherwise(F.replace(t, F.lit(","), F.lit(", ")))
    nested = lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_JSON_PART), 0), spaced), "")
    return X.bound(F.to_json(v), lambda t: F.when(t.startswith("{") | t.startswith("["), nested(t)).otherwise(t))


def first_value(c: Column) -> Column:
    """The first JSON value of a text as JSON, whatever follows it; null where there is none or it is broken."""
    return _json_text(F.try_parse_json(_numbered(X.text(c))))


def find_each(c: Column, *keys: str) -> Column:
    """(key, text) of all values under one of the keys, at any depth, as a walk in the order of the document meets them: an array of structs.

    A broken document, or one of more than DEPTH levels, has none; what follows its first value is ignored. A name that an
    object repeats counts each time. The text is parsed once; a fold goes down level by level, inside the row.
    """
    doc = X.text(c)
    levels = F.length(doc) - F.length(F.translate(doc, "{[", ""))
    name = lambda m: F.substr(m["key"], F.lit(10))

    def members(v: Column) -> Column:
        inside = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.lit("").alias("key"), x.alias("value")))
        return F.coalesce(inside.cast(_MEMBERS), items.cast(_MEMBERS), F.array().cast(_MEMBERS))

    def down(s: Column, _: Column) -> Column:
        found = lambda m: F.struct(m["key"].alias("at"), _json_text(m["value"]).alias("text"))
        return X.bound(F.flatten(F.transform(s["now"], lambda m: members(m["value"]))), lambda all_: F.struct(all_.alias("now"), F.concat(s["found"], F.transform(F.filter(all_, lambda m: name(m).isin(*keys)), found)).alias("found")))

    top = F.array(F.struct(F.lit("").alias("key"), F.try_parse_json(_numbered(doc)).alias("value"))).cast(_MEMBERS)
    start = F.struct(top.alias("now"), F.array().cast("array<struct<at: string, text: string>>").alias("found"))
    walked = F.aggregate(F.sequence(F.lit(0), F.least(levels, F.lit(DEPTH))), start, down)
    pair = lambda x: F.struct(F.substr(x["at"], F.lit(10)).alias("key"), x["text"].alias("text"))
    return X.bound(walked, lambda s: F.when(F.size(s["now"]) == 0, F.transform(F.array_sort(s["found"]), pair)).otherwise(F.array().cast("array<struct<key: string, text: string>>")))


def find_all(c: Column, key: str) -> Column:
    """The JSON texts of find_each() for one key."""
    return F.transform(find_each(c, key), lambda x: x["text"])


ACOUSTID = "status string, results array<struct<score: double, recordings: array<struct<id: string, title: string, duration: double, artists: array<struct<name: string>>>>>>"
RELEASE = "title string, year int, artists array<struct<name: string, join: string>>, tracklist array<struct<type_: string, title: string, duration: string, artists: array<struct<name: string, join: string>>>>"


def candidates(df: DataFrame, key: str, response: str) -> DataFrame:
    """Key, score, artist, title, recording_mbid, duration, position; recordings without a title are left out; best score first, ties in order."""
    r = df.select(key, F.from_json(response, ACOUSTID).alias("r")).select(key, F.posexplode("r.results").alias("i", "x"))
    r = r.select(key, "i", "x.score", F.posexplode("x.recordings").alias("j", "y")).where(X.text(F.col("y.title")) != "")
    artists = F.array_join(F.filter(F.transform("y.artists", lambda a: a["name"]), lambda n: X.text(n) != ""), ", ")
    out = r.select(key, "i", "j", F.coalesce("score", F.lit(0.0)).alias("score"), artists.alias("artist"), F.col("y.title").alias("title"), F.col("y.id").alias("recording_mbid"), F.col("y.duration").cast("int").alias("duration"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "i", "j")
    return out.withColumn("position", F.row_number().over(w)).drop("i", "j")


def release_tracks(df: DataFrame, release: str, source: str = "discogs", url: str = "url") -> DataFrame:
    """Want-list rows of releases; headings and untitled tracks are left out, artists fall back to the release's."""
    r = df.select(url, F.from_json(release, RELEASE).alias("r")).select(url, "r", F.posexplode("r.tracklist").alias("position", "t"))
    r = r.where((F.col("t.type_") == "track") & (X.strip(X.text(F.col("t.title"))) != ""))
    own = X.join_artists(F.coalesce("t.artists", F.array().cast("array<struct<name:string,join:string>>")))
    name = F.when(own != "", own).otherwise(X.join_artists(F.col("r.artists")))
    return r.select(name.alias("Artist"), X.strip(F.col("t.title")).alias("Title"), F.col("r.title").alias("Album"), X.seconds(F.col("t.duration")).alias("Length"), F.col("r.year").cast("string").alias("Year"), F.lit(source).alias("Source"), F.col(url).alias("SourceUrl"), "position")


def split_track(c: Column) -> Column:
    """struct artist, title, or null where the second half is the bare name of a mix."""

    def halves(p: Column) -> Column:
        pair = F.struct(X.strip(F.get(p, F.lit(0))).alias("artist"), X.strip(F.coalesce(F.get(p, F.lit(1)), F.lit(""))).alias("title"))
        bare = lambda t: ~t.endswith(")") & t.rlike(r"(?i)\b(?:mix|remix|edit|version|dub|rework|instrumental)\s*$")
        return F.when(F.size(p) == 2, X.bound(pair, lambda x: F.when((x["artist"] != "") & (x["title"] != "") & ~bare(x["title"]), x)))

    return X.bound(F.split(X.strip(X.strip_side(c)), r"(?U)\s+[-–—]\s+", 2), halves)


def album_tracks(df: DataFrame, album: str, artist: str, tracks: str) -> DataFrame:
    """Tracks of albums (array of title, artist, duration in `tracks`), each with its artist.

    A track's own artist wins; without any in the album, titles are split if at least two and 60 % of them can be;
    else the album's artist stands. Clips are left out.
    """
    c = F.col
    one = F.transform(c(tracks), lambda t: F.struct(t["title"].alias("title"), X.strip(X.text(t["artist"])).alias("artist"), t["duration"].alias("duration"), split_track(t["title"]).alias("pair")))
    out = df.select(album, artist, one.alias("t"))
    n = F.size(F.filter("t", lambda t: t["pair"].isNotNull()))
    out = out.withColumn("prefixed", ~F.exists("t", lambda t: t["artist"] != "") & (n >= 2) & (n >= 0.6 * F.size("t")))
    out = out.select(album, artist, "prefixed", F.posexplode("t").alias("position", "t")).where((X.text(c("t.title")) != "") & ~F.lower("t.title").contains("[clip]"))
    split = c("prefixed") & c("t.pair").isNotNull()
    name = X.normalize(F.when(c("t.artist") != "", c("t.artist")).when(split, c("t.pair.artist")).otherwise(c(artist)), F.when((c("t.artist") == "") & split, c("t.pair.title")).otherwise(c("t.title")))
    out = out.withColumn("n", name).where((c("n.artist") != "") & (c("n.title") != ""))
    return out.select(c("n.artist").alias("Artist"), c("n.title").alias("Title"), c(album).alias("Album"), F.when(c("t.duration") > 0, F.round("t.duration").cast("int")).alias("Length"), "position")


def tag_values(c: Column) -> Column:
    """A tag's values between ; and ,."""
    return F.filter(F.transform(F.split(X.text(c), "[;,]"), X.strip), lambda x: x != "")


def ld_names(c: Column) -> Column:
    """The names of recordings in JSON-LD text, also where the JSON is broken; escapes are decoded, or left if they are broken."""
    raw = F.regexp_extract_all(X.text(c), F.lit(r'"@type":\s*"MusicRecording",\s*"name":\s*"((?:[^"\\]|\\.)*)"'), 1)
    return F.transform(raw, lambda x: X.strip(F.coalesce(F.from_json(F.concat(F.lit('{"v":"'), x, F.lit('"}')), "v string")["v"], x)))


def html_blob(c: Column, attribute: str = "data-tralbum") -> Column:
    """An attribute's JSON, entities decoded."""
    return unescaped(F.regexp_extract(X.text(c), rf'{attribute}="([^"]*)"', 1))


def unescaped(c: Column) -> Column:
    """Text with the entities of quotes, brackets and ampersands decoded."""
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c
