"""Staged responses of catalogues and video sites, as tables of JSON or pages: track lists, genres, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.chains import followed
from ..operators.matching import keep_if_any, ranked_values
from ..operators.tables import lasting
from . import nested
from . import text as X

TRACK = "array<struct<artist:string,title:string>>"
#: Pages of a playlist beside its first.
MOST_PAGES = 80


def _known(c: Column) -> Column:
    return ~F.lower(c).isin("id", "id - id", "???", "unknown") & (c != "")


def script_text(page: Column, variable: str = "ytInitialData") -> Column:
    """What follows the first brace after a page's script names a variable, or null; the object that begins there may end anywhere in it."""
    page = X.text(page)
    spaced, close = F.instr(page, f"{variable} = "), F.instr(page, f"{variable}=")
    at = F.when(spaced > 0, spaced).when(close > 0, close)
    return X.bound(F.substr(page, at), lambda t: F.when(F.instr(t, "{") > 0, F.substr(t, F.instr(t, "{"))))


def page_data(page: Column, variable: str = "ytInitialData") -> Column:
    """The object that a page's script gives a variable, as JSON text without what follows it; null where there is none."""
    return nested.first_value(script_text(page, variable))


def music_cards(page: Column) -> Column:
    """The artists and titles (array of structs) that a video page's music section names."""
    cards = F.transform(nested.find_all(script_text(page), "videoAttributeViewModel"), lambda x: F.from_json(x, "title string, subtitle string"))
    pairs = F.transform(cards, lambda x: F.struct(X.strip(X.text(x["subtitle"])).alias("artist"), X.strip(X.text(x["title"])).alias("title")))
    return F.filter(pairs, lambda x: _known(x["artist"]) & _known(x["title"]))


OLD, NEW, TOKEN = "playlistVideoRenderer", "lockupMetadataViewModel", "continuationCommand"
_RUNS = "title struct<runs: array<struct<text: string>>, simpleText: string>"


def playlist_page(page: Column) -> Column:
    """N5, S21 of the JSON of a playlist's page, in one walk: struct titles (of both layouts, each in order), token (of the next page, or null)."""

    def read(found: Column) -> Column:
        texts = lambda key: F.transform(F.filter(found, lambda x: x["key"] == key), lambda x: x["text"])
        first = lambda x: F.coalesce(F.nullif(F.get(x["title"]["runs"], F.lit(0))["text"], F.lit("")), x["title"]["simpleText"])
        old = F.transform(F.transform(texts(OLD), lambda x: F.from_json(x, _RUNS)), first)
        new = F.transform(texts(NEW), lambda x: F.from_json(x, "title struct<content: string>")["title"]["content"])
        tokens = F.transform(texts(TOKEN), lambda x: F.from_json(x, "token string")["token"])
        given = lambda c: F.filter(c, lambda t: X.text(t) != "")
        return F.struct(given(F.concat(old, new)).alias("titles"), F.get(given(tokens), F.lit(0)).alias("token"))

    return X.bound(nested.find_each(page, OLD, NEW, TOKEN), read)


def playlist_titles(page: Column) -> Column:
    """The video titles of a page of a playlist, in both of its layouts, in order."""
    return playlist_page(page)["titles"]


def continuation(page: Column) -> Column:
    """The token of the next page, or null."""
    return playlist_page(page)["token"]


def titles_of_lists(lists: DataFrame, responses: DataFrame, list_: str = "list", page: str = "page", newest: int = 0, most: int = MOST_PAGES) -> DataFrame:
    """list_, position, title of playlists whose further pages are staged by token.

    lists: list_, page (HTML of the first page). responses: token, response (JSON). A list goes on from its first page's token
    to the response of that token, from there to the next, up to `most` of them. It ends at a token that isn't staged, at a
    page without titles, or at a token that it has met. Of several responses to a token the one with the least text counts. newest: only
    so many titles of each list.
    """
    first = lasting(lists.select(F.col(list_).alias("list"), playlist_page(script_text(F.col(page))).alias("p")))
    unique = responses.where(X.text(F.col("token")) != "").groupBy("token").agg(F.min("response").alias("response"))
    more = lasting(unique.select("token", playlist_page(F.col("response")).alias("p")))
    steps = followed(first.select("list", F.col("p.token").alias("key")), more.select(F.col("token").alias("key"), F.col("p.token").alias("next")), most)
    later = steps.join(more, steps["key"] == more["token"]).select("list", "step", F.col("p.titles").alias("titles"))
    pages = first.select("list", F.lit(0).cast("long").alias("step"), F.col("p.titles").alias("titles")).unionByName(later)
    before = Window.partitionBy("list").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # at most `most` pages of a list
    ended = (F.col("step") > 0) & (F.size("titles") == 0)
    pages = pages.withColumns({"_ended": F.coalesce(F.bool_or(ended).over(before), F.lit(False)), "_n": F.coalesce(F.sum(F.size("titles")).over(before), F.lit(0))})
    out = pages.where(~F.col("_ended")).select(F.col("list").alias(list_), "_n", F.posexplode("titles").alias("i", "title")).select(list_, (F.col("_n") + F.col("i") + 1).alias("position"), "title")
    return out.where(F.col("position") <= newest) if newest else out


def link_source(url: Column, page: Column | None = None) -> Column:
    """Which source a link is read by: a playlist, a channel's uploads (page: the channel's, for links by handle or name), a video, a tracklist or set page, a pasted text, or any other page."""
    low = F.lower(X.strip(X.text(url)))
    video = low.contains("youtube.com") | low.contains("youtu.be")
    channel = X.uploads_id(url, page if page is not None else F.lit(""))
    return (
        F.when(~low.startswith("http"), "djset:paste").when(video & X.playlist_id(url).isNotNull(), "djset:youtube-playlist").when(video & channel.isNotNull(), "djset:youtube-channel")
        .when(video, "djset:youtube").when(low.contains("1001tracklists.com"), "djset:1001").when(low.contains("set79.com"), "djset:set79").otherwise("djset")
    )


def set_rows(pairs: DataFrame, url: str, artist: str = "artist", title: str = "title") -> DataFrame:
    """Want-list rows of the tracks found behind links, with the source that each link is read by."""
    none = F.lit("")
    return pairs.select(F.col(artist).alias("Artist"), F.col(title).alias("Title"), none.alias("Album"), none.alias("Length"), none.alias("Year"), link_source(F.col(url)).alias("Source"), F.col(url).alias("SourceUrl"))


def title_tracks(titles: DataFrame, list_: str) -> DataFrame:
    """list_, artist, title, position of titles (list_, position, title) that name both."""
    pair = X.track_pair(X.track_line(X.video_title(F.col("title"))))
    return titles.withColumn("p", pair).where("p is not null").select(list_, "p.artist", "p.title", "position")


def list_tracks(pages: DataFrame, list_: str, number: str, page: str, newest: int = 0) -> DataFrame:
    """list_, artist, title, position of the videos of staged pages. newest: only so many titles of each list, before they are read."""
    titles = pages.select(list_, number, F.posexplode(playlist_titles(F.col(page))).alias("i", "t"))
    titles = titles.withColumn("position", F.row_number().over(Window.partitionBy(list_).orderBy(number, "i")))
    if newest:
        titles = titles.where(F.col("position") <= newest)
    return title_tracks(titles.select(list_, F.col("t").alias("title"), "position"), list_)


def video_tracks(videos: DataFrame, comments: DataFrame, video: str = "video", page: str = "page", description: str = "description") -> DataFrame:
    """A video's tracks from its music cards, its description and its best comment, the first of each name, in that order.

    comments: video, place, text, pinned.
    """
    from ..operators.reports import best_comments

    said = F.transform(X.tracklist(F.col(description)), lambda x: F.struct(x["artist"].alias("artist"), x["title"].alias("title")))
    own = videos.select(video, music_cards(F.col(page)).alias("a"), said.alias("b"))
    best = best_comments(comments, video, "place", "text", "pinned")
    best = best.select(F.col(video).alias("_v"), F.transform("tracks", lambda x: F.struct(x["artist"].alias("artist"), x["title"].alias("title"))).alias("c"))
    rows = own.join(best, F.col(video) == F.col("_v"), "left").select(video, F.concat("a", "b", F.coalesce("c", F.array().cast(TRACK))).alias("all"))
    return first_tracks(rows, video, "all")


def first_tracks(df: DataFrame, key: str, tracks: str) -> DataFrame:
    """Key, artist, title, position: tracks cleaned, each name's first by lower-case artist and title."""
    each = df.select(key, F.posexplode(tracks).alias("position", "t"))
    each = each.select(key, "position", X.strip_catalog(F.col("t.artist")).alias("artist"), X.strip_catalog(F.col("t.title")).alias("title")).where("artist <> '' and title <> ''")
    first = each.groupBy(key, F.lower("artist").alias("_a"), F.lower("title").alias("_t")).agg(F.min(F.struct("position", "artist", "title")).alias("x"))
    return first.select(key, "x.artist", "x.title", "x.position")


def set_tracks(page: Column) -> Column:
    """The names in a set page's structured data as pairs (array of structs), in order; those without a pair are left out."""
    pairs = F.transform(nested.ld_names(page), X.track_pair)
    return F.filter(pairs, lambda p: p.isNotNull())


def marked_tracks(page: Column) -> Column:
    """The pairs that a page marks as names, else those of the first class of track elements that has some."""
    metas = F.transform(F.regexp_extract_all(X.text(page), F.lit(r'<meta\b[^>]*itemprop="name"[^>]*>'), 0), lambda m: F.regexp_extract(m, r'content="([^"]*)"', 1))
    kinds = [rf'(?s)<(\w+)\b[^>]*class="[^"]*\b{c}\b[^"]*"[^>]*>(.*?)</\1>' for c in ("tlToggle", "trackFormat", "tlpTog")] + [r'(?s)<(span)\b[^>]*class="[^"]*\btrackValue\b[^"]*"[^>]*>(.*?)</\1>']
    texts = [F.transform(F.regexp_extract_all(X.text(page), F.lit(k), 2), lambda t: X.squeeze(F.regexp_replace(t, "<[^>]*>", " "))) for k in kinds]
    found = [F.filter(F.transform(f, lambda x: X.track_pair(X.strip(nested.unescaped(x)))), lambda p: p.isNotNull()) for f in (metas, *texts)]
    return F.coalesce(*(F.when(F.size(f) > 0, f) for f in found), F.array().cast(TRACK))


HITS = "array<struct<title: string, style: array<string>, genre: array<string>>>"


def search_genres(responses: DataFrame, key: str, artist: str, response: str, top: int = 8) -> DataFrame:
    """Key, styles, genres of staged search responses.

    Hits whose title has a word of the artist's, if any has; of these the ones that aren't compilations, if any isn't; the
    values of the first `top`, most frequent first. Keys without a style or a genre are left out.
    """
    hits = responses.select(key, artist, F.posexplode(F.from_json(response, f"results {HITS}")["results"]).alias("i", "h"))
    mine = X.core_artist_tokens(F.col(artist))
    title = X.text(F.col("h.title"))
    pool = keep_if_any(hits, (F.size(mine) == 0) | F.arrays_overlap(mine, X.tokens(title)), key)
    pool = keep_if_any(pool, ~(F.lower(title).contains("various") | X.has_mix_marker(title)), key)
    none = F.array().cast("array<string>")
    rows = pool.select(key, "i", F.coalesce("h.style", none).alias("style"), F.coalesce("h.genre", none).alias("genre"))
    styles, genres = (ranked_values(rows, key, "i", c, top).select(F.col(key).alias(f"_{c}"), F.col("list").alias(c)) for c in ("style", "genre"))
    out = rows.select(key).distinct().join(styles, F.col(key) == F.col("_style"), "left").join(genres, F.col(key) == F.col("_genre"), "left")
    out = out.select(key, F.coalesce("style", none).alias("styles"), F.coalesce("genre", none).alias("genres"))
    return out.where((F.size("styles") > 0) | (F.size("genres") > 0))


def phrase(c: Column) -> Column:
    """a text that is safe between the quotes of a search."""
    return F.trim(F.replace(X.text(c), F.lit('"'), F.lit(" ")))


def recording_genres(search: DataFrame, details: DataFrame, key: str = "key") -> DataFrame:
    """Key, genres. search: key, response (recordings); details: id, genres and tags responses.

    The first recording's genres, else its tags with a count of at least 1; keys without either are left out.
    """
    found = search.select(key, F.get(F.from_json("response", "recordings array<struct<id: string>>")["recordings"], F.lit(0))["id"].alias("_id"))
    names = lambda c: F.filter(F.transform(c, lambda g: g["name"]), lambda n: X.text(n) != "")
    genres = names(F.from_json("genres", "genres array<struct<name: string>>")["genres"])
    tags = F.from_json("tags", "tags array<struct<name: string, count: int>>")["tags"]
    tags = names(F.filter(tags, lambda t: F.coalesce(t["count"], F.lit(0)) >= 1))
    none = F.array().cast("array<string>")
    known = details.select(F.col("id").alias("_known"), F.when(F.size(F.coalesce(genres, none)) > 0, genres).otherwise(F.coalesce(tags, none)).alias("genres"))
    return found.join(known, F.col("_id") == F.col("_known")).where(F.size("genres") > 0).select(key, "genres")


WANTS = "array<struct<id: long, basic_information: struct<title: string>>>"


def _items(response: Column) -> Column:
    """Of a page of a want-list or of a collection: struct of its items and the address of its next page."""
    r = F.from_json(response, f"wants {WANTS}, releases {WANTS}, pagination struct<urls: struct<next: string>>")
    return X.bound(r, lambda x: F.struct(F.coalesce(x["wants"], x["releases"]).alias("items"), F.nullif(x["pagination"]["urls"]["next"], F.lit("")).alias("next")))


def wanted_releases(pages: DataFrame, response: str = "response", newest: int = 0) -> DataFrame:
    """Id, list, number, i, title of the releases in staged pages (list, number, response) of want-lists and collections, in order of list and page, each id's first; newest: only so many, over both lists."""
    each = pages.select("list", "number", F.posexplode(_items(F.col(response))["items"]).alias("i", "x")).select("list", "number", "i", "x.id", F.col("x.basic_information.title").alias("title"))
    first = each.groupBy("id").agg(F.min(F.struct("list", "number", "i", "title")).alias("f")).select("id", "f.*")
    return first.orderBy("list", "number", "i").limit(newest) if newest else first


def linked_pages(starts: DataFrame, responses: DataFrame) -> DataFrame:
    """List, number, response of lists (list, url of the first page) whose pages (url, response) name the next one's address.

    A list ends at a page without an address, at one that isn't staged and at one that it has met; of several responses to an
    address the one with the least text counts.
    """
    unique = lasting(responses.where(X.text(F.col("url")) != "").groupBy("url").agg(F.min("response").alias("response")))
    links = unique.select(F.col("url").alias("key"), _items(F.col("response"))["next"].alias("next"))
    steps = followed(starts.select("list", F.col("url").alias("key")), links)
    return steps.join(unique, F.col("key") == F.col("url")).select("list", F.col("step").alias("number"), "response")


def script_blob(page: Column, variable: str = "TralbumData") -> Column:
    """The object that a script gives a variable, with commas before closing brackets taken out."""
    raw = F.regexp_extract(X.text(page), rf"(?s)\b{variable}\s*=\s*(\{{.*?\}})\s*;", 1)
    return F.nullif(F.regexp_replace(raw, r",(\s*[}\]])", "$1"), F.lit(""))


ALBUM = "artist string, current struct<title: string, artist: string>, trackinfo array<struct<title: string, artist: string, duration: double>>"


def album_page_tracks(pages: DataFrame, url: str, page: str) -> DataFrame:
    """The tracks of staged album pages, from the attribute or the script that holds the album."""
    blob = F.coalesce(F.nullif(nested.html_blob(F.col(page)), F.lit("")), script_blob(F.col(page)))
    a = pages.select(F.col(url).alias("SourceUrl"), F.from_json(blob, ALBUM).alias("a")).where("a is not null")
    rows = a.select("SourceUrl", F.struct("SourceUrl", "a.current.title").alias("album"), F.coalesce(F.nullif("a.artist", F.lit("")), "a.current.artist", F.lit("")).alias("band"), F.col("a.trackinfo").alias("tracks"))
    out = nested.album_tracks(rows, "album", "band", "tracks")
    return out.select("Artist", "Title", F.col("Album.title").alias("Album"), "Length", F.lit("bandcamp").alias("Source"), F.col("Album.SourceUrl").alias("SourceUrl"), "position")


def class_labels(c: Column) -> Column:
    """Struct genre, style of a class label Genre---Style."""
    p = F.split(X.text(c), "---", 2)
    return F.struct(F.get(p, F.lit(0)).alias("genre"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("style"))
