"""Names, titles and tokens as column expressions. Null counts as empty everywhere.

All of them are built-in functions, so they stay inside generated code and can be used in lambdas.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
STOP_WORDS = ("the", "and", "feat", "with", "mix", "remix", "edit", "club", "original", "extended", "vocal", "version", "live", "premiere", "featuring", "main", "dub", "long", "short", "radio", "pres", "presents", "rmx", "ver", "vol")
NOISE_WORDS = ("flac", "wav", "aiff", "mp3", "web", "vinyl", "cd", "ep", "lp", "kbps", "hz", "remaster", "remastered", "promo", "scene", "www", "com", "net", "org")
VERSION_WORDS = ("remix", "rework", "rwk", "edit", "reedit", "redit", "refix", "flip", "extended", "radio", "club", "dub", "vocal", "instrumental", "inst", "acapella", "acappella", "acoustic", "live", "bootleg", "boot", "mashup", "vip", "demo")
VERSION_CANON = {"rmx": "remix", "reedit": "edit", "redit": "edit", "rwk": "rework", "inst": "instrumental", "acappella": "acapella", "boot": "bootleg"}
MIX_MARKER = r"\b(megamix|mega mix|continuous|dj ?mix|mixtape|non ?stop|sampler|compilation|full album|b2b|back to back|live set|essential mix|versus|podcast)\b"
FEAT_TAIL = r"\s*[\(\[]?\b(feat\.?|ft\.?|featuring)\b.*$"
ARTIST_SPLIT = r"\s*(?:,|&|/|\+|\bfeat\.?\b|\bft\.?\b|\bfeaturing\b|\bvs\.?\b|\bx\b|\bwith\b|\bpres\.?\b)\s*"
BRACKET_GROUP = r"[\(\[\{].*?[\)\]\}]"
LABEL_CODE = r"\[[A-Za-z0-9]+\]"
TRACK_PREFIX = r"^\s*[A-Da-d]?\d{1,2}[\.\)\-]\s+"
SIDE_PREFIX = r"^\s*[A-H][0-9]{1,2}[\s.\)\-_]+"
SEPARATOR = r"\s[-_]\s"
VARIOUS = ("various artists", "various artist", "various", "va", "v/a", "v.a.", "v a", "compilation", "compilations", "diverse", "verschiedene")
TRAIL_YEAR = r"\s*\((?:19|20)\d{2}\)\s*$"
ANY_YEAR = r"\s*\((?:19|20)\d{2}\)"
DOUBLE_PAREN = r"(\([^)]*\))(?:\s*\1)+"
SQUARE = r"\[[^\]]*\]"
TRAIL_STAR = r"\s*\*+\s*$"
PROMO = r"premi[eè]re|free\s*(?:download|dl)|out\s*now|teaser|preview|snippet|exclusive"
PROMO_BARE = ("premiere", "première", "free download", "free dl", "out now")
JUNK_SLUG = ("am", "dl")
DOMAIN = r"\b[\w-]+\.(?:com|net|org|pro|io|co|me|info)\b"
ILLEGAL = r'[\\/:*?"<>|]'

U, I = "(?U)", "(?iU)"  # white space and letters as Unicode has them; the same without case


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def sub(c: Column, pattern: str, new: str = "", flags: str = U) -> Column:
    return F.regexp_replace(c, flags + pattern, new)


def strip(c: Column) -> Column:
    return sub(c, r"^\s+|\s+$")


def trim_edges(c: Column) -> Column:
    return sub(c, r"^[ \-_]+|[ \-_]+$")


def bound(c: Column, f) -> Column:
    """f(c), with c evaluated once for a row however often f uses it."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def squeeze(c: Column) -> Column:
    return strip(sub(c, r"\s+", " "))


@lru_cache
def _accents() -> tuple[str, str]:
    """Every character that canonical decomposition takes apart into one base character and marks, and the base characters."""
    pairs = []
    for code in (*range(0x80, 0xAC00), *range(0xF900, 0x30000)):
        if 0xD800 <= code < 0xF900:
            continue
        char = chr(code)
        apart = unicodedata.normalize("NFD", char)
        if apart != char:
            base = unicodedata.normalize("NFC", "".join(x for x in apart if unicodedata.category(x) != "Mn"))
            if len(base) == 1 and base != char:
                pairs.append((char, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """without accents. Spark has no Unicode normalisation, so the characters it would take apart are translated, by a table made from that rule, and marks that stand alone are dropped."""
    old, new = _accents()
    return F.when(text(c).rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(text(c), old, new), r"\p{Mn}+", "")).otherwise(text(c))


def words(c: Column) -> Column:
    """Folded, lower-case words of a-z and 0-9, in order; what both kinds of tokens are chosen from."""
    return F.split(sub(F.lower(fold(c)), r"[^a-z0-9\s]", " "), U + r"\s+")


def chosen(words_: Column, least: int = 3) -> Column:
    """Of words, those of at least so many letters that aren't stop words."""
    return F.filter(words_, lambda t: (F.length(t) >= least) & ~t.isin(*STOP_WORDS))


def tokens(c: Column, least: int = 3) -> Column:
    """folded, lower-case words of a-z and 0-9 of at least so many letters, without stop words."""
    return chosen(words(c), least)


def loose_tokens(c: Column) -> Column:
    """words of any length."""
    return tokens(c, 1)


def without_feat(c: Column) -> Column:
    """F7."""
    return strip(sub(text(c), FEAT_TAIL, flags=I))


def core_title(c: Column) -> Column:
    """The title without guests and groups in brackets."""
    return sub(without_feat(c), BRACKET_GROUP, " ")


def core_title_tokens(c: Column) -> Column:
    return tokens(core_title(c))


def loose_title_tokens(c: Column) -> Column:
    return loose_tokens(core_title(c))


def primary_artist(c: Column) -> Column:
    """up to the first separator between artists."""
    return strip(F.get(F.split(text(c), I + ARTIST_SPLIT, 2), F.lit(0)))


def core_artist_tokens(c: Column) -> Column:
    return tokens(primary_artist(c))


def coverage(wanted: Column, found: Column, digits: int = 3) -> Column:
    """share of wanted that is in found; null (at sinks -1) if nothing is wanted. Halves go to even."""
    hits = F.size(F.filter(wanted, lambda t: F.array_contains(found, t)))
    return F.when(F.size(wanted) > 0, F.bround(hits / F.size(wanted), digits))


def all_words(a: Column, b: Column) -> Column:
    """The distinct words of both."""
    return F.array_union(a, b)


def any_shared(a: Column, b: Column) -> Column:
    """Whether a word is in both."""
    return F.arrays_overlap(a, b)


def is_noise(t: Column) -> Column:
    return t.rlike(r"^\d+$") | (F.length(t) <= 2) | t.isin(*NOISE_WORDS)


def extra_words(found: Column, allowed: Column) -> Column:
    """F8, U4: found words that aren't allowed or noise, repeats kept."""
    return F.filter(found, lambda t: ~F.array_contains(allowed, t) & ~is_noise(t))


def version_key_of_folded(low: Column, words: tuple[str, ...] = VERSION_WORDS, canon: dict[str, str] = VERSION_CANON) -> Column:
    """F9 on folded, lower-case text: the version words in it, in canonical form, sorted and joined."""
    found = F.array_compact(F.array(*(F.when(low.rlike(rf"(?U)\b{w}\b"), F.lit(canon.get(w, w))) for w in words)))
    return F.array_join(F.array_sort(F.array_distinct(found)), "+")


def version_key(c: Column) -> Column:
    return bound(F.lower(fold(c)), version_key_of_folded)


def has_mix_marker(c: Column) -> Column:
    """F10."""
    return text(c).rlike(I + MIX_MARKER)


def clean(c: Column) -> Column:
    """without label codes and stray separators at the edges."""
    return trim_edges(squeeze(sub(text(c), LABEL_CODE)))


def stem(path: Column) -> Column:
    """A path's last part without its extension."""
    name = F.element_at(F.split(text(path), "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def _halves(c: Column, f) -> Column:
    """f of a struct: whether there is a separator (has), and what stands before (left) and after (right) the first one."""
    parts = F.split(c, U + SEPARATOR, 2)
    return bound(bound(parts, lambda p: F.struct((F.size(p) > 1).alias("has"), F.get(p, F.lit(0)).alias("left"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("right"))), f)


def parse_name(path: Column) -> Column:
    """struct artist, title, parseable, stem."""

    def named(raw: Column) -> Column:
        read = _halves(sub(raw, TRACK_PREFIX), lambda h: F.struct(h["has"].alias("has"), clean(h["left"]).alias("left"), clean(h["right"]).alias("right")))
        return bound(read, lambda h: F.struct(F.when(h["has"], h["left"]).otherwise("").alias("artist"), F.when(h["has"], h["right"]).otherwise(h["left"]).alias("title"), (h["has"] & (h["left"] != "") & (h["right"] != "")).alias("parseable"), raw.alias("stem")))

    return bound(stem(path), named)


def match_key(artist: Column, title: Column) -> Column:
    """F13."""
    return strip(F.lower(F.concat(text(artist), F.lit(" - "), text(title))))


def norm_dashes(c: Column) -> Column:
    """F16: plain hyphens, no invisible marks."""
    s = sub(sub(text(c), "[\u200b\u200c\u200d\u200e\u200f\ufeff]"), "[\u2010-\u2015\u2212]", "-")
    return squeeze(sub(s, "\\s\ufffd+\\s", " - "))


def light(c: Column) -> Column:
    """F15."""
    return trim_edges(squeeze(text(c)))


def strip_side(c: Column) -> Column:
    """F17."""
    return sub(text(c), SIDE_PREFIX, flags=I)


def normalize(artist: Column, title: Column) -> Column:
    """struct artist, title. Side prefixes go; a compilation's artist, or the artist again, is taken from the title."""
    pair = lambda a, t: F.struct(a.alias("artist"), t.alias("title"))

    def of_compilation(x: Column) -> Column:
        def split(h: Column) -> Column:
            various = F.lower(x["artist"]).isin(*VARIOUS) & h["has"]
            return F.when(various, pair(light(h["left"]), strip(strip_side(light(h["right"]))))).otherwise(pair(x["artist"], x["title"]))

        return _halves(x["title"], split)

    def once(x: Column) -> Column:
        again = lambda h: (x["artist"] != "") & h["has"] & (F.lower(light(h["left"])) == F.lower(x["artist"]))
        return _halves(x["title"], lambda h: pair(light(x["artist"]), light(F.when(again(h), h["right"]).otherwise(x["title"]))))

    start = pair(light(norm_dashes(artist)), strip(strip_side(light(norm_dashes(title)))))
    return bound(bound(start, of_compilation), once)


def looks_slug(c: Column) -> Column:
    """F18."""
    s = strip(text(c))
    return (F.instr(s, " ") == 0) & (F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit(""))) >= 3)


def strip_year(c: Column) -> Column:
    return strip(sub(text(c), TRAIL_YEAR))


def clean_title(c: Column) -> Column:
    """F19."""
    return strip(sub(strip_year(c), DOUBLE_PAREN, "$1", I))


def search_title(c: Column) -> Column:
    """a title as it is searched for."""
    return squeeze(sub(strip_year(sub(sub(text(c), SQUARE), TRAIL_STAR)), DOUBLE_PAREN, "$1", I))


def display(artist: Column, title: Column) -> Column:
    """struct artist, title as they are shown, without promotion words."""
    t = sub(search_title(title), rf"\s*[\(\[]\s*(?:{PROMO})\s*[\)\]]", flags=I)
    t = sub(sub(t, rf"\s*(?:#\d+\s*)?(?:[-|]\s*)?(?:{PROMO})\s*$", flags=I), r"\s*#\d+\s*$")
    a = trim_edges(sub(sub(text(artist), SQUARE), rf"^\s*(?:{PROMO})\s*[_\-:|]+\s*", flags=I))

    def shown(x: Column) -> Column:
        def split(h: Column) -> Column:
            moved = ((x["a"] == "") | F.lower(x["a"]).isin(*PROMO_BARE)) & h["has"] & (light(h["left"]) != "") & ~F.lower(light(h["left"])).isin(*PROMO_BARE)
            return F.struct(light(F.when(moved, light(h["left"])).otherwise(x["a"])).alias("artist"), light(F.when(moved, light(h["right"])).otherwise(x["t"])).alias("title"))

        return _halves(x["t"], split)

    return bound(F.struct(a.alias("a"), t.alias("t")), shown)


def deslug(c: Column) -> Column:
    """a slug's words with capitals, without years, copy marks and leading junk."""
    parts = F.filter(F.split(sub(norm_dashes(c), r"\bcopie\b", flags=I), U + r"[-_\s]+"), lambda p: (p != "") & ~p.rlike(r"^(?:19|20)\d{2}$"))
    # words from the first one on that isn't junk
    junk = F.transform(parts, lambda p: F.lower(p).isin(*JUNK_SLUG))
    first = F.array_position(junk, False)
    kept = F.when(first > 0, F.slice(parts, F.greatest(first, F.lit(1)).cast("int"), F.size(parts))).otherwise(F.array().cast("array<string>"))
    return strip(F.array_join(F.transform(kept, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), " "))


def resolve(path: Column, tag_artist: Column, tag_title: Column) -> Column:
    """struct artist, title, source, confident, by the first of: name, title tag, tags, name's title, slug."""
    ta, tt = norm_dashes(tag_artist), norm_dashes(tag_title)
    read = F.struct(parse_name(path).alias("name"), ta.alias("ta"), tt.alias("tt"))
    return bound(read, lambda x: bound(_readings(x), lambda y: _first_sure(x, y)))


def _readings(x: Column) -> Column:
    """The artist and title by name, by title tag and by both tags, and whether the title tag has both."""
    by_name = normalize(x["name"]["artist"], x["name"]["title"])
    by_tags = normalize(x["ta"], clean_title(x["tt"]))
    by_title = _halves(x["tt"], lambda h: F.struct(h["has"].alias("has"), normalize(light(h["left"]), clean_title(light(h["right"]))).alias("pair")))
    return bound(by_title, lambda t: F.struct(by_name.alias("by_name"), t["pair"].alias("by_title"), by_tags.alias("by_tags"), t["has"].alias("has")))


def _first_sure(x: Column, y: Column) -> Column:
    """The first reading that holds: the cases of resolve()."""
    p, by_name, by_title, by_tags = x["name"], y["by_name"], y["by_title"], y["by_tags"]
    name_ok = p["parseable"] & ~looks_slug(p["artist"]) & ~looks_slug(p["title"]) & (by_name["artist"] != "") & (by_name["title"] != "")
    title_ok = y["has"] & (by_title["artist"] != "") & (by_title["title"] != "")
    tags_ok = (x["ta"] != "") & (x["tt"] != "") & ~F.lower(x["ta"]).isin(*VARIOUS) & (by_tags["artist"] != "") & (by_tags["title"] != "")
    own = tokens(p["stem"])
    title_cov, artist_cov = coverage(tokens(without_feat(by_tags["title"])), own), coverage(core_artist_tokens(by_tags["artist"]), own)
    sure = F.coalesce(title_cov >= 0.5, F.lit(True)) & F.coalesce(artist_cov != 0, F.lit(True))

    def row(artist: Column, title: Column, source: str, confident: Column) -> Column:
        return F.struct(artist.alias("artist"), title.alias("title"), F.lit(source).alias("source"), confident.alias("confident"))

    return (
        F.when(name_ok, row(by_name["artist"], by_name["title"], "name", F.lit(True)))
        .when(title_ok, row(by_title["artist"], by_title["title"], "title-tag", F.lit(True)))
        .when(tags_ok, row(by_tags["artist"], by_tags["title"], "tags", sure))
        .when((p["title"] != "") & ~looks_slug(p["title"]), row(F.lit(""), strip_year(p["title"]), "name-title", F.lit(False)))
        .otherwise(row(F.lit(""), deslug(p["stem"]), "deslug", F.lit(False)))
    )


def query_title(c: Column) -> Column:
    """the base title. Groups in brackets go from the inside out, until none is left: each round closes one bracket at least."""
    group = r"[\(\[\{][^\(\)\[\]\{\}]*[\)\]\}]"

    def without_groups(t: Column) -> Column:
        rounds = F.filter(F.sequence(F.lit(0), F.regexp_count(t, F.lit(r"[\)\]\}]"))), lambda i: i > 0)
        return F.aggregate(rounds, t, lambda left, _: F.when(left.rlike(group), sub(left, group, " ")).otherwise(left))

    t = bound(sub(sub(text(c), DOMAIN, " ", I), "#.*$", " "), without_groups)
    return trim_edges(squeeze(sub(t, r"\s*-?\s*(?:original|extended)\s+mix\s*$", flags=I)))


def sanitize(c: Column) -> Column:
    """a name that file systems accept."""
    return sub(strip(sub(text(c), ILLEGAL, "_")), r"[. ]+$")


def human_size(bytes_: Column, largest: str = "TB") -> Column:
    """bytes as text, in steps of 1024 up to the largest unit; null for null."""
    units = ("B", "KB", "MB", "GB", "TB")
    last = units.index(largest)
    shown = lambda i: F.format_string("%.0f B" if i == 0 else f"%.1f {units[i]}", bytes_ / 1024.0**i)
    out = shown(last)
    for i in reversed(range(last)):
        out = F.when(bytes_ < 1024.0 ** (i + 1), shown(i)).otherwise(out)
    return F.when(bytes_.isNotNull(), out)


def eta(seconds: Column) -> Column:
    """45s, 6m, 1h22; null for what isn't a number of seconds that a long can hold."""
    s = seconds.try_cast("long")
    minutes = F.floor((s + 30) / 60)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(F.format_string("%dh%02d", F.floor(minutes / 60), minutes % 60))


def style_norm(c: Column) -> Column:
    """lower case, with hyphens, underscores and slashes as spaces."""
    return strip(sub(F.lower(text(c)), r"[\s\-_/]+", " "))


def name_norm(c: Column) -> Column:
    return squeeze(F.lower(fold(c)))


def store_query(artist: Column, title: Column) -> Column:
    return strip(F.concat_ws(" ", F.nullif(strip(text(artist)), F.lit("")), F.nullif(search_title(title), F.lit(""))))


def url_quote(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def store_links(artist: Column, title: Column) -> Column:
    """F32: struct discogs, bandcamp."""
    q = url_quote(store_query(artist, title))
    return F.struct(F.concat(F.lit("https://www.discogs.com/search/?q="), q, F.lit("&type=release")).alias("discogs"), F.concat(F.lit("https://bandcamp.com/search?q="), q).alias("bandcamp"))


def seconds(c: Column) -> Column:
    """m:ss or h:mm:ss as whole seconds; anything else, and what a long can't hold, is null."""
    p = F.transform(F.split(text(c), ":"), lambda x: F.when(strip(x).rlike(r"^[+-]?[0-9]+$"), strip(x)).try_cast("long"))
    times = lambda i, n: F.try_multiply(F.get(p, F.lit(i)), F.lit(n).cast("long"))
    return F.when(F.size(p) == 2, F.try_add(times(0, 60), times(1, 1))).when(F.size(p) == 3, F.try_add(F.try_add(times(0, 3600), times(1, 60)), times(2, 1)))


def join_artists(artists: Column) -> Column:
    """an array of structs name, join as one text."""
    name = lambda a: sub(F.rtrim(text(a["name"])), r"\s*\(\d+\)$")
    link = lambda a: F.when(a["join"] == ",", ", ").when(text(a["join"]) != "", F.concat(F.lit(" "), a["join"], F.lit(" "))).otherwise("")
    return strip(sub(strip(F.array_join(F.transform(artists, lambda a: F.concat(name(a), link(a))), "")), ",+$"))


def playlist_id(url: Column) -> Column:
    """the list of a playlist link; null for videos and for mixes, likes and watch-later lists."""
    found = F.nullif(strip(F.regexp_extract(text(url), r"[?&]list=([^&#]*)", 1)), F.lit(""))
    return F.when(~text(url).rlike(r"[?&]v=[^&#]") & ~found.rlike("(?i)^(?:RD.*|LL|WL)$"), found)


def uploads_id(url: Column, page: Column) -> Column:
    """the list of a channel's uploads, by the channel in its link or, for handles and names, in its page; null for other links."""
    channel = "(UC[0-9A-Za-z_-]{20,})"
    in_link = lambda c: F.nullif(F.regexp_extract(text(c), rf"(?i)/channel/{channel}", 1), F.lit(""))
    in_page = F.nullif(F.regexp_extract(text(page), rf'"(?:externalId|channelId|browseId)":"{channel}"', 1), F.lit(""))
    found = F.coalesce(in_link(url), in_page, in_link(page))
    return F.when(text(url).rlike(r"(?i)youtube\.com/(?:@[^/?#]+|c/[^/?#]+|user/[^/?#]+|channel/UC[\w-]+)"), F.concat(F.lit("UU"), F.substring(found, F.lit(3), F.length(found))))


def version_numbers(c: Column) -> Column:
    """the leading numbers of a version, of up to 38 digits each."""
    parts = F.transform(F.split(sub(strip(text(c)), "^[vV]+"), r"\."), lambda p: F.regexp_extract(p, r"^(\d+)", 1))
    stop = F.array_position(parts, "")
    return F.transform(F.when(stop > 0, F.slice(parts, F.lit(1), (stop - 1).cast("int"))).otherwise(parts), lambda p: p.try_cast("decimal(38,0)"))


def is_newer(latest: Column, current: Column) -> Column:
    a, b = version_numbers(latest), version_numbers(current)
    return (F.size(a) > 0) & (a > b)


def cache_key(c: Column) -> Column:
    """F37."""
    return F.substring(F.sha1(text(c)), 1, 16)


def failure_reason(lines: Column) -> Column:
    """the most telling reason in an array of log lines."""
    first = lambda shape: F.get(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, shape, 1)), lambda x: x != ""), F.lit(0))
    tail = lambda key: F.regexp_replace(first(rf"{key}:\s*(.+)$"), r"^Soulseek login failed:\s*", "")
    return F.coalesce(F.trim(first(r"Soulseek\.\w+Exception:\s*(.+)$")), tail("Failed to ensure Soulseek connection and login"), tail("Failed to initialize Soulseek client"), F.lit(""))


def failure_kind(lines: Column) -> Column:
    low = F.lower(F.array_join(lines, " \n"))
    return F.when(low.rlike("listenexception|start listening|port may be in use"), "port").when(low.rlike("loginrejected|rejected the login|invalid username or password"), "login refused").when(low.contains("login"), "login failed").otherwise("other")


def retry_variants(artist: Column, title: Column, most: int = 3) -> Column:
    """up to `most` other ways to ask for a track."""
    tidy = lambda c: squeeze(sub(sub(sub(text(c), r"\[[A-Za-z]+\d+\]"), r"\[\d+\]"), "[\"'`]"))
    a, t = tidy(artist), tidy(title)
    short = squeeze(sub(t, r"\s*\((original|club|extended|radio|long|short|dub|vocal)\s*(mix|edit|version|remix)?\)", flags=I))
    both = (a != "") & (t != "")
    ask = lambda *parts: F.concat_ws(" ", *parts, F.lit("flac"))
    return F.slice(F.array_compact(F.array(F.when(both, ask(a, t)), F.when(both & (short != "") & (short != t), ask(a, short)), F.when(both, ask(t, a)), F.when(t != "", ask(t)))), 1, most)


# ---- track lists -----------------------------------------------------------------------------------------------------

# The forms of times, numbers and links in track lists, and the words that keep a group in brackets.
CLOCK = r"^\s*[\[(]?\s*(?:\d{1,2}:)?\d{1,2}:\d{2}\s*[\])]?\s*[-.)]?\s*"
SPOKEN = r"^\s*[\[(]?\s*\d{1,3}\s*(?:h|min|sec|m|s)(?![a-z])(?:\s*\d{1,3}\s*(?:h|min|sec|m|s)(?![a-z]))*(?:\s*\d{1,2})?\s*[\])]?\s*[-.)]?\s*"
NUMBER = r"^\s*\d{1,3}\s*[.)\]:-]\s+"
LINK = r"https?://|www\.|\.(?:com|net|org|io|tv|fm|co|me|ly|gl)\b"
KEEP_GROUP = ("mix", "remix", "edit", "edited", "edits", "reedit", "dub", "rework", "refix", "rerub", "rub", "flip", "vip", "version", "vocal", "instrumental", "acapella", "bootleg", "mashup", "extended", "radio", "original", "club", "live", "demo", "acoustic", "reprise", "remaster", "remastered", "remake", "interlude", "intro", "outro", "skit", "part", "pt", "feat", "ft", "featuring", "pres", "presents", "beats", "beat", "take", "session", "edition", "cut", "rmx", "rmx.", "remixes")


def track_line(c: Column) -> Column:
    """a line of a track list without its number, time and side."""
    s = strip(text(c))
    for _ in range(2):
        s = strip_side(sub(sub(sub(s, NUMBER), CLOCK), SPOKEN, flags=I))
    return sub(s, "^[ \\-\t·•–—:]+|[ \\-\t·•–—:]+$")


def track_pair(c: Column) -> Column:
    """struct artist, title of a line, or null."""
    unknown = lambda x: F.lower(x).isin("id", "id - id", "???", "unknown")

    def known(x: Column) -> Column:
        a, t = x["artist"], x["title"]
        return F.when((a != "") & (t != "") & ~unknown(a) & ~unknown(t) & (F.length(a) <= 120) & (F.length(t) <= 160), x)

    def halves(p: Column) -> Column:
        return F.when(F.size(p) == 2, bound(F.struct(strip(F.get(p, F.lit(0))).alias("artist"), strip(F.get(p, F.lit(1))).alias("title")), known))

    return bound(F.split(norm_dashes(c), " - ", 2), halves)


#: Fixed value: what video titles hold in brackets.
VIDEO_NOISE = r"\s*[\(\[]\s*(?:official\s*(?:music\s*)?video|official\s*audio|official\s*visualizer|official|lyric\s*video|lyrics?|visuali[sz]er|audio|video|hd|4k|hq|m/?v|premiere|out\s*now|free\s*(?:download|dl)|teaser|preview)\s*[\)\]]"


def video_title(c: Column) -> Column:
    """a video's title without noise in brackets, and without what follows a bar if a pair stands before it."""
    head = lambda s: F.substring_index(s, "|", 1)
    kept = bound(norm_dashes(sub(text(c), VIDEO_NOISE, flags=I)), lambda s: F.when(F.instr(head(s), " - ") > 0, head(s)).otherwise(s))
    return strip(sub(kept, r"\s{2,}", " "))


def strip_trailing_label(c: Column) -> Column:
    """a single word in brackets at the end goes unless it names a version or a number."""

    def cut(s: Column) -> Column:
        inner, head = strip(F.regexp_extract(s, U + r"\s*\(([^()]+)\)\s*$", 1)), sub(F.regexp_extract(s, U + r"^(.*?)\s*\([^()]+\)\s*$", 1), r"\s+$")
        label = lambda x: x["inner"].rlike(r"^[A-Za-z][A-Za-z'&.\-]*$") & ~F.lower(x["inner"]).isin(*KEEP_GROUP) & ~x["inner"].rlike("(?i)^[ivxlcdm]+$")
        return bound(F.struct(inner.alias("inner"), head.alias("head")), lambda x: F.when(label(x) & (x["head"] != ""), x["head"]).otherwise(s))

    return bound(c, cut)


def title_case(c: Column) -> Column:
    """Capitals at the starts of words, if the text has none at all."""
    words = lambda s: F.array_join(F.transform(F.split(s, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    return bound(c, lambda s: F.when(s.rlike(r"\p{L}") & (s == F.lower(s)), words(s)).otherwise(s))


def strip_catalog(c: Column) -> Column:
    """catalogue numbers, doubled groups, stars, years and labels go."""
    s = sub(sub(sub(sub(text(c), SQUARE), DOUBLE_PAREN, "$1", I), TRAIL_STAR), ANY_YEAR)
    return title_case(strip(sub(strip_trailing_label(s), r"\s{2,}", " ")))


def tracklist(c: Column) -> Column:
    """The pairs of a text's lines, in order, with the line number; lines with links are left out."""
    lines = F.transform(F.split(text(c), r"\R"), lambda x, i: F.struct(i.alias("line"), F.when(~x.rlike(I + LINK), track_pair(track_line(x))).alias("pair")))
    return F.transform(F.filter(lines, lambda x: x["pair"].isNotNull()), lambda x: F.struct(x["line"].alias("line"), x["pair"]["artist"].alias("artist"), x["pair"]["title"].alias("title")))
