"""The staging audit and the deploy ladder. All thresholds are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Fixed values of this audit; they differ from those of the text functions.
NOISE = ("flac", "wav", "aiff", "aif", "mp3", "aac", "ogg", "m4a", "web", "vinyl", "cd", "cdr", "cdq", "ep", "lp", "single", "va", "kbps", "khz", "hz", "bit", "hq", "lossless", "master", "remaster", "remastered", "www", "com", "net", "org", "rip", "scene", "promo", "digital")
VERSIONS = ("remix", "rmx", "rework", "rwk", "edit", "reedit", "redit", "refix", "flip", "extended", "radio", "club", "dub", "vocal", "instrumental", "inst", "acapella", "acappella", "acoustic", "live", "bootleg", "boot", "mashup", "vip", "demo")
CANON = {"rmx": "remix", "rework": "remix", "rwk": "remix", "reedit": "edit", "redit": "edit", "refix": "edit", "inst": "instrumental", "acappella": "acapella", "boot": "bootleg"}


def noise(t: Column) -> Column:
    return t.rlike(r"^\d+$") | (t.rlike(r"\d") & t.rlike("[a-z]") & (F.length(t) <= 8)) | t.isin(*NOISE)


def staging_audit(df: DataFrame, ok: float = 0.8, partial: float = 0.5, tolerance: float = 0.1, shortest: float = 90, longest: float = 720, mismatch: float = 0.3, extras: int = 1, many: int = 3) -> DataFrame:
    """df (base, artist, title, duration, expected, tag_artist, tag_title, indexed) with the measures and status.

    One projection of measures, one CASE over them; nothing is shuffled. duration and expected are null if unknown.
    """
    c = F.col
    out = df.withColumns({"_title": X.tokens(c("title"), 3), "_artist": X.tokens(c("artist"), 2), "_file": X.tokens(c("base"), 2), "_tag_a": X.tokens(c("tag_artist"), 2), "_tag_t": X.tokens(c("tag_title"), 3)})
    has = F.instr(c("base"), " - ") > 0
    name = F.when(has, X.strip(F.regexp_extract(c("base"), "(?s)^.*? - (.*)$", 1))).otherwise(X.strip(c("base")))
    out = out.withColumn("_name", name)
    out = out.withColumns({"_words": X.tokens(X.sub(c("_name"), X.FEAT_TAIL, flags=X.I), 3), "_low": F.lower(X.fold(c("_name"))), "_req": F.lower(X.fold(c("title")))})
    out = out.withColumn("_extra", F.filter("_words", lambda t: ~F.array_contains(F.array_union("_title", "_artist"), t) & ~noise(t)))
    title, artist = X.coverage(c("_title"), c("_file"), 2), X.coverage(c("_artist"), c("_file"), 2)
    tag_a, tag_t = X.coverage(c("_artist"), c("_tag_a"), 2), X.coverage(c("_title"), c("_tag_t"), 2)
    out = out.withColumns({"title_score": title, "artist_score": artist, "_tag_artist": tag_a, "_tag_title": tag_t})
    expected = F.coalesce(c("expected") > 0, F.lit(False))
    duration_ok = F.when(c("duration").isNull(), True).when(expected, F.abs(c("duration") - c("expected")) <= c("expected") * tolerance).otherwise(c("duration").between(shortest, longest))
    tagged = (X.text(c("tag_artist")) != "") | (X.text(c("tag_title")) != "")
    ta, tt = F.coalesce("_tag_artist", F.lit(0.0)), F.coalesce("_tag_title", F.lit(0.0))
    suspect_tag = tagged & ((F.greatest(ta, tt) < mismatch) | F.coalesce((X.text(c("tag_artist")) != "") & (c("_tag_artist") == 0) & (tt < 0.8), F.lit(False)))
    out = out.withColumns(
        {
            "duration_ok": duration_ok,
            "tag_suspect": suspect_tag,
            "corroborated": (tagged & ((ta >= 0.5) | (tt >= 0.5))) | (expected & duration_ok & c("duration").isNotNull()),
            "req_version": X.version_key_of_folded(c("_req"), VERSIONS, CANON),
            "file_version": X.version_key_of_folded(c("_low"), VERSIONS, CANON),
            "mix_marker": c("_low").rlike(X.I + X.MIX_MARKER),
            "extra_words": F.array_join("_extra", ","),
            "title_precision": F.when(F.size("_words") > 0, F.bround((F.size("_words") - F.size("_extra")) / F.size("_words"), 2)).otherwise(1.0),
            "short_title": (F.size("_title") <= 1) & (F.size("_artist") <= 1),
        }
    )
    t, a, n = F.coalesce("title_score", F.lit(1.0)), F.coalesce("artist_score", F.lit(1.0)), F.size("_extra")
    strong = F.when(n >= extras, F.when(c("mix_marker") | (n >= many), "SUSPECT").otherwise("PARTIAL")).when(c("short_title") & ~c("corroborated"), "PARTIAL").otherwise("OK")
    status = (
        F.when(~c("indexed"), F.when(c("duration_ok"), "NO_INDEX_ENTRY").otherwise("SUSPECT"))
        .when((F.size("_title") == 0) & (F.size("_artist") == 0), "NO_MEANINGFUL_WORDS")
        .when(~c("duration_ok") | c("tag_suspect"), "SUSPECT")
        .when(c("req_version") != c("file_version"), "SUSPECT")
        .when((a >= ok) & (t >= ok), strong)
        .when((a >= partial) & (t >= partial), "PARTIAL")
        .otherwise("SUSPECT")
    )
    return out.withColumn("status", status).drop("_title", "_artist", "_file", "_tag_a", "_tag_t", "_name", "_words", "_low", "_req", "_extra", "_tag_artist", "_tag_title")


def deploy(index: DataFrame, audit: DataFrame | None, fakes: DataFrame, routing: DataFrame, existing: DataFrame, dry: bool = True) -> DataFrame:
    """C11: index (filepath, artist, title, on_disk) with action and dossier. audit: filepath, status; None: no gate."""
    from .matching import small

    low = F.lower(F.col("filepath"))
    out = index.withColumn("_path", low).withColumn("_key", F.lower(F.concat_ws(" - ", "artist", "title")))
    if audit is not None:
        out = out.join(audit.groupBy(F.lower("filepath").alias("_path")).agg(F.max("status").alias("_status")), "_path", "left")
    else:
        out = out.withColumn("_status", F.lit("OK"))
    out = out.join(fakes.select(F.col("filepath").alias("_fake")).distinct(), F.col("filepath") == F.col("_fake"), "left")
    out = out.join(small(routing.groupBy(F.lower("key").alias("_key")).agg(F.min("dossier").alias("dossier"))), "_key", "left")
    leaf = F.element_at(F.split("filepath", "/"), -1)
    out = out.withColumn("dest", F.when(F.col("dossier").isNotNull(), F.concat_ws("/", "dossier", leaf)))
    out = out.join(existing.select(F.col("dest").alias("_there")).distinct(), F.col("dest") == F.col("_there"), "left")
    action = (
        F.when(X.text(F.col("filepath")) == "", "NOT_DOWNLOADED")
        .when(~F.col("on_disk"), "FILE_MISSING")
        .when(F.coalesce(F.col("_status") != "OK", F.lit(True)), "SKIP_NOT_OK")
        .when(F.col("_fake").isNotNull(), "SKIP_FAKE")
        .when(F.col("dossier").isNull(), "UNMAPPED")
        .when(F.col("_there").isNotNull(), "ALREADY_EXISTS")
        .otherwise("DRY_COPY" if dry else "COPIED")
    )
    return out.withColumn("action", action).drop("_path", "_key", "_status", "_fake", "_there")
