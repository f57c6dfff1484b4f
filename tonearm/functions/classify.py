"""Verdicts and statuses as CASE expressions over measured columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

# Fixed values.
LOSSLESS_EXT = (".flac", ".wav", ".wave", ".aif", ".aiff", ".aifc", ".ape", ".tta", ".wv")
LOSSY_EXT = (".mp3", ".m4a", ".m4b", ".mp4", ".aac", ".ogg", ".oga", ".opus", ".wma")
LOSSLESS_CODECS = ("alac", "flac", "wmalossless", "ape", "tta", "wavpack", "mlp", "truehd", "als")
LOSSLESS, HQ, IFFY, BAD, SKIPPED, ERROR = "LOSSLESS", "HQ", "DOUTEUX", "MAUVAIS", "SKIPPED", "ERROR"
FLOORS = {"dj_club": 18000, "audiophile": 20000, "puriste": None, "mp3_320": 18000, "wav_aiff": None, "flac_only": None}
PROFILES = {"dj_club": ("lossless-strict", "mp3-fallback"), "audiophile": ("lossless-strict", "mp3-fallback"), "puriste": ("lossless-strict", None), "mp3_320": ("mp3-only", None), "wav_aiff": ("wav-aiff-only", None), "flac_only": ("flac-only", None)}
LEAST_LOSSY_KBPS, FLAC_RED_FLAG_KBPS = 310, 160


def format_class(ext: Column, codec: Column) -> Column:
    """A known codec decides, else the extension."""
    sound = codec.isin(*LOSSLESS_CODECS) | codec.startswith("pcm_")
    return F.when(X.text(codec) != "", F.when(sound, "lossless_container").otherwise("lossy")).when(ext.isin(*LOSSY_EXT), "lossy").when(ext.isin(*LOSSLESS_EXT), "lossless_container").otherwise("unknown")


def band(cutoff: Column, estimate: Column) -> Column:
    """Struct verdict, confidence."""
    row = lambda v, c: F.struct(F.lit(v).alias("verdict"), F.lit(c).alias("confidence"))
    return F.when(estimate == 0, row(LOSSLESS, "high")).when(cutoff >= 18000, row(HQ, "medium")).when(cutoff >= 16000, row(IFFY, "medium")).otherwise(row(BAD, "high"))


def red_flag(ext: Column, kbps: Column) -> Column:
    return (ext == ".flac") & (kbps > 0) & (kbps < FLAC_RED_FLAG_KBPS)


def classify_lossless(cutoff: Column, estimate: Column, kbps: Column, ext: Column) -> Column:
    """C3."""
    return F.when(red_flag(ext, kbps), F.struct(F.lit(BAD).alias("verdict"), F.lit("high").alias("confidence"))).otherwise(band(cutoff, estimate))


# The reasons that reports give.
FULL, CLUB, LIMIT, LOW = "spectre plein, cutoff {} Hz", "cutoff {} Hz (~{} kbps) - jouable club", "cutoff {} Hz (~{} kbps) - limite, a revoir", "cutoff {} Hz (~{} kbps) - source lossy bas debit"
FLAC_LOW, LOSSY_LOW = "bitrate conteneur FLAC {} kbps < 160 (source lossy)", "{} {} kbps < 320 - banni"
NOT_AUDIO, UNREADABLE, NO_WINDOW = "format non audio / non gere", "info illisible: {}", "analyse spectrale impossible (lecture vide)"
NO_NAME, NO_TAGS, NAMES_AGREE = "nom sans 'Artiste - Titre' exploitable", "aucun tag artist/title a comparer", "nom et tags coherents"
SUSPECT, PROMOTED, UNCERTAIN = "artefacts codec ({}) malgre cutoff {} Hz -> source lossy possible, a verifier", "cutoff {} Hz >= 95% Nyquist, aucune signature MP3 (Rule 1/8) -> authentique", "{} (pas de signature MP3 confirmee -> incertain)"
SIGNS = ("HF aliasing {}", "comb de bruit MP3", "pre-echo {}%", "collapse stereo {}")
VERSIONS_DIFFER, TAGS_DIFFER = "version nom='{}' != tag='{}'", "tags ne collent pas au nom ({})"


def _said(shape: str, *values: Column) -> Column:
    """The shape with its braces filled in; null if a value is."""
    parts = shape.split("{}")
    return F.concat(*(p for part, v in zip(parts, [*values, None], strict=True) for p in (F.lit(part), v.cast("string") if v is not None else F.lit(""))))


def _whole(c: Column) -> Column:
    return F.bround(c, 0).cast("long")


def band_reason(cutoff: Column, estimate: Column) -> Column:
    """The reason of band()."""
    hz = _whole(cutoff)
    return F.when(estimate == 0, _said(FULL, hz)).when(cutoff >= 18000, _said(CLUB, hz, estimate)).when(cutoff >= 16000, _said(LIMIT, hz, estimate)).otherwise(_said(LOW, hz, estimate))


def lossless_reason(cutoff: Column, estimate: Column, kbps: Column, ext: Column) -> Column:
    """The reason of classify_lossless()."""
    return F.when(red_flag(ext, kbps), _said(FLAC_LOW, kbps)).otherwise(band_reason(cutoff, estimate))


def scan_reason(format_: Column, error: Column, cutoff: Column, estimate: Column, kbps: Column, ext: Column) -> Column:
    """C4: why a scanned file has its verdict."""
    lossy = format_ == "lossy"
    low = lossy & (kbps > 0) & (kbps < LEAST_LOSSY_KBPS)
    return (
        F.when(format_ == "unknown", NOT_AUDIO).when(error.isNotNull(), _said(UNREADABLE, error)).when(cutoff.isNull(), NO_WINDOW)
        .when(low, _said(LOSSY_LOW, F.substr(ext, F.lit(2)), kbps)).when(lossy, band_reason(cutoff, estimate)).otherwise(lossless_reason(cutoff, estimate, kbps, ext))
    )


def name_reason(status: Column, name_version: Column, tag_version: Column, artist_cov: Column, title_cov: Column) -> Column:
    """The reason of name_status()."""
    version = lambda c: F.when(X.text(c) == "", "original").otherwise(c)
    low = lambda what, c: F.when(c < 0.5, _said(what + " {}%", _whole(c * 100)))
    return (
        F.when(status == "UNPARSEABLE_NAME", NO_NAME).when(status == "NAME_ONLY", NO_TAGS).when(status == "VERSION_MISMATCH", _said(VERSIONS_DIFFER, version(name_version), version(tag_version)))
        .when(status == "OK", NAMES_AGREE).otherwise(_said(TAGS_DIFFER, F.concat_ws(", ", low("artist", artist_cov), low("title", title_cov))))
    )


def forensic(cutoff: Column, estimate: Column, kbps: Column, ext: Column, rate: Column, mp3_rule: Column, lossless: Column, aliasing: Column, comb: Column, preecho: Column, stereo: Column) -> Column:
    """Struct verdict, confidence; never a lower verdict than C3. mp3_rule: the confirmed MP3 bitrate, or null."""
    base = classify_lossless(cutoff, estimate, kbps, ext)
    hits = [F.coalesce(h, F.lit(False)) for h in (aliasing > 0.5, comb, preecho > 10, stereo > 0.7)]
    total = sum((h.cast("int") for h in hits), F.lit(0))
    row = lambda v, c: F.struct(v.alias("verdict"), F.lit(c).alias("confidence"))
    suspect = (hits[0] | hits[1]) & (total >= 2) & (base["verdict"] != BAD)
    free = mp3_rule.isNull()
    return (
        F.when(~lossless, band(cutoff, estimate))
        .when(suspect, row(base["verdict"], "suspect"))
        .when((base["verdict"] != LOSSLESS) & free & (cutoff >= 0.95 * rate / 2) & ~red_flag(ext, kbps), row(F.lit(LOSSLESS), "high"))
        .when(base["verdict"].isin(HQ, IFFY) & free, row(base["verdict"], "uncertain"))
        .otherwise(base)
    )


def forensic_reason(found: Column, cutoff: Column, estimate: Column, kbps: Column, ext: Column, lossless: Column, aliasing: Column, comb: Column, preecho: Column, stereo: Column) -> Column:
    """The reason of forensic(), whose struct is found."""
    base = lossless_reason(cutoff, estimate, kbps, ext)
    hundredths = lambda c: F.format_string("%.2f", c.cast("double"))
    signs = F.concat_ws(", ", F.when(aliasing > 0.5, _said(SIGNS[0], hundredths(aliasing))), F.when(comb, SIGNS[1]), F.when(preecho > 10, _said(SIGNS[2], _whole(preecho))), F.when(stereo > 0.7, _said(SIGNS[3], hundredths(stereo))))
    return (
        F.when(~lossless, band_reason(cutoff, estimate)).when(found["confidence"] == "suspect", _said(SUSPECT, signs, _whole(cutoff)))
        .when(found["confidence"] == "uncertain", _said(UNCERTAIN, base))
        .when(found["verdict"] != classify_lossless(cutoff, estimate, kbps, ext)["verdict"], _said(PROMOTED, _whole(cutoff))).otherwise(base)
    )


def accepted(verdict: Column, format_: Column, kbps: Column, confidence: Column, cutoff: Column, preset: str = "dj_club") -> Column:
    """P2."""
    floor = FLOORS.get(preset, FLOORS["dj_club"])
    enough = (verdict == LOSSLESS) | (cutoff >= floor) if floor else verdict == LOSSLESS
    return ~verdict.isin(SKIPPED, ERROR) & ~((format_ == "lossy") & (kbps > 0) & (kbps < LEAST_LOSSY_KBPS)) & (X.text(confidence) != "suspect") & enough


def name_status(parseable: Column, tag_artist: Column, tag_title: Column, name_version: Column, tag_version: Column, artist_cov: Column, title_cov: Column) -> Column:
    """C6; coverages are null where there is nothing to measure."""
    good = F.coalesce(artist_cov >= 0.5, F.lit(True)) & F.coalesce(title_cov >= 0.5, F.lit(True))
    return F.when(~parseable, "UNPARSEABLE_NAME").when((X.text(tag_artist) == "") & (X.text(tag_title) == ""), "NAME_ONLY").when(name_version != tag_version, "VERSION_MISMATCH").when(good, "OK").otherwise("TAG_MISMATCH")


def title_coverage(wanted: Column, found: Column) -> Column:
    """By core words, or by loose words where a title has none; null where it has neither."""
    return F.coalesce(X.coverage(X.core_title_tokens(wanted), X.tokens(found)), X.coverage(X.loose_title_tokens(wanted), X.loose_tokens(found)))


def reject_reason(want_artist: Column, want_title: Column, file: Column, duration: Column, ok: Column) -> Column:
    """Why a download is refused, or null."""
    mine = X.core_artist_tokens(want_artist)

    def matches(p: Column) -> Column:
        title = F.when(p["parseable"], p["title"]).otherwise(p["stem"])
        theirs = X.tokens(F.when(p["parseable"], p["artist"]).otherwise(p["stem"]))
        covered = F.coalesce(title_coverage(want_title, title) >= 0.6, F.lit(False))
        return covered & ((F.size(mine) == 0) | F.arrays_overlap(mine, theirs)) & (X.version_key(want_title) == X.version_key(title))

    same = X.bound(X.parse_name(file), matches)
    return F.when((duration > 0) & (duration < 90), "TOO_SHORT").when(~same, "WRONG_MATCH").when(~ok, "REJECTED_FAKE")


def identify_status(best: Column, least: float = 0.85) -> Column:
    """The threshold is applied when read."""
    return F.when(best.isNull(), "NO_MATCH").when(best >= least, "MATCH").otherwise("LOW_CONFIDENCE")


def sort_action(folder: Column, readable: Column, route_inbox: bool) -> Column:
    """C10."""
    return F.when(folder.isNotNull(), "MOVE").when(~readable, "SKIP").otherwise("INBOX" if route_inbox else "SKIP")


def clean_action(status: Column, bad_name: Column, requested: Column, delete: bool = False) -> Column:
    """C12."""
    return F.when(status == "SUSPECT", "DELETE" if delete else "QUARANTINE").when(bad_name & status.isin("OK", "PARTIAL") & (X.text(requested) != ""), "RENAME").otherwise("LEAVE")
