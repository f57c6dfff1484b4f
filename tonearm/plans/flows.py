"""Whole flows as DataFrame plans: scan, upgrade, acquire, import, rename, sort, identify. All end in tables of intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..operators.dedup import first_wins, hashed, keepers, unique_targets, with_copies
from ..operators.matching import split_known, with_latest


def name_audit(df: DataFrame, path: str = "path", artist: str = "tag_artist", title: str = "tag_title") -> DataFrame:
    """C6 over rows: name_artist, name_title, coverages (null: not measurable), versions, name_status, name_reason."""
    p = X.parse_name(F.col(path))
    out = df.withColumn("_p", p).withColumn("_tags", F.array_union(X.tokens(F.col(artist)), X.tokens(F.col(title))))
    out = out.withColumns({"name_artist": F.col("_p.artist"), "name_title": F.col("_p.title"), "artist_coverage": X.coverage(X.tokens(F.col("_p.artist")), F.col("_tags")), "title_coverage": X.coverage(X.tokens(X.without_feat(F.col("_p.title"))), F.col("_tags")), "name_version": X.version_key(F.col("_p.title")), "tag_version": X.version_key(F.col(title))})
    status = C.name_status(F.col("_p.parseable"), F.col(artist), F.col(title), F.col("name_version"), F.col("tag_version"), F.col("artist_coverage"), F.col("title_coverage"))
    reason = C.name_reason(F.col("name_status"), F.col("name_version"), F.col("tag_version"), F.col("artist_coverage"), F.col("title_coverage"))
    return out.withColumn("name_status", status).withColumn("name_reason", reason).drop("_p", "_tags")


def scan(files: DataFrame, detector: str = "legacy") -> DataFrame:
    """Measured files (length, features and tags beside path) with verdict, confidence, reason, name audit and dup_count; one shuffle, of sizes.

    detector: 'legacy', by cutoffs, or 'forensic', which also looks at samplerate, mp3_rule (the confirmed MP3 bitrate) and, where the
    cutoff would pass, at the artefacts aliasing, comb, preecho and stereo; a column that isn't there has found nothing.
    """
    c = F.col
    kbps = F.coalesce("container_bitrate", F.lit(0))
    out = files.withColumn("format_class", C.format_class(c("ext"), c("codec")))
    reason = C.scan_reason(c("format_class"), c("error"), c("cutoff_hz"), c("est_source_bitrate"), kbps, c("ext"))
    lossy = c("format_class") == "lossy"
    lossy_low = lossy & (c("container_bitrate") > 0) & (c("container_bitrate") < C.LEAST_LOSSY_KBPS)
    failed = (c("format_class") == "unknown") | c("error").isNotNull() | c("cutoff_hz").isNull()
    if detector == "forensic":
        given = lambda name, kind: c(name).cast(kind) if name in files.columns else F.lit(None).cast(kind)
        sign = lambda name, kind="double": F.when(c("cutoff_hz") >= 18000, given(name, kind))
        signs = (sign("aliasing"), sign("comb", "boolean"), sign("preecho"), sign("stereo"))
        of = (c("cutoff_hz"), c("est_source_bitrate"), kbps, c("ext"))
        out = out.withColumn("_v", C.forensic(*of, given("samplerate", "int"), given("mp3_rule", "int"), ~lossy, *signs))
        reason = F.when(failed | lossy_low, reason).otherwise(C.forensic_reason(c("_v"), *of, ~lossy, *signs))
    elif detector == "legacy":
        out = out.withColumn("_v", F.when(lossy, C.band(c("cutoff_hz"), c("est_source_bitrate"))).otherwise(C.classify_lossless(c("cutoff_hz"), c("est_source_bitrate"), kbps, c("ext"))))
    else:
        raise ValueError(f"no detector {detector}")
    out = out.withColumn("reason", reason)
    out = out.withColumn("verdict", F.when(c("format_class") == "unknown", C.SKIPPED).when(failed, C.ERROR).when(lossy_low, C.BAD).otherwise(c("_v.verdict")))
    out = out.withColumn("confidence", F.when(failed, "").when(lossy_low, "high").otherwise(c("_v.confidence"))).drop("_v")
    return with_copies(name_audit(out), "length")


def shadow(files: DataFrame) -> DataFrame:
    """Path, verdict_legacy, verdict_forensic, confidence_forensic, reason_forensic of the files that the detectors judge differently. Paths are unique."""
    old = scan(files).select("path", F.col("verdict").alias("verdict_legacy"), F.col("confidence").alias("_confidence"))
    new = scan(files, "forensic").select(F.col("path").alias("_path"), F.col("verdict").alias("verdict_forensic"), F.col("confidence").alias("confidence_forensic"), F.col("reason").alias("reason_forensic"))
    out = old.join(new, F.col("path") == F.col("_path"))
    return out.where((F.col("verdict_legacy") != F.col("verdict_forensic")) | (F.col("_confidence") != F.col("confidence_forensic"))).drop("_path", "_confidence")


def plan_upgrade(scanned: DataFrame, preset: str = "dj_club", forced: bool = False) -> DataFrame:
    """Each analysed file as ALREADY_GOOD, UNPARSEABLE or WANT with artist, title, key and origin."""
    ok = C.accepted(F.col("verdict"), F.col("format_class"), F.col("container_bitrate"), F.col("confidence"), F.col("cutoff_hz"), preset)
    r = X.resolve(F.col("path"), F.col("tag_artist"), F.col("tag_title"))
    out = scanned.where(~F.col("verdict").isin(C.SKIPPED, C.ERROR)).withColumn("_r", X.bound(r, lambda x: F.struct(x["artist"].alias("artist"), x["title"].alias("title"))))
    action = F.when(F.coalesce(ok, F.lit(False)) & F.lit(not forced), "ALREADY_GOOD").when(F.col("_r.title") == "", "UNPARSEABLE").otherwise("WANT")
    out = out.withColumns({"action": action, "artist": F.col("_r.artist"), "title": X.search_title(F.col("_r.title"))}).drop("_r")
    return out.withColumn("key", X.match_key(F.col("artist"), F.col("title")))


def outcomes(wants: DataFrame, library: DataFrame, index: DataFrame, measured: DataFrame, preset: str = "dj_club", order: tuple[str, ...] = ("row",)) -> DataFrame:
    """What becomes of each want: DUPLICATE, NOT_FOUND, TOO_SHORT, WRONG_MATCH, REJECTED_FAKE or REPLACED."""
    w = split_known(wants, library, F.col("key"), F.col("key"))
    found = with_latest(w, index, F.col("key"), X.match_key(F.col("artist"), F.col("title")), list(order))
    m = measured.select(F.col("path").alias("_path"), *(F.col(c).alias(f"new_{c}") for c in ("verdict", "format_class", "container_bitrate", "confidence", "cutoff_hz", "duration")))
    out = found.join(m, F.col("index_filepath") == F.col("_path"), "left")
    ok = C.accepted(F.col("new_verdict"), F.col("new_format_class"), F.col("new_container_bitrate"), F.col("new_confidence"), F.col("new_cutoff_hz"), preset)
    why = C.reject_reason(F.col("artist"), F.col("title"), F.col("index_filepath"), F.col("new_duration"), F.coalesce(ok, F.lit(False)))
    return out.withColumn("action", F.when(F.col("action") == "DUPLICATE", "DUPLICATE").when(F.col("_path").isNull(), "NOT_FOUND").otherwise(F.coalesce(why, F.lit("REPLACED")))).drop("_path")


def acquire(rows: DataFrame, library: DataFrame, order: str = "row", limit: int | None = None) -> DataFrame:
    """Want-list rows, normalised, first of each key, against the library; limit counts work rows in order."""
    n = X.normalize(F.col("Artist"), F.col("Title"))
    out = rows.withColumns({"Artist": n["artist"], "Title": X.search_title(n["title"])}).where("Artist <> '' and Title <> ''")
    out = out.withColumn("key", X.match_key(F.col("Artist"), F.col("Title")))
    known = split_known(first_wins(out, [F.col("key")], [order]), library, F.col("key"), F.col("key"))
    if limit is None:
        return known
    work = known.where("action = 'WORK'").orderBy(order).limit(limit)
    return known.where("action = 'DUPLICATE'").unionByName(work)


def plan_import(files: DataFrame, library: DataFrame, order: str = "path", to: str | None = None, there: DataFrame | None = None) -> DataFrame:
    """KEEP or DUPLICATE for each file of a folder, against the library and against earlier files of the folder; with to also target (see moved()) of those that are kept."""
    r = X.resolve(F.col("path"), F.col("tag_artist"), F.col("tag_title"))
    out = files.withColumn("key", X.bound(r, lambda x: F.when(x["title"] != "", X.match_key(x["artist"], x["title"])).otherwise(F.col("path"))))
    first = out.groupBy(F.col("key").alias("_key")).agg(F.min(order).alias("_first"))
    known = library.select(F.col("key").alias("_known")).distinct()
    out = out.join(first, F.col("key") == F.col("_key")).join(known, F.col("key") == F.col("_known"), "left")
    out = out.withColumn("action", F.when(F.col("_known").isNotNull() | (F.col(order) != F.col("_first")), "DUPLICATE").otherwise("KEEP")).drop("_key", "_first", "_known")
    return out if to is None else moved(out, F.when(F.col("action") == "KEEP", to.rstrip("/")), there)


def plan_rename(files: DataFrame, size: str = "length", content: str = "content") -> DataFrame:
    """Files (folder, name, path, tags) with action DUP, SKIP, OK or REN and target."""
    files = hashed(files, size, content, "_hash")
    groups = keepers(files, size, "name", "_hash").select(F.col(size).alias("_s"), F.col("hash").alias("_h"), F.col("keep").alias("_keep"))
    r = X.resolve(F.col("path"), F.col("tag_artist"), F.col("tag_title"))
    out = files.join(groups, (F.col(size) == F.col("_s")) & (F.col("_hash") == F.col("_h")), "left").withColumn("_r", r)
    ext = F.regexp_extract("name", r"(\.[^.]+)$", 1)
    target = F.concat(X.sanitize(F.concat_ws(" - ", "_r.artist", "_r.title")), ext)
    action = F.when(F.col("_keep").isNotNull() & (F.col("_keep") != F.col("name")), "DUP").when(~F.col("_r.confident"), "SKIP").when(target == F.col("name"), "OK").otherwise("REN")
    out = out.withColumns({"action": action, "wanted": F.when(action == "REN", target).otherwise(F.col("name"))}).drop("_hash", "_s", "_h", "_keep", "_r")
    # names that stay are taken first
    out = out.withColumn("rank", F.concat(F.when(F.col("action") == "REN", "1").otherwise("0"), "path"))
    return unique_targets(out, "folder", "wanted", "rank").drop("rank", "wanted")


def plan_sort(files: DataFrame, folders: DataFrame, route_inbox: bool = False, root: str | None = None, there: DataFrame | None = None, inbox: str = "INBOX") -> DataFrame:
    """Files with the folder found for them and what to do; with root also target (see moved()), in root's folder of that name or in its inbox."""
    p = X.parse_name(F.col("path"))
    f = folders.select(F.col("path").alias("_path"), "folder")
    out = files.join(f, F.col("path") == F.col("_path"), "left").drop("_path").withColumn("action", C.sort_action(F.col("folder"), p["title"] != "", route_inbox))
    if root is None:
        return out
    to = F.concat(F.lit(root.rstrip("/") + "/"), F.when(F.col("action") == "MOVE", F.col("folder")).when(F.col("action") == "INBOX", inbox))
    return moved(out, to, there)


def moved(files: DataFrame, to: Column, there: DataFrame | None = None, path: str = "path") -> DataFrame:
    """Files with target, the path of the first free name in the folder that each goes to, in order of their paths; null where it goes nowhere.

    there: paths that exist. A file that is in its folder already keeps its name.
    """
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    rows = files.withColumns({"_to": to, "_name": name(F.col(path))}).withColumn("_own", F.when(folder(F.col(path)) == F.col("_to"), F.col("_name")))
    taken = there.select(folder(F.col("path")).alias("folder"), name(F.col("path")).alias("name")) if there is not None else None
    placed = unique_targets(rows.where("_to is not null"), "_to", "_name", path, taken, "_own").withColumn("target", F.concat_ws("/", "_to", "target"))
    return placed.unionByName(rows.where("_to is null").withColumn("target", F.lit(None).cast("string"))).drop("_to", "_name", "_own")


def label_matches(rows: DataFrame) -> DataFrame:
    """Rows (known_artist, known_title, cand_artist, cand_title) with label; null candidates are no-match."""
    from ..functions.fuzzy import at_least

    core = lambda c: F.when(F.size(X.core_title_tokens(c)) > 0, F.array_join(X.core_title_tokens(c), " ")).otherwise(F.array_join(X.loose_title_tokens(c), " "))
    c = F.col
    mine: Column = X.tokens(c("known_artist"))
    out = rows.withColumns({"_a": mine, "_b": X.tokens(c("cand_artist")), "_na": X.name_norm(c("known_artist")), "_nb": X.name_norm(c("cand_artist")), "_ta": core(c("known_title")), "_tb": core(c("cand_title"))})
    # only what words don't settle is compared by its letters
    out = out.withColumn("_shared", F.coalesce((F.size("_a") == 0) | F.arrays_overlap("_a", "_b"), F.lit(False)))
    out = out.withColumn("_ok", c("_shared") | at_least(F.when(~c("_shared") & c("cand_title").isNotNull(), c("_na")), c("_nb"), 0.85))
    out = out.withColumn("_same", at_least(F.when(c("_ok"), c("_ta")), c("_tb"), 0.85))
    label = F.when(c("cand_title").isNull(), "no-match").when(~c("_ok") | ~c("_same"), "wrong").when(X.version_key(c("known_title")) == X.version_key(c("cand_title")), "correct").otherwise("diff-version")
    return out.withColumn("label", label).drop("_a", "_b", "_na", "_nb", "_ta", "_tb", "_shared", "_ok", "_same")
