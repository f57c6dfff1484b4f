"""The store of lookups, watched flows, likeness with bounds, reasons, logs, targets of moves."""

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from tonearm.functions import classify as C
from tonearm.functions import fuzzy, staged
from tonearm.plans import flows, watched
from tonearm.sources import readers, sinks, store


def L(v):
    return F.lit(v)


def test_store(spark, tmp_path):
    """Found and missed ones are kept, errors never; other versions are ignored; the last write wins, in a write and between writes; untouched buckets keep their files."""
    path = str(tmp_path / "store")
    kind = "cache_key string, status string, value string, o int"
    assert store.read(spark, path, 1).collect() == []
    store.write(spark.createDataFrame([("e", "error", "x", 0)], kind), path, 1, "o", 8)
    assert store.read(spark, path, 1).collect() == []
    store.write(spark.createDataFrame([(f"k{i}", "found", f"v{i}", 0) for i in range(50)] + [("k1", "missed", "no", 1), ("k2", "error", "no", 2), (None, "found", "x", 0), ("k3", "found", "later", 3)], kind), path, 1, "o", 8)
    want = {f"k{i}": f"v{i}" for i in range(50)} | {"k1": None, "k3": "later"}
    assert {r.cache_key: r.value for r in store.read(spark, path, 1, buckets=8).collect()} == want
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    store.write(spark.createDataFrame([("k5", "found", "new", 0), ("k6", "error", "new", 0)], kind), path, 2, "o", 8)
    assert sum(p.exists() and p.stat().st_mtime_ns == t for p, t in files.items()) == len(files) - 1
    assert {r.cache_key: r.value for r in store.read(spark, path, 1, buckets=8).collect()} == {k: v for k, v in want.items() if k != "k5"}
    keys = spark.createDataFrame([("k5",), ("gone",)], "cache_key string")
    assert ("k5", "new") in {tuple(r) for r in store.read(spark, path, 2, keys, 8).collect()}
    found = sinks.cached(spark.createDataFrame([("name",)], "n string"), spark.createDataFrame([], "cache_key string, value string"), "n").collect()
    assert [tuple(r) for r in found] == [("name", None, False)]


def test_progress_and_counts(spark):
    """§2.12: tasks while a flow runs, and counts of its points without another pass."""

    def slow(batches):
        for b in batches:
            time.sleep(0.4)
            yield b

    seen, counted = [], watched.Counted()
    df = counted.at(spark.range(0, 40, 1, 20), "read", F.count(F.lit(1)).alias("rows"))
    kept = counted.at(df.mapInArrow(slow, "id long").where("id % 2 = 0"), "kept", F.count(F.lit(1)).alias("rows"), F.max("id").alias("last"))
    assert len(watched.run(spark, kept.collect, lambda done, known: seen.append((done, known)), every=0.05)) == 20
    assert counted.counts() == {"read": {"rows": 40}, "kept": {"rows": 20, "last": 38}}
    assert seen and all(d <= k for d, k in seen) and max(k for _, k in seen) == 20 and any(0 < d < 20 for d, _ in seen)
    with pytest.raises(ZeroDivisionError):
        watched.run(spark, lambda: 1 // 0)


def test_cancel_ends_that_flow_alone(spark):
    def slow(batches):
        for b in batches:
            time.sleep(20 if b.num_rows == 2 else 1.5)
            yield b

    other = {}
    import threading

    t = threading.Thread(target=lambda: other.update(n=watched.run(spark, spark.range(0, 2, 1, 2).mapInArrow(slow, "id long").count)))
    t.start()
    began = time.time()
    with pytest.raises(watched.Stopped):
        watched.run(spark, spark.range(0, 4, 1, 2).mapInArrow(slow, "id long").count, cancel=watched.Switch(1.0), every=0.1)
    assert time.time() - began < 15
    t.join()
    assert other == {"n": 2} and watched.run(spark, spark.range(5).count) == 5


def test_likeness(spark):
    """the same answers as the matcher, most without it."""
    r = random.Random(4)
    words = ["xtal", "uforic undulance", "uforic undulence", "", "aaaa", "aaab", "b" * 30 + "a", "é" * 5, "😀x", "x😀", "a.b", "the bells", "the bell"]
    texts = words + ["".join(r.choice("abcde ") for _ in range(r.randrange(1, 25))) for _ in range(60)]
    pairs = [(r.choice(texts), r.choice(texts)) for _ in range(1500)] + [("uforic undulance", "uforic undulence"), (None, "x"), ("x", None), ("same", "same")]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    share = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0
    rows = df.select("a", "b", fuzzy.ratio(a, b).alias("r"), fuzzy.common_share(a, b).alias("s"), fuzzy.decided(a, b, 0.85).alias("d"), fuzzy.at_least(a, b, 0.85).alias("y")).collect()
    for x in rows:
        true = share(x.a, x.b)
        assert x.r == true and x.s >= true and x.y == (true >= 0.85) and x.d in (None, x.y), x
    assert sum(x.d is None for x in rows) < 0.05 * len(rows)


def test_reasons(spark):
    cases = [
        (C.band_reason(L(20500.5), L(0)), "spectre plein, cutoff 20500 Hz"),
        (C.band_reason(L(19000.0), L(256)), "cutoff 19000 Hz (~256 kbps) - jouable club"),
        (C.band_reason(L(16500.0), L(192)), "cutoff 16500 Hz (~192 kbps) - limite, a revoir"),
        (C.lossless_reason(L(15000.0), L(128), L(900), L(".flac")), "cutoff 15000 Hz (~128 kbps) - source lossy bas debit"),
        (C.lossless_reason(L(15000.0), L(128), L(100), L(".flac")), "bitrate conteneur FLAC 100 kbps < 160 (source lossy)"),
        (C.scan_reason(L("lossy"), L(None), L(15000.0), L(128), L(128), L(".mp3")), "mp3 128 kbps < 320 - banni"),
        (C.scan_reason(L("unknown"), L(None), L(None), L(None), L(0), L(".txt")), "format non audio / non gere"),
        (C.scan_reason(L("lossy"), L("bad header"), L(None), L(None), L(0), L(".mp3")), "info illisible: bad header"),
        (C.scan_reason(L("lossy"), L(None), L(None).cast("double"), L(0), L(0), L(".mp3")), "analyse spectrale impossible (lecture vide)"),
        (C.name_reason(L("VERSION_MISMATCH"), L("dub"), L(""), L(1.0), L(1.0)), "version nom='dub' != tag='original'"),
        (C.name_reason(L("TAG_MISMATCH"), L(""), L(""), L(0.0), L(1 / 3)), "tags ne collent pas au nom (artist 0%, title 33%)"),
        (C.name_reason(L("TAG_MISMATCH"), L(""), L(""), L(None).cast("double"), L(0.25)), "tags ne collent pas au nom (title 25%)"),
        (C.name_reason(L("OK"), L(""), L(""), L(1.0), L(1.0)), "nom et tags coherents"),
        (staged.link_source(L("https://www.youtube.com/@name"), L('"channelId":"UC' + "x" * 22 + '"')), "djset:youtube-channel"),
        (staged.link_source(L(" https://www.youtube.com/watch?v=a&list=PLx")), "djset:youtube"),
        (staged.link_source(L(None).cast("string")), "djset:paste"),
    ]
    for i, (made, want) in enumerate(cases):
        assert spark.range(1).select(made.alias("v")).first()["v"] == want, i


def test_logs(spark):
    """K4, K5, K9: the fields in order."""
    ops = spark.createDataFrame([("REN", "/a/x.mp3", "/a/y.mp3", "why", True)], "action string, path string, target string, reason string, applied boolean")
    assert [tuple(r) for r in sinks.rename_log(ops).collect()] == [("REN", "/a/x.mp3", "/a/y.mp3", "1", "why")] and sinks.rename_log(ops).columns == list(sinks.RENAMES)
    sorts = ops.withColumns({"folder": L("ACID"), "styles": F.array(L("A"), L("B")), "source": L("discogs")})
    assert [tuple(r) for r in sinks.sort_log(sorts).collect()] == [("REN", "/a/x.mp3", "/a/y.mp3", "ACID", "A, B", "discogs", "1", "why")]
    found = spark.createDataFrame([("MATCH", "/f", "A", "T", 0.9125, "A - T.mp3", False, "id", None), ("NO_MATCH", "/g", None, None, None, "", False, None, "n")], "status string, path string, artist string, title string, score double, proposed_name string, applied boolean, recording_mbid string, note string")
    assert [tuple(r) for r in sinks.identify_log(found).collect()] == [("MATCH", "/f", "A", "T", "0.913", "A - T.mp3", "0", "id", ""), ("NO_MATCH", "/g", "", "", "", "", "0", "", "n")]


def test_targets_of_moves(spark):
    """Files that go to a folder take free names there, those in place keep theirs; only what goes somewhere has a target."""
    files = spark.createDataFrame([("/in/A - B.mp3",), ("/in/sub/a - b.MP3",), ("/lib/ACID/A - B (1).mp3",), ("/in/C - D.mp3",), ("/in/noname.mp3",)], "path string")
    folders = spark.createDataFrame([("/in/A - B.mp3", "ACID"), ("/in/sub/a - b.MP3", "ACID"), ("/lib/ACID/A - B (1).mp3", "ACID")], "path string, folder string")
    there = spark.createDataFrame([("/lib/ACID/a - b.mp3",), ("/lib/ACID/A - B (1).mp3",), ("/lib/INBOX/C - D.mp3",)], "path string")
    got = {r.path: (r.action, r.target) for r in flows.plan_sort(files, folders, True, "/lib/", there).collect()}
    assert got == {"/in/A - B.mp3": ("MOVE", "/lib/ACID/A - B (2).mp3"), "/in/sub/a - b.MP3": ("MOVE", "/lib/ACID/a - b (3).MP3"), "/lib/ACID/A - B (1).mp3": ("MOVE", "/lib/ACID/A - B (1).mp3"), "/in/C - D.mp3": ("INBOX", "/lib/INBOX/C - D (1).mp3"), "/in/noname.mp3": ("INBOX", "/lib/INBOX/noname.mp3")}
    tagged = files.withColumns({"tag_artist": L(""), "tag_title": L("")})
    kept = {r.path: (r.action, r.target) for r in flows.plan_import(tagged, spark.createDataFrame([], "key string"), to="/lib/INBOX", there=there).collect()}
    assert kept["/in/C - D.mp3"] == ("KEEP", "/lib/INBOX/C - D (1).mp3") and kept["/in/sub/a - b.MP3"][1] is None


def test_tier(spark, tmp_path):
    """P11."""
    (tmp_path / "r.csv").write_text("Priorite;Tier;Dossier;Artiste;Titre;Fichier\n2;b;X;A;T;f\n1;a;Y;B;U;g\n2;b;W;C;V;h\n", encoding="utf-8")
    assert [r.Artiste for r in readers.to_replace(spark, str(tmp_path / "r.csv"), 2).collect()] == ["C", "A"]
    assert [r.Artiste for r in readers.to_replace(spark, str(tmp_path / "r.csv")).collect()] == ["B", "C", "A"]


def test_detectors(spark):
    """What the forensic detector judges differently, and why; artefacts count only where the cutoff would pass."""
    kind = "path string, ext string, codec string, length long, cutoff_hz double, est_source_bitrate int, container_bitrate int, error string, samplerate int, mp3_rule int, aliasing double, comb boolean, preecho double, stereo double, tag_artist string, tag_title string"
    rows = [
        ("full", ".flac", "flac", 22050.0, 0, 900, None, 44100, None, 0.1, False, 0.0, 0.0),
        ("made", ".flac", "flac", 22050.0, 0, 900, None, 44100, None, 0.7, True, 80.4, 0.95),
        ("wall", ".flac", "flac", 21200.0, 320, 800, None, 44100, None, 0.0, False, 0.0, 0.0),
        ("grey", ".flac", "flac", 19000.0, 192, 1000, None, 44100, None, 0.0, False, 0.0, 0.0),
        ("known", ".flac", "flac", 19000.0, 192, 1000, None, 44100, 192, 0.0, False, 0.0, 0.0),
        ("dull", ".flac", "flac", 16500.0, 192, 1000, None, 44100, 192, 0.9, True, 80.0, 0.9),
        ("lossy", ".mp3", "mp3", 19000.0, 192, 320, None, 44100, None, 0.9, True, 80.0, 0.9),
        ("low", ".mp3", "mp3", 19000.0, 192, 128, None, 44100, None, 0.9, True, 80.0, 0.9),
        ("broken", ".flac", None, None, None, None, "bad", None, None, None, None, None, None),
    ]
    files = spark.createDataFrame([(f"/m/A - {n}", ext, codec, i, *rest, None, None) for i, (n, ext, codec, *rest) in enumerate(rows)], kind)
    got = {r.path[7:]: (r.verdict_legacy, r.verdict_forensic, r.confidence_forensic, r.reason_forensic) for r in flows.shadow(files).collect()}
    base = "cutoff 19000 Hz (~192 kbps) - jouable club"
    assert got == {
        "made": ("LOSSLESS", "LOSSLESS", "suspect", "artefacts codec (HF aliasing 0.70, comb de bruit MP3, pre-echo 80%, collapse stereo 0.95) malgre cutoff 22050 Hz -> source lossy possible, a verifier"),
        "wall": ("HQ", "LOSSLESS", "high", "cutoff 21200 Hz >= 95% Nyquist, aucune signature MP3 (Rule 1/8) -> authentique"),
        "grey": ("HQ", "HQ", "uncertain", base + " (pas de signature MP3 confirmee -> incertain)"),
    }
    every = {r.path[7:]: (r.verdict, r.reason) for r in flows.scan(files, "forensic").collect()}
    assert every["known"] == ("HQ", base) == every["lossy"] and every["low"] == ("MAUVAIS", "mp3 128 kbps < 320 - banni") and every["broken"] == ("ERROR", "info illisible: bad")
    assert every["dull"] == ("DOUTEUX", "cutoff 16500 Hz (~192 kbps) - limite, a revoir") and every["full"][0] == "LOSSLESS"
    plain = files.drop("samplerate", "mp3_rule", "aliasing", "comb", "preecho", "stereo")
    assert {r.path[7:]: r.verdict for r in flows.scan(plain, "forensic").collect()}["made"] == "LOSSLESS"
