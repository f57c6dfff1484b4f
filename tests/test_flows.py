"""Whole flows on small libraries, operators at their edges, and staged responses."""

import random

import pytest
from pyspark.sql import functions as F

from tonearm.functions import audio, nested, staged
from tonearm.functions import text as X
from tonearm.operators import dedup, matching, reports
from tonearm.plans import flows

L = F.lit
SCANNED = "path string, ext string, codec string, length long, cutoff_hz double, est_source_bitrate int, container_bitrate int, error string, tag_artist string, tag_title string"


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [
        ("/m/A - Good.flac", ".flac", "flac", 10, 22050.0, 0, 900, None, "A", "Good"),
        ("/m/B - Fake.flac", ".flac", "flac", 10, 15000.0, 128, 900, None, "B", "Fake"),
        ("/m/C - Low.mp3", ".mp3", "mp3", 7, 19000.0, 192, 128, None, None, None),
        ("/m/D - Disco.mp3", ".mp3", "mp3", 0, 19500.0, 256, 320, None, "Other", "Song"),
        ("/m/broken.wav", ".wav", None, 0, None, None, None, "no window", None, None),
        ("/m/notes.xyz", ".xyz", None, 3, None, None, None, None, None, None),
        ("/m/x-y-z-w.flac", ".flac", "flac", 11, 16500.0, 192, 900, None, None, None),
    ]
    return flows.scan(spark.createDataFrame(rows, SCANNED)).cache()


def by(df, key, *values):
    return {r[key]: tuple(r[v] for v in values) if len(values) > 1 else r[values[0]] for r in df.collect()}


def test_scan(scanned):
    """P1, C4, C6, J7, A3."""
    got = by(scanned, "path", "verdict", "name_status", "dup_count")
    assert got["/m/A - Good.flac"] == ("LOSSLESS", "OK", 2) and got["/m/B - Fake.flac"] == ("MAUVAIS", "OK", 2)
    assert got["/m/C - Low.mp3"] == ("MAUVAIS", "NAME_ONLY", 1) and got["/m/D - Disco.mp3"] == ("HQ", "TAG_MISMATCH", 1)
    assert got["/m/broken.wav"][0] == "ERROR" and got["/m/notes.xyz"][0] == "SKIPPED" and got["/m/broken.wav"][2] == 1
    assert got["/m/x-y-z-w.flac"][:2] == ("DOUTEUX", "UNPARSEABLE_NAME")


def test_upgrade(spark, scanned):
    """From scanned files to wants to outcomes."""
    plan = by(flows.plan_upgrade(scanned), "path", "action", "key")
    assert plan["/m/A - Good.flac"][0] == "ALREADY_GOOD" and plan["/m/D - Disco.mp3"][0] == "ALREADY_GOOD"
    assert plan["/m/B - Fake.flac"] == ("WANT", "b - fake") and plan["/m/C - Low.mp3"] == ("WANT", "c - low")
    assert set(plan) == {r.path for r in scanned.collect()} - {"/m/broken.wav", "/m/notes.xyz"}
    assert set(v[0] for v in by(flows.plan_upgrade(scanned, forced=True), "path", "action", "key").values()) == {"WANT"}
    wants = spark.createDataFrame([("a - one", "A", "One"), ("b - two", "B", "Two"), ("c - three", "C", "Three"), ("d - four", "D", "Four"), ("e - five", "E", "Five"), ("f - six", "F", "Six")], "key string, artist string, title string")
    index = spark.createDataFrame([(1, "/d/old.flac", "B", "Two"), (2, "/d/B - Two.flac", "B", "Two"), (3, "/d/C - Three.flac", "C", "Three"), (4, "/d/D - Four (Dub).flac", "D", "Four"), (5, "/d/E - Five.flac", "E", "Five")], "row int, filepath string, artist string, title string")
    kind = "path string, verdict string, format_class string, container_bitrate int, confidence string, cutoff_hz double, duration double"
    measured = spark.createDataFrame([("/d/B - Two.flac", "LOSSLESS", "lossless_container", 900, "high", 22050.0, 300.0), ("/d/C - Three.flac", "MAUVAIS", "lossless_container", 900, "high", 15000.0, 300.0), ("/d/D - Four (Dub).flac", "LOSSLESS", "lossless_container", 900, "high", 22050.0, 300.0), ("/d/E - Five.flac", "LOSSLESS", "lossless_container", 900, "high", 22050.0, 60.0)], kind)
    made = flows.outcomes(wants, spark.createDataFrame([("a - one",)], "key string"), index, measured)
    assert by(made, "key", "action") == {"a - one": "DUPLICATE", "b - two": "REPLACED", "c - three": "REJECTED_FAKE", "d - four": "WRONG_MATCH", "e - five": "TOO_SHORT", "f - six": "NOT_FOUND"}


def test_acquire(spark):
    """Rows are cleaned, each key's first stays, the limit counts work only."""
    rows = spark.createDataFrame([(0, "Various", "A - One"), (1, "a", "one [X01]"), (2, "B", "Two"), (3, "", "Three"), (4, "C", "Four"), (5, "D", "Five")], "row int, Artist string, Title string")
    library = spark.createDataFrame([("b - two",)], "key string")
    assert by(flows.acquire(rows, library), "key", "action", "row") == {"a - one": ("WORK", 0), "b - two": ("DUPLICATE", 2), "c - four": ("WORK", 4), "d - five": ("WORK", 5)}
    assert sorted(by(flows.acquire(rows, library, limit=2), "key", "action")) == ["a - one", "b - two", "c - four"]


@pytest.mark.parametrize("most", [matching.BROADCAST_ROWS, 0])
def test_rename(spark, monkeypatch, most):
    """Copies, unsure names, good names and collisions, with few shared sizes and with more than are broadcast."""
    monkeypatch.setattr(matching, "BROADCAST_ROWS", most)
    files = [("A - One.flac", b"xx", None, None), ("A - One copie.flac", b"xx", None, None), ("a_-_b.flac", b"yyy", "B", "Two"), ("B - Two.flac", b"zzzz", None, None), ("x-y-z-w.flac", b"q", None, None), ("B2. C - Three.flac", b"ww", None, None)]
    df = spark.createDataFrame([("d", n, f"/d/{n}", len(c), c, a, t) for n, c, a, t in files], "folder string, name string, path string, length long, content binary, tag_artist string, tag_title string")
    got = by(flows.plan_rename(df), "name", "action", "target")
    assert got["A - One copie.flac"][0] == "DUP" and got["A - One.flac"] == ("OK", "A - One.flac") and got["B - Two.flac"][0] == "OK"
    assert got["x-y-z-w.flac"][0] == "SKIP" and got["B2. C - Three.flac"] == ("REN", "C - Three.flac")
    assert len({t for _, t in got.values()}) == len(files)


def test_import_and_sort(spark):
    """A12, C10."""
    files = spark.createDataFrame([(p, None, None) for p in ("/i/A - One.flac", "/i/a - one.mp3", "/i/B - Two.flac", "/i/ - .flac")], "path string, tag_artist string, tag_title string")
    assert by(flows.plan_import(files, spark.createDataFrame([("b - two",)], "key string")), "path", "action")["/i/B - Two.flac"] == "DUPLICATE"
    folders = spark.createDataFrame([("/i/A - One.flac", "House")], "path string, folder string")
    assert by(flows.plan_sort(files, folders, route_inbox=True), "path", "action") == {"/i/A - One.flac": "MOVE", "/i/a - one.mp3": "INBOX", "/i/B - Two.flac": "INBOX", "/i/ - .flac": "SKIP"}


def greedy(names):
    taken, out = set(), []
    for value in names:
        head, dot, tail = value.rpartition(".")
        head, dot, tail = (head, dot, tail) if head else (value, "", "")
        target, n = value, 0
        while target.lower() in taken:
            n += 1
            target = f"{head} ({n}){dot}{tail}"
        taken.add(target.lower())
        out.append(target)
    return out


def test_free_names_against_the_plain_loop(spark):
    """Names with numbers, without, in other case, without extension, many times over."""
    r = random.Random(3)
    rows = [(f"d{r.randrange(3)}", r.choice(["a", "A", "a (1)", "a (1) (1)", "a (2)", "b", "b (x)", ".hid", ".hid (1)", "c (10)"]) + r.choice(["", ".mp3", ".MP3", ".tar.gz"]), i) for i in range(600)]
    got = by(dedup.unique_targets(spark.createDataFrame(rows, "folder string, name string, o int"), "folder", "name", "o"), "o", "target")
    for d in ("d0", "d1", "d2"):
        own = [(n, i) for f, n, i in rows if f == d]
        assert [got[i] for _, i in own] == greedy([n for n, _ in own])


@pytest.mark.parametrize("n", [0, 1, 30, 5000])
def test_chunks(spark, n):
    """Also with further columns, nulls in the order, and more rows than are looked at for bounds."""
    df = spark.createDataFrame([(None if i % 11 == 0 else i * 7919 % 101, i, "x" * (i % 5)) for i in range(n)], "a int, b int, more string").repartition(7)
    got = sorted(((r.a is not None, r.a or 0, r.b), r.chunk) for r in dedup.chunks(df, ["a", "b"], 25).collect())
    assert [c for _, c in got] == [i // 25 + 1 for i in range(n)]


def test_routing_edges(spark):
    """No keywords, and keywords of more lengths than any bound."""
    signals = spark.createDataFrame([(1, "a b c", 0), (2, " ".join(f"w{i}" for i in range(90)), 0)], "item int, signal string, position int")
    none = spark.createDataFrame([], "folder string, keyword string, priority int")
    assert by(matching.route(signals, "item", "signal", "position", none), "item", "folder") == {1: None, 2: None}
    many = spark.createDataFrame([(f"f{n}", " ".join(f"w{i}" for i in range(n)), n) for n in range(1, 81)] + [("x", "b c", 99)], "folder string, keyword string, priority int")
    assert by(matching.route(signals, "item", "signal", "position", many), "item", "folder") == {1: "x", 2: "f80"}


def test_text_edges(spark):
    """Caps that used to cut, and numbers that used to crash."""
    word = "x" * 20_000
    deep = "A " + "(" * 40 + "b" + ")" * 40 + " B"
    cases = [
        (X.deslug(L(word)), "X" + word[1:]),
        (X.title_case(L(word)), "X" + word[1:]),
        (X.query_title(L(deep)), "A B"),
        (X.query_title(L("a [b) (c")), "a (c"),
        (X.seconds(L("9999999999:00")), 599999999940),
        (X.seconds(L("99999999999999999999:00")), None),
        (X.seconds(L("1.5:00")), None),
        (X.is_newer(L("99999999999.1"), L("99999999998.9")), True),
        (X.sanitize(L("a\tb. ")), "a\tb"),
        (X.playlist_id(L("https://x/playlist?list=LLabc")), "LLabc"),
        (X.playlist_id(L("https://x/playlist?list=ll")), None),
        (X.video_title(L("A – B (Official Video) | Label")), "A - B"),
        (X.video_title(L("Only title | Label")), "Only title | Label"),
        (nested.find_all(L('{"x": {"k": 1}, "k": {"k": 2}}'), "k"), ["1", '{"k": 2}', "2"]),
        (nested.find_all(L("[" * 100_000), "k"), []),
        (nested.ld_names(L(r'"@type": "MusicRecording", "name": "a é \"b\"" "@type":"MusicRecording","name":"bad \q"')), ['a é "b"', r"bad \q"]),
        (audio.bit_depth(L("pcm_24")), 24),
        (audio.bit_depth(L(None).cast("string")), 0),
        (staged.phrase(L(' a "b" ')), "a  b"),
    ]
    for i, (made, want) in enumerate(cases):
        assert spark.range(1).select(made.alias("v")).first()["v"] == want, i


def test_reports(spark):
    """A1's order, O6's remainder, U5's missing columns, O10's fixed choice, and bands without rows."""
    df = spark.createDataFrame([("HQ", 5), ("MAUVAIS", 5), ("HQ", 0), ("ERROR", 0)], "verdict string, size long")
    assert [tuple(r) for r in reports.counts_in_order(df, "verdict").collect()] == [(1, "HQ", 2), (3, "MAUVAIS", 1), (5, "ERROR", 1)]
    assert [tuple(r) for r in reports.health(df, "verdict", "size").collect()] == [("HQ", 2, 1), ("MAUVAIS", 1, 1), ("ERROR", 1, 0)]
    assert [tuple(r) for r in reports.first_rows(spark.range(5), ["id"], 2).collect()] == [(0, 3), (1, 3)]
    a, b = (reports.sampled(spark.range(1000).repartition(n), "id", 10, seed=3) for n in (2, 9))
    assert a.collect() == b.collect() and a.count() == 10
    bands = matching.by_band(spark.createDataFrame([], "score double, label string"))
    assert {tuple(r)[2:] for r in bands.collect()} == {(0, 0, 0, 0, None)} and bands.count() == 7
    assert "NestedLoop" not in bands._jdf.queryExecution().executedPlan().toString()
