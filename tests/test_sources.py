"""Sources and sinks: written, read back, and read from files as people make them."""

import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from tonearm.sources import readers, sinks


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def read_csv(folder):
    out = []
    for name in sorted(os.listdir(folder)):
        if name.endswith(".csv"):
            with open(f"{folder}/{name}", newline="", encoding="utf-8") as f:
                out += list(csv.DictReader(f))
    return out


def test_listings(spark, tmp_path):
    """Case, excluded folders at any depth, other files; names that Spark takes for hidden aren't listed."""
    deep = "/".join(["d"] * 12)
    for name in ("a.FLAC", "b.mp3", "c.txt", "sub/D.wav", "sub/Trash/e.flac", f"{deep}/f.aiff", f"{deep}/TRASH/x/g.flac", "trash.flac", "_hidden.flac", "_INBOX/h.flac", "noext"):
        put(tmp_path / name, "x" * len(name))
    names = lambda df: sorted(r.name for r in df.select("name").collect())
    root = f"file://{tmp_path}"
    assert names(readers.audio_files(spark, root)) == ["D.wav", "a.FLAC", "b.mp3", "e.flac", "f.aiff", "g.flac", "trash.flac"]
    found = readers.audio_files(spark, root, exclude=("trash",))
    assert names(found) == ["D.wav", "a.FLAC", "b.mp3", "f.aiff", "trash.flac"]
    assert names(readers.audio_files(spark, root, recursive=False)) == ["a.FLAC", "b.mp3", "trash.flac"]
    assert {r.ext: r.length for r in found.where("name = 'a.FLAC'").collect()} == {".flac": 6}
    os.utime(tmp_path / "b.mp3", (4e9, 4e9))
    assert names(readers.newest(readers.audio_files(spark, root))) == ["b.mp3"]
    made = spark.createDataFrame([("/m/Artist - Title.flac",), ("/n/ARTIST – title.mp3",), ("/m/junk.mp3",)], "path string")
    assert rows(readers.library_keys(made)) == [("artist - title",)]


def test_want_lists(spark, tmp_path):
    """A byte-order mark, quotes, line breaks, lengths of all kinds; a report's rows that weren't found."""
    head = "Artist,Title,Album,Length,Year,Source,SourceUrl\n"
    lengths = ["61", "3.7", "1e20", "x", "", "-5", "nan"]
    text = head + "".join(f'"A ""{i}"", B","T\n{i}",,{n},1999,s,u\n' for i, n in enumerate(lengths))
    got = readers.want_list(spark, put(tmp_path / "w.csv", text, "utf-8-sig")).orderBy("Title").collect()
    assert [r.Length for r in got] == [61, 3, None, None, None, -5, None]
    assert (got[0].Artist, got[0].Title) == ('A "0", B', "T\n0")
    assert rows(readers.want_list(spark, put(tmp_path / "none.csv", head))) == []
    report = put(tmp_path / "r.csv", "Action,ARTIST,title,note\nNOT_FOUND,a,b,\nREPLACED,c,d,\nNOT_FOUND,,e,\nNOT_FOUND,f,,\n")
    assert rows(readers.report_or_wants(spark, report)) == [("", "e"), ("a", "b")]
    assert rows(readers.report_or_wants(spark, put(tmp_path / "p.csv", "artist,Title\na,b\nc,\n"))) == [("a", "b")]


def test_indexes(spark, tmp_path):
    """Later files and later lines win, however the files are dealt."""
    head = "filepath,artist,title,length,state,failurereason\n"
    a = put(tmp_path / "a.csv", head + "/x,a,first,100,1,\n/y,a,y,-1,1,\n/x,a,second,1e20,1,\n,a,none,1,2,\n")
    b = put(tmp_path / "b.csv", head + "/y,b,later,3.9,1,\n" + "".join(f"/n{i},b,n,1,1,\n" for i in range(500)) + "/y,b,last,7,1,\n")
    indexes = [readers.download_index(spark, p, places=True) for p in (a, b)]
    got = {r.filepath: (r.title, r.length) for r in readers.merged_indexes(indexes).collect()}
    assert got["/x"] == ("second", None) and got["/y"] == ("last", 7) and len(got) == 502
    one = readers.download_index(spark, a)
    assert one.columns == ["filepath", "artist", "title", "length", "state", "failurereason"] and one.count() == 4


def test_maps_and_logs(spark, tmp_path):
    """S11, S13, S14, S15, O5."""
    listed = put(tmp_path / "l.csv", "Priorite;Tier;Dossier;Artiste;Titre;Fichier\n2;B;d;a;t2;f\n1;A;e;a;t1;f\n1;A;d;a;t3;f\n1e20;A;d;a;t4;f\n")
    assert [r.Titre for r in readers.to_replace(spark, listed).collect()] == ["t4", "t3", "t1", "t2"]
    one = {"dossier": "d", "origFile": "f", "priorite": "1", "tier": "A"}
    path = put(tmp_path / "m.json", json.dumps({"Artist - T": one, "B - U": {**one, "dossier": "e"}}, indent=2))
    assert rows(readers.routing_map(spark, path).select("key", "dossier")) == [("artist - t", "d"), ("b - u", "e")]
    log = spark.createDataFrame([("x Not found: A - B  ",), ("All downloads failed: c - D",), ("Not found: a - b",), ("fine",), ("Fake/Suspicious: 12",), ("Fake/Suspicious:  3 files",)], "value string")
    assert rows(readers.missed_keys(log)) == [("a - b",), ("c - d",)]
    assert readers.fake_count(log).first().fakes == 15


def test_csv_sinks(spark, tmp_path):
    """Field order, empty cells, booleans, quotes and line breaks; a log that grows."""
    df = spark.createDataFrame([(1, True, 'a "b", c', None), (2, False, "x\ny", 2.5), (3, None, "", 0.0)], "id int, done boolean, text string, score double")
    out = str(tmp_path / "out")
    fields = ("text", "id", "missing", "done", "score")
    sinks.write_csv(df, out, fields)
    got = sorted(read_csv(out), key=lambda r: r["id"])
    assert [list(r) for r in got] == [list(fields)] * 3
    assert [tuple(r.values()) for r in got] == [('a "b", c', "1", "", "1", ""), ("x\ny", "2", "", "0", "2.5"), ("", "3", "", "", "0.0")]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_csv(df, out, fields)
    sinks.append_log(df.where("id = 1"), out, fields)
    assert len(read_csv(out)) == 4
    wants = spark.createDataFrame([("A, B", 'T "x"', None, 61, 1999, "s", "u")], "Artist string, Title string, Album string, Length int, Year int, Source string, SourceUrl string")
    sinks.write_csv(wants, str(tmp_path / "w"), sinks.WANTS)
    back = readers.want_list(spark, str(tmp_path / "w")).first()
    assert (back.Artist, back.Title, back.Length, back.Year) == ("A, B", 'T "x"', 61, "1999")


@pytest.mark.parametrize("n", [0, 1, 57])
def test_json_is_one_array(spark, tmp_path, n):
    """K2: the files, put together by name, are the array in order."""
    df = spark.createDataFrame([(i % 7, i, None if i % 3 else "é\n") for i in range(n)], "a int, b int, t string").repartition(5)
    out = str(tmp_path / "j")
    sinks.write_json(df, out, ["a", "b"])
    text = "".join(open(f"{out}/{f}", encoding="utf-8").read() for f in sorted(os.listdir(out)) if f.startswith("part"))
    assert [(r["a"], r["b"], r["t"]) for r in json.loads(text)] == sorted((i % 7, i, None if i % 3 else "é\n") for i in range(n))


def test_pages_and_maps(spark):
    """Each track once, escaped; the first of each key."""
    t = spark.createDataFrame([(2, "A ", "x<y", "NOT_FOUND"), (1, "a", " X<Y", "NOT_FOUND"), (3, "", "Solo & co", "NOT_FOUND"), (4, "b", "", "NOT_FOUND"), (5, "c", "d", "REPLACED")], "i int, artist string, title string, action string")
    links = sinks.unfindable(t, ["i"])
    assert rows(links.select("artist", "title")) == [("", "Solo & co"), ("a", " X<Y")]
    cards = sorted(r.value for r in sinks.buy_cards(links).collect())
    assert cards[0].startswith("<p><b>?</b> Solo &amp; co <a href=\"https://www.discogs.com/search/?q=Solo+%26+co&amp;type=release\"") and "X&lt;Y" in cards[1]
    m = spark.createDataFrame([(1, "K", "first", "f", "1", "A"), (2, "k", "second", "f", "1", "A")], "i int, key string, dossier string, origFile string, priorite string, tier string")
    (one,) = sinks.routing_json(m, ["i"]).collect()
    assert one.key == "k" and json.loads(one.value)["dossier"] == "first"


def test_cache(spark):
    """A cached miss is a hit without a value."""
    from tonearm.functions import text as X

    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "q string")
    cache = asked.where("q <> 'c'").select(X.cache_key(F.col("q")).alias("cache_key"), F.when(F.col("q") == "a", "v").alias("value"))
    assert rows(sinks.cached(asked, cache, "q")) == [("a", "v", True), ("b", None, True), ("c", None, False)]
