"""Files listed by Spark's data source, and windows of WAV files by ranged reads."""

import io
import os
import struct
import wave

import numpy as np
from pyspark.sql import functions as F

from tonearm.functions import audio
from tonearm.sources import listing


def test_folders_and_pruning(spark, tmp_path, monkeypatch):
    """Names with a dot or an underscore, excluded folders at any depth, links, kinds in any case; any number of tasks gives the same."""
    deep = "/".join(["d"] * 6)
    names = ["a.FLAC", "_b.mp3", ".c.wav", "n.txt", "_INBOX/e.mp3", ".hid/f.ogg", "sub/Trash/x.flac", f"{deep}/g.aiff", f"{deep}/TRASH/y/z.flac", "trash.flac", *(f"many/{i}/t{i}.mp3" for i in range(30))]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x" * len(n))
    os.symlink(tmp_path / "sub", tmp_path / "many/link")
    want = {n for n in names if not n.endswith(".txt") and "trash/" not in n.lower()}
    for tasks in (1, 3, 50):
        df = listing.listed(spark, str(tmp_path), ("trash",), tasks=tasks)
        got = {os.path.relpath(r.path, tmp_path): r for r in df.collect()}
        assert set(got) == want and all(r.length == len(n) and r.name == n.split("/")[-1] for n, r in got.items()) and got["a.FLAC"].ext == ".flac"
    assert {r.name for r in listing.listed(spark, f"file://{tmp_path}", recursive=False).collect()} == {"a.FLAC", "_b.mp3", ".c.wav", "trash.flac"}
    assert listing.listed(spark, str(tmp_path / "gone")).collect() == []
    os.utime(tmp_path / "a.FLAC", (1e9, 1e9))
    assert df.where("name = 'a.FLAC'").select(F.col("modificationTime").cast("long").alias("t")).first().t == 10**9


def test_kinds_and_sizes(spark, tmp_path):
    for n in range(6):
        (tmp_path / f"{n}.{'mp3' if n % 2 else 'FLAC'}").write_bytes(b"x" * n)
    found = lambda **kwargs: {r.length for r in listing.listed(spark, str(tmp_path), **kwargs).collect()}
    assert found(kinds=(".MP3",)) == {1, 3, 5} and found(kinds=(".mp3", ".x"), least=2) == {3, 5} and found(most=0) == {0} and found(least=2, most=4) == {2, 3, 4}
    df = listing.listed(spark, str(tmp_path))
    for condition, want in {"ext = '.mp3'": {1, 3, 5}, "ext = '.mp3' or length = 0": {0, 1, 3, 5}, "length > 3": {4, 5}}.items():
        assert {r.length for r in df.where(condition).collect()} == want, condition


def test_windows_of_large_files(spark, tmp_path):
    """Windows equal those of the whole file; a sparse file of 3 GB takes no longer; broken files say why."""
    r = np.random.default_rng(1)
    x = (r.standard_normal((8000, 2)) * 3000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(1000)
        w.writeframes(x.tobytes())
    whole = (tmp_path / "a.wav").read_bytes()
    large = tmp_path / "large.wav"
    with open(large, "wb") as f:  # another chunk before the samples, and a length that is too large
        f.write(b"RIFF" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + b"LIST" + struct.pack("<I", 5) + b"abcde\0" + whole[12:36] + b"data" + struct.pack("<I", 0xFFFFFFFF))
        f.seek((3 << 30) + 2)
        f.write(x.tobytes())
    (tmp_path / "cut.wav").write_bytes(whole[:30])
    (tmp_path / "no.wav").write_bytes(b"ID3")
    at = ((3 << 30) + 2 - 58) // 4 / 1000 + 1e-7
    rows = [("a.wav", 0.0, 1.0), ("a.wav", 2.5, 0.5), ("a.wav", 7.5, 9.0), ("a.wav", 99.0, 1.0), ("large.wav", at, 2.0), ("cut.wav", 0.0, 1.0), ("no.wav", 0.0, 1.0), ("gone.wav", 0.0, 1.0)]
    df = spark.createDataFrame([(i, str(tmp_path / n), s, d) for i, (n, s, d) in enumerate(rows)] + [(8, None, 0.0, 1.0)], "i int, path string, start double, seconds double")
    got = {q.i: q for q in listing.wav_windows(df).collect()}
    for i, (n, s, d) in enumerate(rows[:4]):
        rate, samples = audio.read_wav(bytes(got[i].content))
        assert rate == 1000 and np.array_equal(samples, audio.read_wav(whole, s, d)[1]), (n, s)
    assert np.array_equal(audio.read_wav(bytes(got[4].content))[1], audio.read_wav(whole, 0.0, 2.0)[1])
    assert all(got[i].content is None and got[i].error for i in (5, 6, 7, 8))
    info = {q.path.split("/")[-1]: q for q in listing.wav_info(df.where("i in (0, 4, 5)").select("path")).collect()}
    assert (info["a.wav"].samplerate, info["a.wav"].channels, info["a.wav"].frames, info["a.wav"].duration) == (1000, 2, 8000, 8.0)
    assert info["large.wav"].frames > 8e8 and info["cut.wav"].error
    assert io.BytesIO(bytes(got[0].content)).read(4) == b"RIFF"


def test_features_by_ranges(spark, tmp_path):
    """The same features as from whole contents, also of a long file with three windows."""
    r = np.random.default_rng(3)
    for name, seconds in (("short", 3), ("long", 100)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
            w.writeframes((r.standard_normal((8000 * seconds, 2)) * 3000).astype("<i2").tobytes())
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    files = listing.listed(spark, str(tmp_path))
    made = {q.name: q for q in listing.wav_features(files).collect()}
    whole = spark.createDataFrame([(n, bytes((tmp_path / n).read_bytes())) for n in made], "name string, content binary")
    for name, f in whole.select("name", audio.wav_features(F.col("content")).alias("f")).collect():
        got = made[name].asDict()
        if name == "bad.wav":
            assert got["error"] and f.error
        else:
            assert {k: got[k] for k in f.asDict()} == f.asDict() and got["error"] is None, name
