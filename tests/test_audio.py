"""Tags and headers of files made here, resampling, and classes by a model that is passed in."""

import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.functions import audio, tags


def wav(x, rate=44100, more=b""):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.stack([x, x], 1), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue() + more


def safe(n):
    return bytes(n >> 7 * i & 127 for i in (3, 2, 1, 0))


def id3(version, *frames):
    size = safe if version == 4 else (lambda n: n.to_bytes(3 if version == 2 else 4, "big"))
    body = b"".join(name + size(len(c)) + (b"" if version == 2 else b"\0\0") + c for name, c in frames) + b"\0" * 20
    return b"ID3" + bytes([version, 0, 0]) + safe(len(body)) + body


def flac(comments, rate=44100, samples=441000, channels=2):
    info = bytes(10) + (rate << 44 | (channels - 1) << 41 | 15 << 36 | samples).to_bytes(8, "big") + bytes(16)
    own = [f"{k}={v}".encode() for k, v in comments]
    block = struct.pack("<I", 3) + b"enc" + struct.pack("<I", len(own)) + b"".join(struct.pack("<I", len(c)) + c for c in own)
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x84" + len(block).to_bytes(3, "big") + block + b"\xff\xf8" + bytes(100)


def atom(name, *parts):
    body = b"".join(parts)
    return (8 + len(body)).to_bytes(4, "big") + name + body


MP3 = b"\xff\xfb\x90\x00" + bytes(16000 - 4)  # 128 kbit/s, 44.1 kHz, stereo: one second
M4A = atom(b"ftyp", b"M4A ") + atom(b"moov", atom(b"udta", atom(b"meta", bytes(4), atom(b"ilst", atom(b"\xa9ART", atom(b"data", bytes(8), " É ".encode())), atom(b"\xa9nam", atom(b"data", bytes(8), b"T"))))))
V23 = id3(3, (b"TPE1", b"\x01" + "Ärt".encode("utf-16")), (b"TIT2", b"\x03Title\0Second"), (b"APIC", bytes(50)), (b"TCON", b"\x00House "))
FILES = {
    "flac": (flac([("ARTIST", " A "), ("artist", "B"), ("Title", "Tü"), ("GENRE", "")]), ("A", "Tü", None, None)),
    "v2.3": (V23 + MP3, ("Ärt", "Title", None, "House")),
    "v2.4": (id3(4, (b"TALB", b"\x03" + b"x" * 300)) + MP3, (None, None, "x" * 300, None)),
    "v2.2": (id3(2, (b"TT2", b"\x00Old")) + MP3, (None, "Old", None, None)),
    "v1": (MP3 + b"TAG" + b"T1".ljust(30, b"\0") + b"A1".ljust(30, b"\0") + bytes(65), ("A1", "T1", None, None)),
    "m4a": (M4A, ("É", "T", None, None)),
    "wav": (wav(np.zeros(44100), more=b"id3 " + struct.pack("<I", len(V23)) + V23), ("Ärt", "Title", None, "House")),
    "cut": (flac([("ARTIST", "A")])[:60], (None,) * 4),
    "none": (b"", (None,) * 4),
    "null": (None, (None,) * 4),
    "noise": (np.random.default_rng(0).bytes(5000), (None,) * 4),
}


def test_tags(spark):
    """Each format, broken files, no file."""
    df = spark.createDataFrame([(k, v[0]) for k, v in FILES.items()], "name string, content binary")
    got = {r.name: tuple(r.t) for r in df.select("name", tags.read_tags(F.col("content")).alias("t")).collect()}
    assert got == {k: v[1] for k, v in FILES.items()}


def test_headers(spark):
    """S5."""
    vbr = b"\xff\xfb\x90\x00" + bytes(32) + b"Xing" + b"\0\0\0\x01" + (1000).to_bytes(4, "big") + bytes(8000)
    rows = [(k, FILES[k][0]) for k in ("flac", "v2.3", "wav", "none", "null")] + [("vbr", vbr)]
    df = spark.createDataFrame(rows, "name string, content binary")
    got = {r.name: r.h for r in df.select("name", tags.open_info(F.col("content")).alias("h")).collect()}
    assert (got["flac"].samplerate, got["flac"].channels, got["flac"].duration, got["flac"].codec) == (44100, 2, 10.0, "flac")
    assert (got["v2.3"].container_bitrate, got["v2.3"].channels, round(got["v2.3"].duration, 3)) == (128, 2, 1.0)
    assert (got["wav"].samplerate, got["wav"].duration, got["wav"].container_bitrate, got["wav"].codec) == (44100, 1.0, 1411, "pcm_s16le")
    assert round(got["vbr"].duration, 2) == round(1000 * 1152 / 44100, 2) and got["none"].error and got["null"].error


@pytest.mark.parametrize(("rate", "to"), [(44100, 16000), (48000, 16000), (8000, 16000), (16000, 16000)])
def test_resampling(rate, to):
    """A tone below both Nyquist frequencies stays, one above the lower goes."""
    t = np.arange(rate) / rate
    made = audio.resample(np.sin(2 * np.pi * 1000 * t), rate, to)
    want = np.sin(2 * np.pi * 1000 * np.arange(len(made)) / to)
    assert len(made) == to and np.abs(made - want)[200:-200].max() < 0.01
    if rate > to:
        assert np.abs(audio.resample(np.sin(2 * np.pi * 12000 * t), rate, to))[200:-200].max() < 0.02


def test_classes(spark):
    """The highest means over the patches, by a session that is opened in the task; broken and short files."""
    rng = np.random.default_rng(1)
    files = [("a", wav(rng.standard_normal(6 * 44100) * 0.1)), ("bad", b"x"), ("short", wav(np.zeros(100)))]
    df = spark.createDataFrame(files, "name string, content binary")

    def session():
        return lambda patches: np.tile([0.5, 0.07, 0.9, 0.08], (len(patches), 1))

    got = {r.name: r.classes for r in audio.classify(df, "content", ["A", "B", "C", "D"], session).collect()}
    assert [(c.label, round(c.p, 6)) for c in got["a"]] == [("C", 0.9), ("A", 0.5), ("D", 0.08)] and got["bad"] == got["short"] == []
    assert all(r.classes is None for r in audio.classify(df, "content", [], lambda: None).collect())
    assert audio.mel_patches(audio.resample(rng.standard_normal(6 * 44100), 44100)).shape == (2, 128, 96)


def test_artifacts_are_gated():
    """Costly detectors are asked only after an anchor; failures find nothing."""
    x, asked = np.random.default_rng(3).standard_normal((8192, 2)), []
    costly = lambda s, r: asked.append(1) or 12
    assert audio.artifact_signals(x, 44100, preecho=costly) == {"aliasing": 0.0, "comb": False, "preecho": 0.0, "stereo": 0.0} and not asked
    assert audio.artifact_signals(x, 44100, aliasing=lambda s, r: 0.5, comb=lambda s, r: 1 / 0, preecho=costly)["preecho"] == 0.0 and not asked
    got = audio.artifact_signals(x, 44100, comb=lambda s, r: True, preecho=costly)
    assert got["preecho"] == 12.0 and asked and got["stereo"] == audio.stereo_collapse(x, 44100)
