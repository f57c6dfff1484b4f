"""Golden cases of names, titles, verdicts and sound."""

import io
import wave

import numpy as np
from pyspark.sql import functions as F

from tonearm.functions import audio, nested
from tonearm.functions import classify as C
from tonearm.functions import text as X
from tonearm.operators.dedup import unique_targets
from tonearm.plans import flows

L = F.lit


def cases():
    return [
        (X.loose_tokens(L("2 ME")), ["2", "me"]),
        (X.fold(L("Él niño ﬁ Čo")), "El nino ﬁ Co"),
        (X.normalize(L("Various Artists"), L("Zumo - Iamthecomputer")), ("Zumo", "Iamthecomputer")),
        (X.normalize(L("ildec"), L("A1 ildec - Voice From Nowhere")), ("ildec", "Voice From Nowhere")),
        (X.normalize(L("VA"), L("B2 Maua - Sirens")), ("Maua", "Sirens")),
        (X.search_title(L("Thirtyfive [Circus Company, 2009]")), "Thirtyfive"),
        (X.search_title(L("I Want You (Original Version) (1996)")), "I Want You (Original Version)"),
        (X.display(L("Premiere"), L("Jeff Mills - The Bells")), ("Jeff Mills", "The Bells")),
        (X.display(L("Premiere_ Floorplan"), L("Never Grow Old")), ("Floorplan", "Never Grow Old")),
        (X.resolve(L("am-dl-x-y-z.mp3"), L("Tibor Tury"), L("John Kano - Havana  Funk (Percussion Mix) (1997)")), ("John Kano", "Havana Funk (Percussion Mix)", "title-tag", True)),
        (X.resolve(L("john-kano-havana-funk.mp3"), L(None).cast("string"), L(None).cast("string")), ("", "John Kano Havana Funk", "deslug", False)),
        (X.track_pair(X.track_line(L("1. 03:45 Artist Two - Track Two"))), ("Artist Two", "Track Two")),
        (X.track_pair(X.track_line(L("808 State - Pacific"))), ("808 State", "Pacific")),
        (X.track_pair(X.track_line(L("50 Cent - In Da Club"))), ("50 Cent", "In Da Club")),
        (X.strip_catalog(L("Last (BASENOTIC)")), "Last"),
        (X.strip_catalog(L("Track (Part II)")), "Track (Part II)"),
        (X.strip_catalog(L("Letna Disko*")), "Letna Disko"),
        (X.strip_catalog(L("Buzz Time (1996) (Edited)")), "Buzz Time (Edited)"),
        (X.query_title(L("Whater You Want ((Innershades Remix))")), "Whater You Want"),
        (X.sanitize(L("a/b:c?.mp3")), "a_b_c_.mp3"),
        (X.sanitize(L("Trailing dot.")), "Trailing dot"),
        (X.playlist_id(L("https://x/watch?v=abc&list=PLxxx")), None),
        (X.playlist_id(L("https://x/playlist?list=OL12345")), "OL12345"),
        (X.is_newer(L("0.2.10"), L("0.2.9")), True),
        (X.is_newer(L("garbage"), L("0.2.9")), False),
        (X.seconds(L("1:02:03")), 3723),
        (X.seconds(L("x:1")), None),
        (C.band(L(19000.0), L(192))["verdict"], "HQ"),
        (C.accepted(L("HQ"), L("lossless_container"), L(1000), L("medium"), L(19000.0), "audiophile"), False),
        (C.accepted(L("HQ"), L("lossless_container"), L(1000), L("medium"), L(19000.0)), True),
        (C.accepted(L("HQ"), L("lossy"), L(192), L("medium"), L(19000.0)), False),
        (C.accepted(L("LOSSLESS"), L("lossless_container"), L(900), L("suspect"), L(22050.0)), False),
        (C.reject_reason(L("DJ Schema"), L("2 ME"), L("Theo Meier - Schema (T.M.A Remix).flac"), L(300), L(True)), "WRONG_MATCH"),
        (C.reject_reason(L("Bedouin"), L("Safari"), L("Bedouin - Safari (Pete Tong Remix).flac"), L(300), L(True)), "WRONG_MATCH"),
        (C.reject_reason(L("Bedouin"), L("Safari"), L("Bedouin - Safari.flac"), L(61), L(True)), "TOO_SHORT"),
        (nested.find_all(L('{"a": {"k": 1, "b": [{"k": {"k": 2}}]}}'), "k"), ["1", '{"k": 2}', "2"]),
    ]


def test_golden(spark):
    for i, (made, want) in enumerate(cases()):
        got = spark.range(1).select(made.alias("v")).first()["v"]
        assert (tuple(got) if isinstance(want, tuple) else got) == want, (i, want)


def test_forensic_is_never_below_the_plain_verdict(spark):
    grid = [(float(c), k, s) for c in range(13000, 22500, 1000) for k in (100, 400, 700, 900, 1100) for s in (0.0, 50.0, 300.0)]
    df = spark.createDataFrame(grid, "cutoff double, kbps int, std double")
    est = F.when(F.col("cutoff") >= 21500, 0).otherwise(320)
    args = (F.col("cutoff"), est, F.col("kbps"), L(".flac"))
    f = C.forensic(*args, L(44100), L(None).cast("int"), L(True), L(0.7), L(True), L(0.0), L(0.0))
    rank = {"LOSSLESS": 3, "HQ": 2, "DOUTEUX": 1, "MAUVAIS": 0}
    for r in df.select(C.classify_lossless(*args)["verdict"].alias("a"), f["verdict"].alias("b")).collect():
        assert rank[r.b] >= rank[r.a]


def test_names_that_hold_numbers_already(spark):
    df = spark.createDataFrame([("d", "a.mp3", "1"), ("d", "a (1).mp3", "2"), ("d", "A.mp3", "3")], "folder string, name string, o string")
    assert [r.target for r in unique_targets(df, "folder", "name", "o").orderBy("o").collect()] == ["a.mp3", "a (1).mp3", "A (2).mp3"]


def test_label_matches(spark):
    rows = [("Aphex Twin", "Xtal (Remix)", "Aphex Twin", "Xtal"), ("T", "Uforic Undulance", "T", "Uforic Undulence"), ("A", "B", None, None)]
    got = flows.label_matches(spark.createDataFrame(rows, "known_artist string, known_title string, cand_artist string, cand_title string"))
    assert {r.known_title: r.label for r in got.collect()} == {"Xtal (Remix)": "diff-version", "Uforic Undulance": "correct", "B": "no-match"}


def wav(x, rate=44100):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.stack([x, x], 1), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_spectra(spark):
    noise = np.random.default_rng(1).standard_normal(4 * 44100) * 0.1

    def walled(hz):
        f = np.fft.rfft(noise)
        f[np.fft.rfftfreq(len(noise), 1 / 44100) > hz] = 0
        return np.fft.irfft(f, len(noise))

    tone = 0.2 * np.sin(2 * np.pi * 440 * np.arange(2 * 44100) / 44100)
    files = [("full", wav(noise)), ("tone", wav(tone)), ("15", wav(walled(15000))), ("18", wav(walled(18600))), ("20", wav(walled(20000))), ("21", wav(walled(21200))), ("bad", b"no wav")]
    df = spark.createDataFrame(files, "name string, content binary").select("name", audio.wav_features(F.col("content")).alias("f"))
    got = {r.name: r for r in df.select("name", "f.*", C.band(F.col("f.cutoff_hz"), F.col("f.est_source_bitrate"))["verdict"].alias("verdict")).collect()}
    assert {k: v.verdict for k, v in got.items() if k != "bad"} == {"full": "LOSSLESS", "tone": "LOSSLESS", "15": "MAUVAIS", "18": "HQ", "20": "HQ", "21": "HQ"}
    assert got["bad"].error
