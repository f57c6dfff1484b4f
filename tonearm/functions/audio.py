"""Audio: WAV headers and windows and spectral features; Arrow functions over binary columns.

The reference measures cutoffs with a package that isn't part of it; the detector here is our own, made to satisfy the
cases that are known of that one: full-band noise and a pure tone are LOSSLESS, hard walls at 13 to 21.2 kHz are found.
"""

from __future__ import annotations

import io
import math
import wave
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

FEATURES = "samplerate int, channels int, duration double, frames long, cutoff_hz double, cutoff_std_hz double, hf_energy_ratio double, est_source_bitrate int, stereo double, error string"


@lru_cache(maxsize=8)
def _hann(n: int) -> np.ndarray:
    return np.hanning(n)


def windows(duration: float, long_file: float = 90.0, window: float = 30.0) -> list[tuple[float, float]]:
    """Start and length of the measured windows: one, or three of at most 30 s spread over a long file."""
    n = 3 if duration > long_file else 1
    length = min(window, duration / n)
    return [(max(0.0, min(duration * (i + 1) / (n + 1) - length / 2, duration - length)), length) for i in range(n)]


def read_wav(data: bytes, start: float | None = None, length: float | None = None) -> tuple[int, np.ndarray]:
    """Rate and samples (frames x channels, -1 to 1) of a PCM WAV, or of a window of it."""
    with wave.open(io.BytesIO(data)) as w:
        rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
        if start is not None:
            w.setpos(min(int(start * rate), w.getnframes()))
        raw = w.readframes(w.getnframes() if length is None else int(length * rate))
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) / 2.0**31
    else:
        x = np.frombuffer(raw, {1: np.uint8, 2: np.int16, 4: np.int32}[width]).astype(np.float64)
        x = (x - 128) / 128 if width == 1 else x / 2.0 ** (8 * width - 1)
    return rate, x.reshape(-1, channels)


def cutoff(samples: np.ndarray, rate: int) -> tuple[float, float] | None:
    """The frequency of the highest wall in the spectrum, else the Nyquist frequency, and the share of energy above 16 kHz.

    A wall is where the mean level over 500 Hz falls by 25 dB or more against the 500 Hz below while the level below
    still is a band of noise, not of single tones; levels are in dB of the Hann-windowed spectrum of the mono mix.
    """
    mono = samples.mean(1)
    if len(mono) < 256:
        return None
    size = 8192 if len(mono) >= 8192 else 256
    frames = mono[: len(mono) // size * size].reshape(-1, size) * _hann(size)
    power = (np.abs(np.fft.rfft(frames, axis=1)) ** 2).mean(0) + 1e-14
    freq = np.fft.rfftfreq(size, 1 / rate)
    high = float(power[freq >= 16000].sum() / power.sum())
    step = 250.0
    edges = np.arange(1000, rate / 2 - step, step)
    level = np.array([10 * np.log10(power[(freq >= e) & (freq < e + step)].mean()) for e in edges])
    flat = np.array([np.exp(np.log(power[(freq >= e) & (freq < e + step)]).mean()) / power[(freq >= e) & (freq < e + step)].mean() for e in edges])
    floor = 10 * np.log10(power.max()) - 60
    walls = [e + step for i, e in enumerate(edges[:-2]) if level[i] > floor and flat[i] > 0.3 and level[i] - level[i + 2] >= 25 and (level[i + 2 :] < level[i] - 20).all()]
    return (float(max(walls)) if walls else rate / 2), high


def source_bitrate(hz: float) -> int:
    """D3: 0 for a full spectrum, else the MP3 bitrate whose low-pass is the nearest at or above."""
    for top, kbps in ((16000, 128), (19000, 192), (20000, 256), (21500, 320)):
        if hz < top:
            return kbps
    return 0


def stereo_collapse(samples: np.ndarray, rate: int) -> float:
    """How much narrower the treble (10-16 kHz) is than the middle (1-5 kHz), 0 to 1; 0 where that can't be told."""
    if samples.shape[1] < 2 or len(samples) < 4096:
        return 0.0
    h = _hann(len(samples))
    freq = np.fft.rfftfreq(len(samples), 1 / rate)
    mid, side = (np.abs(np.fft.rfft((samples[:, 0] + sign * samples[:, 1]) / 2 * h)) ** 2 for sign in (1, -1))
    share = lambda a, b: side[(freq >= a) & (freq < b)].sum() / (mid[(freq >= a) & (freq < b)].sum() + 1e-12)
    middle = share(1000, 5000)
    return 0.0 if middle < 0.05 else float(max(0.0, 1 - share(10000, 16000) / middle))


def artifact_signals(samples: np.ndarray, rate: int, aliasing=None, comb=None, preecho=None) -> dict[str, float | bool]:
    """Aliasing, comb, preecho, stereo of a window, by detectors that are passed in (none: nothing is found); what fails finds nothing.

    The costly ones, pre-echo and stereo, are only asked if aliasing (above 0.5) or a comb was found: without one of these
    they decide nothing.
    """

    def ask(f, nothing):
        try:
            return nothing if f is None else type(nothing)(f(samples, rate))
        except Exception:  # a detector's failure is no finding
            return nothing

    out = {"aliasing": ask(aliasing, 0.0), "comb": ask(comb, False), "preecho": 0.0, "stereo": 0.0}
    if out["aliasing"] > 0.5 or out["comb"]:
        out |= {"preecho": ask(preecho, 0.0), "stereo": ask(stereo_collapse, 0.0)}
    return out


def aggregate_windows(cutoffs: list[float], shares: list[float]) -> tuple[float, float, float]:
    """The highest cutoff (the first of equal ones), the deviation over windows, and that window's treble share."""
    best = int(np.argmax(cutoffs))
    return cutoffs[best], float(np.std(cutoffs)) if len(cutoffs) > 1 else 0.0, shares[best]


def measured(rate: int, channels: int, frames: int, window) -> tuple:
    """FEATURES of a file of so many frames; window(start, length) gives the samples of each of its windows. A window that is too short is passed over."""
    found = []
    for start, length in windows(frames / rate):
        x = window(start, length)
        got = cutoff(x, rate)
        if got:
            found.append((*got, stereo_collapse(x, rate)))
    if not found:
        return rate, channels, frames / rate, frames, None, None, None, None, None, "no window"
    hz, dev, share = aggregate_windows([f[0] for f in found], [f[1] for f in found])
    return rate, channels, frames / rate, frames, round(hz, 1), round(dev, 1), round(share, 6), source_bitrate(hz), max(f[2] for f in found), None


def _features(content: pd.Series) -> pd.DataFrame:

    def one(data: bytes) -> tuple:
        try:
            with wave.open(io.BytesIO(data)) as w:
                rate, channels, frames = w.getframerate(), w.getnchannels(), w.getnframes()
            return measured(rate, channels, frames, lambda start, length: read_wav(data, start, length)[1])
        except Exception as e:  # any broken file becomes a row with its error
            return (*[None] * 9, f"{type(e).__name__}: {e}")

    return pd.DataFrame([one(x) for x in content], columns=[x.split()[0] for x in FEATURES.split(", ")])


def wav_features(content: Column) -> Column:
    """S5, D1-D4 of WAV files; a file that can't be read has only an error."""
    return pandas_udf(_features, FEATURES)(content)


#: Bits of a sample by the name of its format.
BITS = {"PCM_S8": 8, "PCM_U8": 8, "PCM_16": 16, "PCM_24": 24, "PCM_32": 32, "FLOAT": 32, "DOUBLE": 64, "ALAC_16": 16, "ALAC_24": 24, "ALAC_32": 32}


def bit_depth(subtype: Column) -> Column:
    """0 if unknown."""
    table = F.create_map(*(F.lit(v) for pair in BITS.items() for v in pair))
    return F.coalesce(F.try_element_at(table, F.upper(F.coalesce(subtype, F.lit("")))), F.lit(0))


def mel_bank(bands: int = 96, rate: int = 16000, size: int = 512) -> np.ndarray:
    """Slaney's filter bank (linear to 1 kHz, logarithmic above; areas of one)."""
    step = np.log(6.4) / 27
    to_hz = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp(step * (m - 15)))
    top = 15 + np.log(rate / 2 / 1000) / step
    edge = to_hz(np.linspace(0, top, bands + 2))
    freq = np.fft.rfftfreq(size, 1 / rate)
    up = (freq[None] - edge[:-2, None]) / np.diff(edge)[:-1, None]
    down = (edge[2:, None] - freq[None]) / np.diff(edge)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edge[2:] - edge[:-2]))[:, None]


def mel_patches(mono: np.ndarray, size: int = 512, hop: int = 256, patch: int = 128) -> np.ndarray:
    """Log-mel patches (n, 128, 96) of 16 kHz samples."""
    if len(mono) < size:
        return np.zeros((0, patch, 96), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(mono, size)[::hop] * _hann(size)
    mel = np.log10(1 + 10000 * (np.abs(np.fft.rfft(frames, axis=1)) ** 2 @ mel_bank().T)).astype(np.float32)
    return mel[: len(mel) // patch * patch].reshape(-1, patch, 96)


def resample(mono: np.ndarray, rate: int, to: int = 16000, taps: int = 32) -> np.ndarray:
    """Samples at another rate: a Hann-windowed sinc low-pass at the lower of both Nyquist frequencies, one filter for each phase."""
    if rate == to or not len(mono):
        return mono.astype(np.float64)
    common = math.gcd(rate, to)
    up, down = to // common, rate // common
    cut = min(1.0, up / down)
    half = int(np.ceil(taps / cut))
    n = -(-len(mono) * up // down)
    place = np.arange(n) * down
    whole, phase = place // up, place % up
    offsets = np.arange(-half, half + 1)
    out, padded = np.empty(n), np.pad(mono.astype(np.float64), half)
    for p in np.unique(phase):
        t = offsets - p / up
        kernel = cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / (half + 1), -1, 1)))
        own = np.flatnonzero(phase == p)
        windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)[whole[own]]
        out[own] = windows @ (kernel / kernel.sum())
    return out


def middle(samples: np.ndarray, rate: int, seconds: float = 120.0) -> np.ndarray:
    """The middle of a file, as one channel."""
    n = min(len(samples), int(seconds * rate))
    first = (len(samples) - n) // 2
    return samples[first : first + n].mean(1)


def classify(df: DataFrame, content: str, labels: list[str], open_session, least: float = 0.08, top: int = 6) -> DataFrame:
    """Df without its contents, with classes: label and p of the highest mean activations over a file's patches.

    open_session() runs once for each task and gives a function from patches (n, 128, 96) to activations (n, labels), such
    as a model's session; null: there is none. A file that can't be read, or is shorter than a patch, has no classes.
    """
    rest = [c for c in df.columns if c != content]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField("classes", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("p", T.DoubleType())])))])

    def run(frames):
        session = open_session()

        def one(data: bytes) -> list[dict] | None:
            if session is None:
                return None
            try:
                rate, x = read_wav(data)
            except Exception:  # any broken file has no classes
                return []
            patches = mel_patches(resample(middle(x, rate), rate))
            if not len(patches):
                return []
            p = np.asarray(session(patches), np.float64).mean(0)
            return [{"label": labels[i], "p": float(p[i])} for i in np.argsort(-p, kind="stable")[:top] if p[i] >= least]

        for frame in frames:
            yield frame[rest].assign(classes=[one(x) for x in frame[content]])

    return df.mapInPandas(run, schema)
