"""Tags and headers of audio files, read from their bytes: FLAC, MP3, WAV, AIFF and MP4; Arrow functions over binary columns."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

TAGS = ("artist", "title", "album", "genre")
# How the formats name these tags.
ID3 = {b"TPE1": "artist", b"TIT2": "title", b"TALB": "album", b"TCON": "genre", b"TP1": "artist", b"TT2": "title", b"TAL": "album", b"TCO": "genre"}
ATOMS = {b"\xa9ART": "artist", b"\xa9nam": "title", b"\xa9alb": "album", b"\xa9gen": "genre"}
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")
MP3_KBPS = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
MP3_RATES = (44100, 48000, 32000)


def _vorbis(block: bytes) -> dict[str, str]:
    at = 4 + struct.unpack_from("<I", block)[0]
    (n,) = struct.unpack_from("<I", block, at)
    out, at = {}, at + 4
    for _ in range(n):
        (size,) = struct.unpack_from("<I", block, at)
        name, _, value = block[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        out.setdefault(name.lower(), value)
        at += 4 + size
    return out


def flac_blocks(data: bytes) -> Iterator[tuple[int, bytes]]:
    at, last = 4, False
    while not last and at + 4 <= len(data):
        last, kind, size = data[at] >= 128, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        yield kind, data[at + 4 : at + 4 + size]
        at += 4 + size


def _synchsafe(b: bytes) -> int:
    return sum((x & 127) << 7 * i for i, x in enumerate(reversed(b)))


def _id3(data: bytes) -> dict[str, str]:
    """Text frames of an ID3v2 tag, the first value of each."""
    version, flags, end = data[3], data[5], 10 + _synchsafe(data[6:10])
    body = data[10:end]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40:
        at = _synchsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    out: dict[str, str] = {}
    name_size, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(body) and body[at]:
        name, raw = body[at : at + name_size], body[at + name_size : at + 2 * name_size]
        size = _synchsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        frame = body[at + head : at + head + size]
        if name in ID3 and frame:
            value = frame[1:].decode(ENCODINGS[frame[0]] if frame[0] < 4 else "latin-1", "replace")
            out.setdefault(ID3[name], value.split("\0")[0])
        at += head + size
    return out


def _id3v1(data: bytes) -> dict[str, str]:
    if data[-128:-125] != b"TAG":
        return {}
    text = lambda a, b: data[-128 + a : -128 + b].split(b"\0")[0].decode("latin-1")
    return {"title": text(3, 33), "artist": text(33, 63), "album": text(63, 93)}


def _chunk(data: bytes, names: tuple[bytes, ...], order: str) -> bytes | None:
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], order)
        if data[at : at + 4] in names:
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return None


def _atoms(data: bytes, at: int, end: int, path: tuple[bytes, ...]) -> Iterator[tuple[bytes, int, int]]:
    """The children of the atom that a path leads to: name, first and end byte of the content."""
    while at + 8 <= end:
        size, name, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        stop = end if size == 0 else min(end, at + size)
        if size and size < head:
            return
        if not path:
            yield name, at + head, stop
        elif name == path[0]:
            yield from _atoms(data, at + head + (4 if name == b"meta" else 0), stop, path[1:])
        at = stop


def read(data: bytes | None) -> dict[str, str]:
    """Tags by name, stripped; none for other formats or if anything is broken."""
    try:
        data = data or b""
        if data[:4] == b"fLaC":
            found = next((_vorbis(b) for kind, b in flac_blocks(data) if kind == 4), {})
        elif data[:3] == b"ID3":
            found = {**_id3v1(data), **_id3(data)}
        elif data[:4] in (b"RIFF", b"FORM"):
            tag = _chunk(data, (b"id3 ", b"ID3 "), "little" if data[:4] == b"RIFF" else "big")
            found = _id3(tag) if tag and tag[:3] == b"ID3" else {}
        elif data[4:8] == b"ftyp":
            found = {}
            for name, a, b in _atoms(data, 0, len(data), (b"moov", b"udta", b"meta", b"ilst")):
                for kind, x, y in _atoms(data, a, b, ()):
                    if kind == b"data" and name in ATOMS:
                        found.setdefault(ATOMS[name], data[x + 8 : y].decode("utf-8", "replace"))
        else:
            found = _id3v1(data)
        return {k: found[k].strip() for k in TAGS if found.get(k, "").strip()}
    except (ValueError, IndexError, struct.error):
        return {}


def _read(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([[t.get(k) for k in TAGS] for t in map(read, content)], columns=list(TAGS), dtype=object)


def read_tags(content: Column) -> Column:
    """Struct artist, title, album, genre of a file's bytes; null where there is no such tag."""
    return pandas_udf(_read, ", ".join(f"{t} string" for t in TAGS))(content)


def probe(data: bytes | None) -> tuple[int, int, float, int, str]:
    """Rate, channels, seconds, kbit/s and codec by a file's header. Raises ValueError for what isn't known."""
    data = data or b""
    if data[:4] == b"fLaC":
        info = next((b for kind, b in flac_blocks(data) if kind == 0), b"")
        if len(info) < 18:
            raise ValueError("no stream info")
        bits = int.from_bytes(info[10:18], "big")
        rate, channels, samples = bits >> 44, (bits >> 41 & 7) + 1, bits & (1 << 36) - 1
        seconds = samples / rate if rate else 0.0
        return rate, channels, seconds, int(len(data) * 8 / seconds / 1000) if seconds else 0, "flac"
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        form, body = _chunk(data, (b"fmt ",), "little"), _chunk(data, (b"data",), "little")
        if form is None or body is None or len(form) < 16:
            raise ValueError("no format or data")
        _, channels, rate, per_second, _, bits = struct.unpack_from("<HHIIHH", form)
        return rate, channels, len(body) / per_second if per_second else 0.0, per_second * 8 // 1000, f"pcm_s{bits}le"
    at = 10 + _synchsafe(data[6:10]) if data[:3] == b"ID3" else 0
    first = data.find(b"\xff", at)
    while first >= 0 and first + 4 <= len(data):
        b = data[first + 1 : first + 4]
        version, layer, index, rate = b[0] >> 3 & 3, b[0] >> 1 & 3, b[1] >> 4, b[1] >> 2 & 3
        if b[0] >> 5 == 7 and version != 1 and layer == 1 and 0 < index < 15 and rate < 3:
            mpeg1 = version == 3
            hz = MP3_RATES[rate] >> (0 if mpeg1 else 1 if version == 2 else 2)
            kbps, channels = MP3_KBPS[1 if mpeg1 else 2][index], 1 if b[2] >> 6 == 3 else 2
            side = first + 4 + (32 if mpeg1 and channels == 2 else 17 if mpeg1 or channels == 2 else 9)
            seconds = (len(data) - first) * 8 / (kbps * 1000)
            if data[side : side + 4] in (b"Xing", b"Info") and data[side + 7] & 1:
                seconds = int.from_bytes(data[side + 8 : side + 12], "big") * (1152 if mpeg1 else 576) / hz
                kbps = int((len(data) - first) * 8 / seconds / 1000) if seconds else kbps
            return hz, channels, seconds, kbps, "mp3"
        first = data.find(b"\xff", first + 1)
    raise ValueError("no known header")


HEADER = "samplerate int, channels int, duration double, container_bitrate int, codec string, error string"


def _probe(content: pd.Series) -> pd.DataFrame:
    def one(data: bytes | None) -> tuple:
        try:
            return (*probe(data), None)
        except (ValueError, IndexError, struct.error) as e:
            return (*[None] * 5, f"{type(e).__name__}: {e}")

    return pd.DataFrame([one(x) for x in content], columns=[c.split()[0] for c in HEADER.split(", ")])


def open_info(content: Column) -> Column:
    """Struct samplerate, channels, duration, container_bitrate, codec, error of a FLAC, WAV or MP3 file's bytes."""
    return pandas_udf(_probe, HEADER)(content)
