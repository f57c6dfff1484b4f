"""Words of many texts at once, by numpy over the texts' joined UTF-8 bytes.

A text's words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased: digits, Latin letters
and everything outside ASCII. All bytes of a character outside ASCII are 0x80 or more, so looking at bytes is enough.
Words and shingles are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
TOKEN = np.ones(256, bool)
TOKEN[9:14] = TOKEN[32] = False

BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE**j and BASE**-j modulo 2**64 for j up to n."""
    global _powers
    if len(_powers[0]) <= n:
        made = []
        for base in (BASE, BACK):
            steps = np.full(max(n + 1, 1 << 20), base)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if n > 1 << 23:  # one very long text: don't keep them
            return made
        _powers = made
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of a string or binary array (null: empty) and the n + 1 offsets of its texts."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def shards(texts: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of at most limit bytes (one text at least): first, end, bytes, offsets."""
    if not len(texts):
        return
    buf, off = raw(texts)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield first, end, buf[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


class Scan:
    """start, end: byte positions of words; first[d] to first[d + 1]: the words of text d; hash: of each word."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, inside: np.ndarray = WORD, lower: bool = True):
        low = LOWER[buf] if lower else buf
        w = inside[low]
        before, after = np.zeros(len(w), bool), np.zeros(len(w), bool)
        before[1:], after[:-1] = w[:-1], w[1:]
        full = off[1:] > off[:-1]
        before[off[:-1][full]] = False
        after[off[1:][full] - 1] = False
        self.start = np.flatnonzero(w & ~before)
        self.end = np.flatnonzero(w & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        up, down = powers(len(buf))
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(low * up[: len(buf)], out=sums[1:])
        self.hash = mixed((sums[self.end] - sums[self.start]) * down[self.start])
        self.low = low

    def left(self) -> np.ndarray:
        """For each word, how many words its text has from it on."""
        n = np.diff(self.first)
        return np.repeat(self.first[1:], n) - np.arange(len(self.start))


def shingles(s: Scan, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of each text, in order, repeats kept, and the offsets by text.

    A text of fewer words, but not none, has one shingle: all its words.
    """
    count, left = np.diff(s.first), s.left()
    total = np.zeros(len(s.hash), np.uint64)
    for k in range(n):
        step = np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
        total[: len(s.hash) - k] += np.where(left[: len(s.hash) - k] > k, s.hash[k:] * step, np.uint64(0))
    at = np.zeros(len(s.hash), bool)
    at[left >= n] = True
    short = s.first[:-1][(count > 0) & (count < n)]
    at[short] = True
    total[short] += count[(count > 0) & (count < n)].astype(np.uint64)
    have = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    off = np.zeros(len(have) + 1, np.int64)
    np.cumsum(have, out=off[1:])
    return mixed(total[at]), off
