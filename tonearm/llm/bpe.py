"""Byte-level BPE encoding and decoding by merge replay over many words at once.

1. A split cuts texts into words by the vocabulary's pattern. A task numbers the distinct words of up to UNIT_BYTES of text;
   its documents become lists of numbers.
2. All words that are new are laid out as one sequence of bytes, linked to their neighbours. An inverted index leads from a
   merge, named by its rank, to the positions where it applies. Merges are replayed in rank order, each at all of its positions in
   all words at once; only the touched neighbours are looked up again and put into the index.
3. Documents gather the ids of their numbers.
4. Decoding gathers the bytes of many documents' ids at once; an id is no Python object on the way.

The texts aren't shuffled and nothing is broadcast: sharing words among tasks would send every document's numbers through a
shuffle to save merges that cost less than that. A task that is lost is simply run again.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh
from .tokens import pieces

#: Bytes of the texts whose new words are merged together, of new words in one index, of the words that a task remembers, and characters of a piece.
UNIT_BYTES, INDEX_BYTES, WORD_BYTES, PIECE_CHARS = 1 << 23, 1 << 21, 1 << 22, 1 << 20
#: Ids of a batch that goes back to Spark, and ids whose bytes are put together at once.
BATCH_IDS, JOINED_IDS = 1 << 20, 1 << 18
#: Ids are below 2 ** BITS. From so many positions on, a rank's merges are done together.
BITS, MANY = 24, 48


@cache
def ranks(path: str) -> dict[bytes, int]:
    """The rank file: base64 of a token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """The merges of a rank table: two tokens can be merged where the bytes of both together are a token, whose rank is the merge's."""

    def __init__(self, table: dict[bytes, int]):
        self.table = table
        self.single = np.array([table[bytes([b])] for b in range(256)], np.int64)
        joined = ((table.get(t[:i]), table.get(t[i:]), r) for t, r in table.items() for i in range(1, len(t)))
        self.pairs = {a << BITS | b: r for a, b, r in joined if a is not None and b is not None}
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)

    @staticmethod
    @cache
    def of(path: str) -> Merges:
        """Those of a rank file, made once in a process."""
        return Merges(ranks(path))

    def _index(self, tokens: np.ndarray, last: np.ndarray) -> dict[int, np.ndarray]:
        """From each merge that applies to bytes side by side to its positions."""
        keys = tokens[:-1] << BITS | tokens[1:]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        spots = np.flatnonzero((self.keys[at] == keys) & ~last[:-1])
        merge = self.values[at[spots]]
        order = np.argsort(merge, kind="stable")
        merge, spots = merge[order], spots[order]
        cuts = np.flatnonzero(np.diff(merge)) + 1
        return {int(m[0]): s for m, s in zip(np.split(merge, cuts), np.split(spots.astype(np.int32), cuts), strict=True) if len(m)}

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many of them each has. A word that is a token is that token."""
        whole = [self.table.get(w) for w in words]
        sizes = np.array([len(w) if t is None else 0 for w, t in zip(words, whole, strict=True)], np.int64)
        ends = np.cumsum(sizes)
        data = self.single[np.frombuffer(b"".join(w for w, t in zip(words, whole, strict=True) if t is None), np.uint8)]
        if len(data):
            last = np.zeros(len(data), bool)
            last[ends[sizes > 0] - 1] = True
            data = self._merged(data, last, ends.tolist())
        kept = np.concatenate([[0], np.cumsum(data >= 0)])
        counts = kept[ends] - kept[ends - sizes]
        known = np.array([-1 if t is None else t for t in whole], np.int64)
        counts[known >= 0] = 1
        ids = np.zeros(int(counts.sum()), np.int64)
        single = np.repeat(known >= 0, counts)
        ids[single], ids[~single] = known[known >= 0], data[data >= 0]
        return ids, counts

    @staticmethod
    def _put(rank: int, spots, index: dict[int, list], there: dict, heap: list[int]) -> None:
        if rank not in index:
            index[rank] = []
            if rank not in there:
                heappush(heap, rank)
        index[rank].append(spots)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of pairs of tokens; -1 where they can't be merged, or one is -1."""
        keys = left.astype(np.int64) << BITS | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.values[at], -1)

    def _at_once(self, rank: int, spots: np.ndarray, marks: np.ndarray, tok: np.ndarray, after: np.ndarray, before: np.ndarray, index: dict, there: dict, heap: list[int]) -> bool:
        """The merges of a rank at many positions; False, with nothing changed, where their order in a word matters."""
        token = lambda x: np.where(x >= 0, tok[x], -1)
        i = np.sort(spots[self._ranks_of(tok[spots], token(after[spots])) == rank])
        i = i[np.diff(i, prepend=-1) > 0]
        j = after[i]
        marks[i] = True
        overlap = marks[j].any()
        marks[i] = False
        if overlap:
            return False
        right, left = after[j], before[i]
        # the right neighbour as it is before its own merge; the left one has had it
        early = self._ranks_of(np.full(len(i), rank), token(right))
        was = tok[i], tok[j]
        tok[i], tok[j] = rank, -1
        lefts, rights = self._ranks_of(token(left), tok[i]), self._ranks_of(tok[i], token(right))
        if min((x[x >= 0].min(initial=rank) for x in (early, lefts, rights))) < rank:
            tok[i], tok[j] = was
            return False  # a merge of lower rank comes between
        after[i] = right
        before[right[right >= 0]] = i[right >= 0]
        # of two neighbours that were both merged, the left one is now at i, not at j
        left = np.where(left >= 0, before[i], -1)
        new, spots = np.concatenate([lefts[lefts >= 0], rights[rights >= 0]]), np.concatenate([left[lefts >= 0], i[rights >= 0]])
        order = np.argsort(new, kind="stable")
        new, spots = new[order], spots[order]
        cuts = [0, *(np.flatnonzero(np.diff(new)) + 1).tolist(), len(new)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                self._put(int(new[a]), spots[a:b], index, there, heap)
        return True

    def _merged(self, tokens: np.ndarray, last: np.ndarray, ends: list[int]) -> np.ndarray:
        """tokens after all merges; -1 where a token became part of the one to its left."""
        there, index, pairs, n = self._index(tokens, last), {}, self.pairs, len(tokens)
        compact = lambda x: array("i", x.astype(np.int32).tobytes())
        after = compact(np.where(last, -1, np.arange(1, n + 1)))
        before = compact(np.where(np.concatenate([[True], last[:-1]]), -1, np.arange(-1, n - 1)))
        tok, heap = compact(tokens), sorted(there)
        put, get, bits = self._put, pairs.get, BITS
        many_tok, many_after, many_before = (np.frombuffer(x, np.int32) for x in (tok, after, before))  # the same memory
        marks = np.zeros(n, bool)
        while heap:
            rank, skip = heappop(heap), -1
            # what was there at the start, and what merges have made since
            some = [np.asarray(x, np.int32) for x in (there.pop(rank, ()), *index.pop(rank, ()))]
            spots = np.concatenate(some)
            if len(spots) >= MANY and self._at_once(rank, spots, marks, many_tok, many_after, many_before, index, there, heap):
                continue
            new_at: dict[int, list[int]] = {}
            for i in sorted(spots.tolist()):
                j = after[i]
                if j < 0 or tok[i] < 0 or get(tok[i] << bits | tok[j]) != rank:
                    continue  # a neighbour was merged since
                if i < skip:  # a merge of lower rank comes first in this word
                    new_at.setdefault(rank, []).append(i)
                    continue
                tok[i], tok[j] = rank, -1
                after[i] = right = after[j]
                left = before[i]
                if right >= 0:
                    before[right] = i
                    new = get(rank << bits | tok[right])
                    if new is not None:
                        new_at.setdefault(new, []).append(i)
                        if new < rank:
                            skip = ends[bisect_right(ends, i)]
                if left >= 0:
                    new = get(tok[left] << bits | rank)
                    if new is not None:
                        new_at.setdefault(new, []).append(left)
                        if new < rank:
                            skip = ends[bisect_right(ends, i)]
            for new, spots in new_at.items():
                put(new, spots, index, there, heap)
        return np.array(tok, np.int64)


@cache
def disputed() -> str:
    """A class of the characters that the pattern module takes for letters or numbers and the library of rank files doesn't, as it
    knows another version of Unicode. Only what Python itself doesn't know either is asked for.
    """
    import regex
    import tiktoken

    table = {bytes([b]): b for b in range(256)} | {b"'s": 256}
    ask = tiktoken.Encoding("ask", pat_str=r"'s|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s+", mergeable_ranks=table, special_tokens={})
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    # after a letter or number, 's stands by itself; after anything else it doesn't
    found = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn" and ask.encode_ordinary(c + "'s")[-1] != 256]
    cuts = [i for i in range(1, len(found)) if found[i] != found[i - 1] + 1]
    return "".join(f"\\U{found[a]:08x}-\\U{found[b - 1]:08x}" for a, b in zip([0, *cuts], [*cuts, len(found)], strict=True)) if found else ""


def _spelled_out(pattern: str, odd: str) -> str | None:
    """The pattern with the characters of its classes below 0x10000, for the module that knows no classes but is twice as fast; None where it has others than letters, numbers and white space."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def ranges(kind: str) -> str:
        found = [ord(c) for c in regex.findall(f"(?V1)[{kind}--[{odd}]]" if odd else kind, every)]
        cuts = [i for i in range(1, len(found)) if found[i] != found[i - 1] + 1]
        return "".join(f"\\u{found[a]:04x}-\\u{found[b - 1]:04x}" for a, b in zip([0, *cuts], [*cuts, len(found)], strict=True))

    out, inside = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.S):
        if part in (r"\p{L}", r"\p{N}", r"\s"):
            part = ranges(part) if inside else f"[{ranges(part)}]"
        elif part == r"\S" and not inside:
            part = f"[^{ranges(r'\s')}]"
        elif re.match(r"\\\w", part):
            return None
        inside = part == "[" or inside and part != "]"
        out.append(part)
    return "".join(out)


@cache
def finders(pattern: str, odd: str) -> tuple[Callable[[str], list[str]], Callable[[str], list[str]]]:
    """What finds the words of any text, and of a text without characters from 0x10000 on. odd: what disputed() gives."""
    import regex

    known = re.sub(r"\\p\{[LN]\}", lambda m: f"[{m[0]}--[{odd}]]", pattern) if odd else pattern
    every, plain = regex.compile("(?V1)" + known).findall, _spelled_out(pattern, odd)
    return every, re.compile(plain).findall if plain else every


class Words:
    """The distinct words that a task has met, numbered, and their ids once settle() has run. odd: what disputed() gives."""

    def __init__(self, merges: Merges, pattern: str, odd: str):
        self.merges = merges
        self.any, self.plain = finders(pattern, odd)
        self.wide = re.compile("[\U00010000-\U0010ffff]").search
        self.clear()

    def find(self, text: str) -> list[str]:
        return self.any(text) if self.wide(text) else self.plain(text)

    def clear(self) -> None:
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.settled = self.held = 0
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, text: str) -> np.ndarray:
        out = [np.fromiter(map(self.number.__getitem__, found), np.int32, len(found)) for found in map(self.find, pieces(text, PIECE_CHARS))]
        return out[0] if len(out) == 1 else np.concatenate(out)

    def settle(self) -> None:
        """Merge the words that are new, as many in one index as INDEX_BYTES hold."""
        words = [w.encode() for w in islice(self.number, self.settled, None)]
        ends = np.cumsum([0, *map(len, words)])
        at = 0
        while at < len(words):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + INDEX_BYTES, "right")) - 1)
            ids, counts = self.merges.replay(words[at:stop])
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.ids, self.counts = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.counts, counts])
            at = stop
        self.held += int(ends[-1])
        self.settled = len(self.number)

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        counts = self.counts[numbers]
        shift = np.repeat(self.starts[numbers] - (np.cumsum(counts) - counts), counts)
        return self.ids[shift + np.arange(len(shift))]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df without its text but with ids array<int>: the ids of every whole text, as the library of the rank file at `path` gives them
    for ordinary text, each match of `pattern` by itself. No special tokens.

    A null text counts as empty: no ids. Repeated rows are each encoded; an empty table stays empty. If df has a column ids,
    the new one gets an underscore before it. Long texts are cut before single spaces, which no match spans. The other
    columns pass through. No shuffle.
    """
    at, (name,), odd = df.columns.index(text), fresh(df, "ids"), disputed()
    schema = T.StructType([*(f for f in df.schema.fields if f.name != text), T.StructField(name, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(Merges.of(path), pattern, odd)
        waiting: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
        held = 0

        def done() -> Iterator[pa.RecordBatch]:
            words.settle()
            for rest, many in waiting:
                start, lists, n = 0, [], 0
                for i, numbers in enumerate(many):
                    lists.append(words.ids_of(numbers))
                    n += len(lists[-1])
                    if n >= BATCH_IDS or i == len(many) - 1:
                        ends = np.cumsum([0, *map(len, lists)])
                        column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists), pa.int32()))
                        yield pa.RecordBatch.from_arrays([*rest.slice(start, len(lists)).columns, column], names=[*rest.schema.names, name])
                        start, lists, n = i + 1, [], 0
            waiting.clear()
            if words.held > WORD_BYTES:
                words.clear()

        for batch in batches:
            rest = pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at] or [pa.nulls(batch.num_rows)], names=[c for i, c in enumerate(batch.schema.names) if i != at] or ["_"])
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0, np.int64)
            start = 0
            while start < batch.num_rows:  # a batch of long texts is worked through in parts
                base = int(sizes[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, base + UNIT_BYTES - held, "right")))
                waiting.append((rest.slice(start, stop - start), [words.numbers(v.as_py() or "") for v in batch.column(at)[start:stop]]))
                held += int(sizes[stop - 1]) - base
                start = stop
                if held >= UNIT_BYTES:
                    yield from done()
                    held = 0
        yield from done()

    return df.mapInArrow(run, schema)


@cache
def tokens_of(path: str) -> pa.Array:
    """The bytes of each id of a rank file, null where it has none and at the end."""
    table = ranks(path)
    out: list[bytes | None] = [None] * (max(table.values(), default=-1) + 2)
    for token, rank in table.items():
        out[rank] = token
    return pa.array(out, pa.binary())


def _joined(tokens: pa.Array, ids: pa.Array) -> pa.Array:
    """Of each list of ids the bytes of its tokens in a row; null for a null list and for one that holds a null or unknown id."""
    ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)])
    flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
    unknown = (flat < 0) | (flat >= len(tokens))
    found = tokens.take(pa.array(np.where(unknown, len(tokens) - 1, flat)))
    lost = np.cumsum(np.concatenate([[0], found.is_null().to_numpy(zero_copy_only=False)]))[ends]
    # the tokens' bytes stand in a row already: only the rows' bounds are new
    _, bounds, data = found.buffers()
    bounds = np.frombuffer(bounds, np.int32, len(found) + 1)[ends] if len(found) else np.zeros(len(ends), np.int32)
    rows = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(bounds), data or pa.py_buffer(b"")])
    return pc.if_else(pc.or_(ids.is_null(), pa.array(np.diff(lost) > 0)), pa.scalar(None, pa.binary()), rows)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with decoded binary: the bytes of each row's ids in a row, which are UTF-8 if the ids came from a text.

    Null ids, a null among them and ids that the rank file doesn't hold give null; no ids give no bytes. If df has a column
    decoded, the new one gets an underscore before it. No shuffle.
    """
    at, (name,) = df.columns.index(ids), fresh(df, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for batch in batches:
            sizes = np.cumsum([0, *pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)])
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + JOINED_IDS, "right")) - 1)
                some = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*some.columns, _joined(tokens, some.column(at))], names=[*batch.schema.names, name])
                start = stop

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())]))
