"""Benchmark decontamination by suffix arrays of the training texts.

The documents of a scan partition are cut into shards of about a MB. Each shard gets a suffix array over its words; every
suffix of every benchmark item is binary-searched in it by its window (13 words; an item of fewer words is one window),
and hits are extended along the item to the longest verbatim matches.

Only suffixes that can match are put in the array: those whose first words, as many as the shortest window has, all
occur in the benchmark. That leaves results unchanged and the arrays short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, saved
from .words import Scan, raw, shards

WINDOW = 13
#: Text bytes of a shard, and of a block of the benchmark.
SHARD_BYTES, BLOCK_BYTES = 1 << 20, 8 << 20

MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_start", T.IntegerType()), T.StructField("doc_start", T.IntegerType()), T.StructField("n_words", T.IntegerType())])
_MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())])


class Items:
    """The windows of a block of benchmark items, as rows of word numbers (from 1; 0 fills up short ones)."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW):
        s = Scan(*raw(pa.array(texts, pa.large_string())))
        self.ids, self.window = ids, window
        self.vocab, number = np.unique(s.hash, return_inverse=True)
        number = number.astype(np.int64) + 1
        rows, lengths, item, start = [], [], [], []
        for i in range(len(ids)):
            own = number[s.first[i] : s.first[i + 1]]
            n = min(window, len(own))
            for k in range(len(own) - n + 1 if n else 0):
                rows.append(np.pad(own[k : k + n], (0, window - n)))
                lengths.append(n)
                item.append(i)
                start.append(k)
        self.shortest = min(lengths, default=0)
        keys = as_keys(np.array(rows, np.int64).reshape(-1, window))
        self.keys, self.of = np.unique(keys, return_inverse=True)
        first = np.zeros(len(self.keys), np.int64)
        first[self.of] = np.arange(len(self.of))
        self.length = np.array(lengths, np.int64)[first] if rows else np.zeros(0, np.int64)
        self.item, self.start = np.array(item, np.int64), np.array(start, np.int64)
        # the last key that begins with a window: the same for a full window, else filled with the largest word number
        top = np.array(rows, np.int64).reshape(-1, window)[first]
        top[np.arange(window)[None, :] >= self.length[:, None]] = 0xFFFFFFFF
        self.tops = as_keys(top)
        order = np.argsort(self.of, kind="stable")
        self.uses = order  # windows of items, by distinct window
        self.use_at = np.searchsorted(self.of[order], np.arange(len(self.keys) + 1))


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that compare as the rows do."""
    wide = np.ascontiguousarray(rows.astype(">u4"))
    return wide.view(f"S{4 * rows.shape[1]}").ravel()


def search(buf: np.ndarray, off: np.ndarray, items: Items) -> tuple[np.ndarray, list[np.ndarray], list[list[dict]]]:
    """Per text: its words, the hit spans as (from, to) pairs in a flat array, and its longest match with each item."""
    s = Scan(buf, off)
    n_docs, n_words = len(off) - 1, np.diff(s.first)
    spans: list[np.ndarray] = [np.zeros(0, np.int32)] * n_docs
    found: list[list[dict]] = [[] for _ in range(n_docs)]
    if not len(items.keys) or not len(s.hash):
        return n_words, spans, found
    at = np.minimum(np.searchsorted(items.vocab, s.hash), len(items.vocab) - 1)
    number = np.where(items.vocab[at] == s.hash, at + 1, 0)
    # words from each place on that all occur in the benchmark, within the text
    n = len(number)
    stop = np.where(number == 0, np.arange(n), n)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    run = np.minimum(stop - np.arange(n), s.left())
    suffix = np.flatnonzero(run >= items.shortest)
    if not len(suffix):
        return n_words, spans, found
    steps = np.arange(items.window)
    rows = number[np.minimum(suffix[:, None] + steps, n - 1)]
    rows[steps[None, :] >= run[suffix][:, None]] = 0
    keys = as_keys(rows)
    order = np.argsort(keys, kind="stable")
    suffix, keys = suffix[order], keys[order]
    low, high = np.searchsorted(keys, items.keys, "left"), np.searchsorted(keys, items.tops, "right")
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return n_words, spans, found
    many = (high - low)[hit]
    window = np.repeat(hit, many)
    place = suffix[np.repeat(low[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + items.length[window], -1)
    covered = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
    edge = covered[1:] != covered[:-1]
    edge[s.first[1:-1]] |= covered[1:][s.first[1:-1]] & covered[:-1][s.first[1:-1]]
    begins, ends = np.flatnonzero(edge & covered[1:]), np.flatnonzero(edge & covered[:-1])
    doc = np.searchsorted(s.first, begins, "right") - 1
    for d in np.unique(doc):
        own = doc == d
        spans[d] = (np.stack([begins[own], ends[own]], 1) - s.first[d]).astype(np.int32).ravel()
    # along each item: neighbouring windows on one diagonal are one longer match
    by_window = np.argsort(window, kind="stable")
    window, place = window[by_window], place[by_window]
    w_low, w_high = np.searchsorted(window, np.arange(len(items.keys)), "left"), np.searchsorted(window, np.arange(len(items.keys)), "right")
    uses = np.concatenate([items.uses[items.use_at[w] : items.use_at[w + 1]] for w in hit])
    uses = uses[np.lexsort((items.start[uses], items.item[uses]))]
    for i in np.unique(items.item[uses]):
        own = uses[items.item[uses] == i]
        parts = [place[w_low[w] : w_high[w]] for w in items.of[own]]
        start = np.repeat(items.start[own], [len(p) for p in parts])
        pos = np.concatenate(parts)
        base = np.lexsort((pos, pos - start))
        start, pos = start[base], pos[base]
        width = items.length[items.of[own[0]]]
        text = np.searchsorted(s.first, pos, "right") - 1
        new = np.ones(len(pos), bool)
        new[1:] = (pos[1:] != pos[:-1] + 1) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(pos))) + width - 1
        best = np.lexsort((pos[heads], -size, text[heads]))
        once = np.ones(len(best), bool)
        once[1:] = text[heads][best][1:] != text[heads][best][:-1]
        for k in best[once]:
            h = heads[k]
            found[text[h]].append({"item_id": items.ids[i], "item_start": int(start[h]), "doc_start": int(pos[h] - s.first[text[h]]), "n_words": int(size[k])})
    return n_words, spans, found


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The union of two flat arrays of (from, to) spans."""
    if not len(a) or not len(b):
        return a if len(a) else b
    both = np.concatenate([a, b]).reshape(-1, 2)
    both = both[np.argsort(both[:, 0], kind="stable")]
    reach = np.maximum.accumulate(both[:, 1])
    new = np.append(True, both[1:, 0] >= reach[:-1])
    return np.stack([both[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(both) - 1)]], 1).astype(np.int32).ravel()


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, matches (for each item id the longest verbatim match and where it lies) and contaminated.

    contaminated: n_hit > 0 and 20 * n_hit >= n_words. A null text has no words and is clean; so is every text if the
    benchmark is empty. Very long texts are searched to their end, one at a time. Repeated rows get the same columns each.
    Items with equal ids count as one id, repeated items once; items without words, id or text match nothing; of equally
    long matches the first in the text is given. An empty table gives an empty result. If names clash, the new columns get
    underscores before them.

    A benchmark of one block (about block_bytes) is searched for in one pass, without a shuffle. A larger one is cut into
    blocks by a hash of its items; each block is a pass of its own over the stored texts that writes what it finds, so no
    task and no driver step holds more than one block.
    """
    own = fresh(docs, "n_words", "n_hit", "matches", "contaminated", "_words", "_spans", "_matches", "_row")
    names, held = own[:4], own[4:]
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null and i is not null").distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0) // block_bytes))

    def block(b: int) -> Items:
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        return Items([r["i"] for r in part], [r["t"] for r in part], window)

    if blocks == 1:
        out = _pass(docs, block(0), text, held)
    else:
        row = held[3]
        base = saved(_pass(docs, Items([], [], window), text, held).drop(*held[1:3]).withColumn(row, F.monotonically_increasing_id()), "counted")
        found = None
        for b in range(blocks):
            one = _pass(base.select(row, text), block(b), text, held).where(F.size(held[1]) > 0).select(row, *held[1:3])
            one = saved(one, "hits")
            found = one if found is None else found.unionByName(one)
        # at most one row a block for each text
        merged = found.groupBy(row).agg(F.collect_list(held[1]).alias("s"), F.flatten(F.collect_list(held[2])).alias("m"))
        out = base.join(merged.mapInArrow(_merge, T.StructType([base.schema[row], *_held(held)[1:]])), row, "left").drop(row)
        none = [F.array().cast(kind.dataType) for kind in _held(held)[1:]]
        out = out.withColumns({c: F.coalesce(c, n) for c, n in zip(held[1:3], none, strict=True)})
    words, spans, matches = (F.col(f"`{c}`") for c in held[:3])
    hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumns({names[0]: words, names[1]: hit, names[2]: matches}).drop(*held[:3])
    n, h = F.col(f"`{names[0]}`"), F.col(f"`{names[1]}`")
    return out.withColumn(names[3], (h > 0) & (20 * h >= n))


def _held(names: list[str]) -> list[T.StructField]:
    kinds = (T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(MATCH))
    return [T.StructField(n, k) for n, k in zip(names, kinds, strict=False)]


def _longest(found: list[dict]) -> list[dict]:
    """One match for each item id: the longest, of equal ones the first in the text, then in the item."""
    best: dict[str, dict] = {}
    for m in found:
        old = best.get(m["item_id"])
        if old is None or (-m["n_words"], m["doc_start"], m["item_start"]) < (-old["n_words"], old["doc_start"], old["item_start"]):
            best[m["item_id"]] = m
    return [best[k] for k in sorted(best)]


def _pass(df: DataFrame, items: Items, text: str, held: list[str]) -> DataFrame:
    """df with each text's word count, hit spans and longest matches."""
    at, schema = df.columns.index(text), T.StructType([*df.schema.fields, *_held(held)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, spans, found = [], [], []
            for _, _, buf, off in shards(batch.column(at), SHARD_BYTES):
                w, s, f = search(buf, off, items)
                words += w.tolist()
                spans += s
                found += map(_longest, f)
            new = [pa.array(words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(_MATCH))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *held[:3]])

    return df.mapInArrow(run, schema)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (row, spans of each block, matches of all blocks) with the spans' union and the longest matches."""
    for batch in batches:
        spans = []
        for many in batch.column(1).to_pylist():
            one = np.zeros(0, np.int32)
            for s in many:
                one = joined(one, np.array(s, np.int32))
            spans.append(one)
        found = [_longest(f) for f in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(_MATCH))], names=batch.schema.names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with their own columns only."""
    flag = fresh(docs, "n_words", "n_hit", "matches", "contaminated")[3]
    return annotate(docs, benchmark, **options).where(~F.col(f"`{flag}`")).select(*(F.col(f"`{c}`") for c in docs.columns))
