"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages (runs of 64 white-space tokens, to its end). Every passage is encoded by hashed byte
trigrams and a few shape statistics, projected, and weighted by gated attention learned from document labels alone; the
weighted sum of a bag's passages is scored. The network is small, so it is trained on the driver, on a bounded sample
of labelled documents, all passages of each; their vectors are a table in the shared folder, read in parts of bounded
size. Scoring reads every passage of every document, partition by partition, without a shuffle. A passage's vector depends
on its own bytes alone, so long texts are encoded piece by piece and weighted as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_saved, fresh, remainder, saved
from .words import TOKEN, Scan, shards

PASSAGE, BUCKETS, SHAPES, HIDDEN = 64, 512, 10, 24
SHARD_BYTES = 1 << 20
#: Passages that are encoded at a time, or stored as one row; passages of a training step; bytes of vectors that the driver reads at a time.
PIECE, STEP, PART_BYTES = 1024, 16384, 256 << 20
WIDTH = BUCKETS + SHAPES


def encode(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage vectors of all texts, and for each text where its passages begin (one passage at least, if only empty)."""
    s = Scan(buf, off, TOKEN, lower=False)
    n_tokens = np.diff(s.first)
    n_pass = np.maximum(1, -(-n_tokens // PASSAGE))
    first = np.zeros(len(n_pass) + 1, np.int64)
    np.cumsum(n_pass, out=first[1:])
    total = int(first[-1])
    x = np.zeros((total, WIDTH), np.float32)
    if len(s.start):
        doc = np.repeat(np.arange(len(n_tokens)), n_tokens)
        place = first[doc] + (np.arange(len(doc)) - s.first[doc]) // PASSAGE
        # each byte belongs to the passage of the token that it stands in or after; what stands before a text's first token, to none
        own = np.repeat(place, np.diff(np.append(s.start, len(buf))))
        lead = s.start[0]
        edge = np.zeros(len(buf) + 1, np.int64)
        some = n_tokens > 0
        np.add.at(edge, off[:-1], 1)
        np.add.at(edge, np.where(some, s.start[np.minimum(s.first[:-1], len(s.start) - 1)], off[1:]), -1)
        inside = np.cumsum(edge[:-1])[lead:] == 0
        c = buf[lead:][inside]
        own = own[inside]
        b = c.astype(np.uint32)
        if len(b) > 2:
            code = ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1]) * np.uint32(0x85EBCA6B) + b[2:]) * np.uint32(0xC2B2AE35)
            whole = own[:-2] == own[2:]
            slot = own[:-2][whole] * BUCKETS + (code[whole] >> np.uint32(23))
            grams = np.bincount(slot, minlength=total * BUCKETS).reshape(total, BUCKETS).astype(np.float32)
            grams = np.log1p(grams)
            grams /= np.sqrt((grams**2).sum(1, keepdims=True)) + 1e-6
            x[:, :BUCKETS] = grams
        count = np.bincount(place, minlength=total).astype(np.float64)
        some = np.maximum(count, 1)
        same = np.zeros(len(place), bool)
        same[1:] = (s.hash[1:] == s.hash[:-1]) & (place[1:] == place[:-1])
        key = s.hash ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        again = np.zeros(len(place), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        size = (s.end - s.start).astype(np.float64)
        kinds = np.zeros(256, np.int64)
        kinds[65:91], kinds[97:123], kinds[48:58], kinds[128:] = 1, 2, 3, 4
        kinds[[33, 35, 36, 37, 38, 42, 124]] = 5
        by_kind = np.bincount(own * 6 + kinds[c], minlength=total * 6).reshape(total, 6) / np.maximum(np.bincount(own, minlength=total), 1)[:, None]
        x[:, BUCKETS] = np.bincount(place, same, total) / some
        x[:, BUCKETS + 1] = np.bincount(place, again, total) / some
        x[:, BUCKETS + 2] = np.log1p(np.bincount(place, size, total) / some) / 3
        x[:, BUCKETS + 3] = np.log1p(count) / 5
        x[:, BUCKETS + 4 : BUCKETS + 10] = by_kind
    return x, first


def pieces(buf: np.ndarray, passages: int) -> Iterator[np.ndarray]:
    """One text in parts of so many passages, each beginning with a passage's first token (the first with the text)."""
    cuts, seen, inside = [0], 0, False
    for at in range(0, len(buf), 1 << 20):
        w = TOKEN[buf[at : at + (1 << 20)]]
        starts = np.flatnonzero(w & ~np.append(inside, w[:-1])) + at
        number = np.arange(seen, seen + len(starts))
        cuts += starts[(number % (PASSAGE * passages) == 0) & (number > 0)].tolist()
        seen, inside = seen + len(starts), bool(w[-1])
    for a, b in zip(cuts, [*cuts[1:], len(buf)], strict=True):
        yield buf[a:b]


def vectors(texts: pa.Array) -> Iterator[tuple[int, int, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """First and end text of each run, and its passage vectors with the offsets by text; a text that is long for itself comes in pieces."""
    for begin, end, buf, off in shards(texts, SHARD_BYTES):
        if len(buf) <= SHARD_BYTES:
            yield begin, end, iter([encode(buf, off)])
        else:
            yield begin, end, (encode(p, np.array([0, len(p)])) for p in pieces(buf, PIECE))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """h = tanh(xW + b); a = softmax over the bag of w . (tanh(hV) * sigmoid(hU)); score = sigmoid(c . sum(a h) + d)."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d = WIDTH
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"W": draw(d, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, HIDDEN), "U": draw(HIDDEN, HIDDEN), "w": draw(HIDDEN), "c": draw(HIDDEN), "d": np.zeros(1, np.float32)}

    def _forward(self, x: np.ndarray, first: np.ndarray):
        p, n = self.p, np.diff(first)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), n))
        a = e / np.repeat(np.add.reduceat(e, first[:-1]), n)
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        return h, t, g, a, z, z @ p["c"] + p["d"][0]

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return sigmoid(self._forward(x, first)[-1].astype(np.float64)) if len(first) > 1 else np.zeros(0)

    def score_pieces(self, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[float, int]:
        """The score of one bag whose passages come in parts, and how many they are: its attention is one softmax over all of them."""
        top, total, z, n = -np.inf, 0.0, np.zeros(HIDDEN), 0
        for x, _ in parts:
            p = self.p
            h = np.tanh(x @ p["W"] + p["b"])
            e = (np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) @ p["w"]
            new = max(top, float(e.max()))
            a = np.exp(e - new)
            keep = np.exp(top - new) if n else 0.0
            top, total, z, n = new, total * keep + a.sum(), z * keep + a @ h, n + len(x)
        return float(sigmoid((z / total) @ self.p["c"] + self.p["d"][0])), n

    def attention(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._forward(x, first)[3]

    def fit(self, parts: list, load, epochs: int = 25, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> Model:
        """parts: names of parts of the bags; load(part) gives its vectors, offsets and labels. One part is loaded at a time, a single one once."""
        r = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(q) for k, q in self.p.items()}, {k: np.zeros_like(q) for k, q in self.p.items()}, 0
        held = load(parts[0]) if len(parts) == 1 else None
        for _ in range(epochs):
            for part in r.permutation(len(parts)) if len(parts) > 1 else [0]:
                x, first, y = held or load(parts[part])
                order = r.permutation(len(y))
                for bags in steps(order, np.diff(first), batch):
                    n = first[bags + 1] - first[bags]
                    own = np.zeros(len(bags) + 1, np.int64)
                    np.cumsum(n, out=own[1:])
                    rows = np.repeat(first[bags] - own[:-1], n) + np.arange(own[-1])
                    step += 1
                    for k, grad in self._gradient(x[rows].astype(np.float32), own, y[bags]).items():
                        m[k] = 0.9 * m[k] + 0.1 * grad
                        v[k] = 0.999 * v[k] + 0.001 * grad**2
                        self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        return self

    def _gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, np.diff(first)
        h, t, g, a, z, out = self._forward(x, first)
        d_out = ((sigmoid(out) - y) / len(y)).astype(np.float32)
        d_z = d_out[:, None] * p["c"]
        d_zr = np.repeat(d_z, n, axis=0)
        d_a = (d_zr * h).sum(1)
        d_e = a * (d_a - np.repeat(np.add.reduceat(a * d_a, first[:-1]), n))
        d_tg = d_e[:, None] * p["w"]
        d_t, d_g = d_tg * g * (1 - t**2), d_tg * t * g * (1 - g)
        d_h = (a[:, None] * d_zr + d_t @ p["V"].T + d_g @ p["U"].T) * (1 - h**2)
        keep = 1e-5
        return {"W": x.T @ d_h + keep * p["W"], "b": d_h.sum(0), "V": h.T @ d_t, "U": h.T @ d_g, "w": (t * g).T @ d_e, "c": z.T @ d_out, "d": d_out.sum(keepdims=True)}


def steps(order: np.ndarray, sizes: np.ndarray, batch: int) -> Iterator[np.ndarray]:
    """The bags in order, `batch` at a time, or fewer (one at least) where they have more than STEP passages."""
    at = 0
    while at < len(order):
        some = order[at : at + batch]
        n = max(1, int(np.searchsorted(np.cumsum(sizes[some]), STEP, "right")))
        yield some[:n]
        at += len(some[:n])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = 4000) -> Model | None:
    """Fit on labelled documents whose crc32(key as text) mod 3 is not 1; None if there are none.

    sample bounds the rows: half of each label where both have as many, the first by a hash of the key. All passages of a
    row's text are learned from, however long it is; their vectors (about a kB each) are written to the shared folder, and
    the driver reads parts of about PART_BYTES of them (one text at least). Of a key with several texts the one with the
    smallest hash is taken, of several labels the largest. Null texts are empty ones.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (remainder(F.col(key)) != 1))
    rows = rows.groupBy(F.col(key).alias("k")).agg(F.max(F.col(label)).cast("int").alias("y"))
    order = F.xxhash64("k", F.lit(17))
    picked = rows.where("y = 0").orderBy(order, "k").limit(sample // 2).unionByName(rows.where("y = 1").orderBy(order, "k").limit(sample - sample // 2))
    # at most `sample` pairs of a key and a label: the bound of this broadcast
    bags = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(picked), "k")
    bags = bags.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"].alias("t")).select(F.col("k").cast("string").alias("k"), "y", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, parts in vectors(batch.column(2)):
                for number, (x, first) in enumerate(parts):
                    out = []
                    for i in range(len(first) - 1):
                        k, y = batch.column(0)[begin + i].as_py(), batch.column(1)[begin + i].as_py()
                        for at in range(first[i], first[i + 1], PIECE):
                            some = x[at : min(at + PIECE, first[i + 1])]
                            out.append((k, y, number * PIECE + int(at - first[i]), len(some), some.astype(np.float16).tobytes()))
                    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["k", "y", "at", "n", "x"])

    stored = saved(bags.mapInArrow(run, "k string, y int, at long, n long, x binary"), "passages")
    total = stored.agg(F.sum("n").alias("n")).first()["n"]
    if not total:
        return None
    parts = -(-total * 2 * WIDTH // PART_BYTES)

    def load(part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The vectors of a part's bags in order of their keys, as half floats; steps widen them as they are used."""
        got = stored.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == part).toArrow().combine_chunks()
        order = pc.sort_indices(got, sort_keys=[("k", "ascending"), ("at", "ascending")]).to_numpy()
        sizes, at = got.column("n").to_numpy()[order], got.column("at").to_numpy()[order]
        ends = np.append(0, np.cumsum(sizes))
        x = np.empty((ends[-1], WIDTH), np.float16)
        for row, a, b in zip(order.tolist(), ends, ends[1:], strict=False):
            x[a:b] = np.frombuffer(got.column("x")[row].as_buffer(), np.float16).reshape(-1, WIDTH)
        y = got.column("y").to_numpy()[order][at == 0].astype(np.float32)
        del got
        pa.default_memory_pool().release_unused()
        return x, np.append(ends[:-1][at == 0], ends[-1]), y

    filled = [r["part"] for r in stored.select(F.pmod(F.xxhash64("k"), F.lit(parts)).alias("part")).distinct().orderBy("part").collect()]
    model = Model().fit(filled, load)
    drop_saved(stored)
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5) and n_passages.

    A null or empty text is one empty passage and has a score like any other; a very long one is encoded in pieces and
    weighted over all its passages. Without a model (nothing was labelled) every score is 0.5. Repeated rows score alike,
    whatever stands beside them; an empty table gives an empty result. If names clash, the new columns get underscores
    before them.
    """
    names = fresh(docs, "score", "predicted", "n_passages")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, (T.DoubleType(), T.IntegerType(), T.LongType()), strict=True))])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, passages = [np.zeros(0)], [np.zeros(0, np.int64)]
            for begin, end, parts in vectors(batch.column(at)):
                if end - begin == 1:
                    one, n = model.score_pieces(parts) if model else (0.5, sum(len(x) for x, _ in parts))
                    scores.append(np.array([one]))
                    passages.append(np.array([n]))
                else:
                    x, first = next(parts)
                    scores.append(model.score(x, first) if model else np.full(end - begin, 0.5))
                    passages.append(np.diff(first))
            s = np.concatenate(scores).round(6)  # the same whatever stands beside a text
            new = [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array(np.concatenate(passages), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The documents with predicted = 1, with their own columns only."""
    flag = fresh(docs, "score", "predicted", "n_passages")[1]
    return score(docs, model, text).where(F.col(f"`{flag}`") == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
