"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of shingles (runs of five words; a text of fewer words, but not none, is one shingle).

1. Texts with the same words in the same order are one class. Classes are numbered, and the number is what is linked from
   here on: a doc_id may have several texts, so it can't stand for one of them.
2. Each class has 96 MinHash values, dealt into 24 bands of 4. Two texts of Jaccard 0.8 share no band with a
   probability of 3e-6. Bands shared by the same classes are looked at once.
3. In a band, values are compared block by block of the signature, and a pair is dropped as soon as the posterior
   probability that its Jaccard reaches the threshold falls below the tolerance (uniform prior). The rest of a band is
   joined to a few leaders, not to each other, so a band of n texts gives n links, not n squared.
4. Connected components of these links are the groups in which pairs are verified. Every pair of a group goes through
   the pruning again, and what is left is verified exactly on the shingle sets, in blocks of GROUP_BLOCK texts by
   matrix products. In groups of several blocks signatures go first, and shingles only where they left a partner. A
   block gives counts and a spanning forest, so no task holds or writes all pairs of a group.
5. Components of the verified links are the classes of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_saved, fresh, saved, small
from .words import Scan, mixed, shards, shingles

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-5
BANDS, ROWS = 24, 4
VALUES, STEP = BANDS * ROWS, 16
SHARD_BYTES = 1 << 20
#: Texts of a block in which all pairs are looked at; a larger band or group is cut into blocks.
BAND_BLOCK, GROUP_BLOCK = 4096, 768
#: A band's texts are joined to its leader if they may be LOOSE alike, and no longer looked at themselves from a share of
#: TIGHT equal values on. For a text left out that way, anything that is 0.8 alike is at least 0.65 like the leader (Jaccard
#: distances obey the triangle inequality).
LOOSE, LOOSE_TOLERANCE, TIGHT = 0.5, 0.01, 0.85

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**32, VALUES, dtype=np.uint32)
_ODD = _rng.integers(0, 2**32, VALUES, dtype=np.uint32) | np.uint32(1)


@lru_cache
def least_equal(values: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values, of so many compared, with which a pair is kept.

    With a uniform prior and m of n equal, the similarity's posterior is Beta(m + 1, n - m + 1); it exceeds t with the
    probability that at most m of n + 1 trials with chance t succeed.
    """
    total = 0.0
    for m in range(values + 1):
        total += math.comb(values + 1, m) * threshold**m * (1 - threshold) ** (values + 1 - m)
        if total >= tolerance:
            return m
    return values


def alike(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Whether each pair of rows a[i], b[i] of signatures survives, comparing STEP values at a time."""
    left = np.arange(len(a))
    equal = np.zeros(len(a), np.int64)
    for k in range(0, a.shape[1], STEP):
        equal[left] += (a[left, k : k + STEP] == b[left, k : k + STEP]).sum(1)
        left = left[equal[left] >= least_equal(min(k + STEP, a.shape[1]), threshold, tolerance)]
    out = np.zeros(len(a), bool)
    out[left] = True
    return out


def minhash(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """VALUES minima of each run of shingle hashes; the largest number for an empty run."""
    n = np.diff(off)
    out = np.full((len(n), VALUES), 0xFFFFFFFF, np.uint32)
    full = n > 0
    if full.any():
        h, at = (values >> np.uint64(32)).astype(np.uint32), off[:-1][full]
        part = np.empty((VALUES, len(at)), np.uint32)
        work = np.empty_like(h)
        for k in range(VALUES):
            np.bitwise_xor(h, _XOR[k], out=work)
            np.multiply(work, _ODD[k], out=work)
            work ^= work >> np.uint32(15)
            np.multiply(work, _ODD[k], out=work)
            part[k] = np.minimum.reduceat(work, at)
        out[full] = part.T
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    wide = signatures.astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), wide.shape[:2]).copy()
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, k])
    return key.view(np.int64)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


# ---- 1: sketches -----------------------------------------------------------------------------------------------------


def digest(text: str) -> Column:
    """Tells the texts of one doc_id apart; it is compared only between rows of the same doc_id."""
    return F.xxhash64(F.col(text))


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, digest (of the text, to tell a doc_id's texts apart), words (a 128-bit hash of the word sequence; null without words), signature, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, buf, off in shards(batch.column(2), SHARD_BYTES):
                s = Scan(buf, off)
                values, at = shingles(s, WORDS)
                sig = minhash(values, at)
                n = np.diff(s.first)
                whole = np.zeros((len(n), 2), np.uint64)
                if len(s.hash):
                    place = np.arange(len(s.hash)) - np.repeat(s.first[:-1], n)
                    full = n > 0
                    for j, salt in enumerate((0x2545F4914F6CDD1D, 0xDA942042E4DD58B5)):
                        whole[full, j] = np.add.reduceat(mixed(s.hash * np.uint64(salt) + place.astype(np.uint64)), s.first[:-1][full])
                        whole[full, j] = mixed(whole[full, j] + n[full].astype(np.uint64))
                words = [whole[i].tobytes() if n[i] else None for i in range(len(n))]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * BANDS + 1, BANDS), pa.int32()), pa.array(band_keys(sig).ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(begin, end - begin) for i in range(2)), pa.array(words, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary()), bands], names=["doc_id", "digest", "words", "signature", "bands"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), digest(text).alias("digest"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, digest long, words binary, signature binary, bands array<long>")


# ---- 3: links within bands -------------------------------------------------------------------------------------------


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys from a sorted stream, as many runs at a time as the stream's batches allow."""
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table) -> int:
        last, n = [t.column(k)[-1] for k in keys], t.num_rows
        low, high = 0, n - 1
        same = lambda i: all(t.column(k)[i].as_py() == v.as_py() for k, v in zip(keys, last, strict=True))
        while low < high:  # the stream is sorted: the last run is a suffix
            mid = (low + high) // 2
            low, high = (low, mid) if same(mid) else (mid + 1, high)
        return low

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        at = cut(t)
        if at:
            yield t.slice(0, at)
            held = t.slice(at).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def band_links(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (row, leader row) of one band's texts, in order of doc_id, and which rows are no longer looked at.

    All texts are compared with the first one at once, then the rest with the next, until none is left. The Bayesian
    test at the LOOSE similarity drops what is unlike; a link needs no more than that, as pairs are verified later.
    """
    links_a, links_b = [], []
    done = np.zeros(len(sig), bool)
    left = np.arange(len(sig))
    while len(left) > 1:
        leader, rest = left[0], left[1:]
        near = rest[alike(sig[rest], np.broadcast_to(sig[leader], (len(rest), sig.shape[1])), LOOSE, LOOSE_TOLERANCE)]
        links_a.append(near)
        links_b.append(np.full(len(near), leader))
        share = (sig[near] == sig[leader]).mean(1)
        gone = near[share >= TIGHT]
        done[leader], done[gone] = True, True
        left = rest[~np.isin(rest, gone, assume_unique=True)]
    done[left] = True
    return np.concatenate([*links_a, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*links_b, np.zeros(0, np.int64)]).astype(np.int64), done


def forest(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What band_links connects, as at most one link for each row: to the first row of its component."""
    i, j, _ = band_links(sig)
    low = components(len(sig), i, j)
    rows = np.flatnonzero(low != np.arange(len(sig)))
    return rows, low[rows]


def links_in_bands(classes: DataFrame) -> DataFrame:
    """a, b: links between classes (rep, signature, bands) that may be alike; all that are alike are connected by them."""
    keys = classes.select("rep", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sum")).where("n > 1")
    # bands of the same texts are one: the smallest key stands for them
    once = shared.groupBy("n", "low", "high", "sum").agg(F.min("band").alias("band")).select("band", "n")
    members = saved(keys.join(once, "band").select("band", "rep", "n"), "bands")
    out, rounds = None, 0
    while True:
        cut = F.when(F.col("n") > BAND_BLOCK, F.pmod(F.xxhash64("rep", F.lit(rounds)), F.ceil(F.col("n") / (BAND_BLOCK // 2)).cast("int"))).otherwise(0)
        rows = members.withColumn("part", cut).groupBy("rep").agg(F.collect_list(F.struct("band", "part", "n")).alias("in"))  # BANDS at most
        rows = rows.join(classes.select("rep", "signature"), "rep").select("rep", "signature", F.explode("in").alias("x")).select("x.band", "x.part", "x.n", "rep", "signature")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in runs_of(batches, ["band", "part"]):
                rep, band, part = (t.column(c).to_numpy() for c in ("rep", "band", "part"))
                size = t.column("n").to_numpy()
                sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint32).reshape(-1, VALUES)
                new = np.flatnonzero(np.append(True, (band[1:] != band[:-1]) | (part[1:] != part[:-1])))
                end = np.append(new[1:], len(rep))
                a, b, kind = [], [], []
                two = end - new == 2
                first = new[two]
                near = alike(sig[first], sig[first + 1], LOOSE, LOOSE_TOLERANCE)
                a.append(rep[first + 1][near])
                b.append(rep[first][near])
                kind.append(np.zeros(near.sum(), np.int64))
                for x, y in zip(new[end - new > 2], end[end - new > 2], strict=True):
                    i, j = forest(sig[x:y])
                    a.append(rep[x:y][i])
                    b.append(rep[x:y][j])
                    kind.append(np.zeros(len(i), np.int64))
                for x, y in zip(new, end, strict=True):
                    if size[x] > BAND_BLOCK:  # leaders of a part meet those of the other parts in the next round
                        i, j, _ = band_links(sig[x:y])
                        tight = (sig[x:y][i] == sig[x:y][j]).mean(1) >= TIGHT
                        stay = np.setdiff1d(np.arange(y - x), i[tight])
                        a.append(rep[x:y][stay])
                        b.append(np.full(len(stay), band[x]))
                        kind.append(np.ones(len(stay), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(kind))], names=["a", "b", "kind"])

        made = saved(rows.repartition("band", "part").sortWithinPartitions("band", "part", "rep").mapInArrow(run, "a long, b long, kind long"), "links")
        links = made.where("kind = 0").select("a", "b")
        out = links if out is None else out.unionByName(links)
        stay = made.where("kind = 1").select(F.col("b").alias("band"), F.col("a").alias("rep"))
        sizes = stay.groupBy("band").agg(F.count("*").alias("n"))
        left = saved(stay.join(sizes, "band").select("band", "rep", "n"), "bands")
        n, before = left.count(), members.where(F.col("n") > BAND_BLOCK).count()
        drop_saved(members)
        members, rounds = left, rounds + 1
        if not n:
            return out.distinct()
        if n > 0.9 * before:  # little is alike: the parts' leaders meet in all pairs of blocks
            return out.unionByName(_block_pairs(members, classes)).distinct()


def _block_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of bands that leaders don't thin out: every pair of blocks of a band is one task's work."""
    half = BAND_BLOCK // 2
    rows = members.join(classes.select("rep", "signature"), "rep")
    blocks = F.ceil(F.col("n") / half).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.select("band", "rep", "signature", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("band", "rep", "signature", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, ["band", "i", "j"]):
            rep = t.column("rep").to_numpy()
            keys = np.stack([t.column(c).to_numpy() for c in ("band", "i", "j")])
            sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint32).reshape(-1, VALUES)
            new = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)))
            for x, y in zip(new, np.append(new[1:], len(rep)), strict=True):
                i, j = forest(sig[x:y])
                yield pa.RecordBatch.from_arrays([pa.array(rep[x:y][i]), pa.array(rep[x:y][j])], names=["a", "b"])

    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "rep").mapInArrow(run, "a long, b long")


# ---- connected components --------------------------------------------------------------------------------------------


def connected(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of each component of links (a, b). Labels spread and jump until none changes."""
    links = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    both = saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    drop_saved(links)
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = saved(step.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        drop_saved(labels)
        changed = new.where("label <> old").limit(1).count()
        labels = new
        if not changed:
            drop_saved(both)
            return labels.select("node", "label")


# ---- 4: verification -------------------------------------------------------------------------------------------------


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of 64-bit numbers, exactly."""
    n = len(sets)
    if n == 2:
        out = np.diag([len(x) for x in sets])
        out[0, 1] = out[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return out
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    uses = np.bincount(column, minlength=len(values))
    out = np.full((n, n), int((uses == n).sum()), np.int64)  # in all of them
    mid = (uses > 1) & (uses < n)
    number = np.cumsum(mid) - 1
    keep = mid[column]
    row, column = row[keep], number[column[keep]]
    step = max(256, (8 << 20) // n)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(mid.sum()), step):
        x, y = np.searchsorted(column, [first, first + step])
        dense = np.zeros((n, step), np.float32)
        dense[row[x:y], column[x:y] - first] = 1
        out += (dense @ dense.T).astype(np.int64)
    out[np.arange(n), np.arange(n)] = [len(x) for x in sets]
    return out


def survivors(sig: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which pairs i < j are left, STEP values at a time, by the posterior. side: 0 or 1; where both occur, only pairs across are asked for."""
    n = len(sig)
    alive = np.triu(np.ones((n, n), bool), 1)
    if side.any() and not side.all():
        alive &= side[:, None] != side[None, :]
    equal = np.zeros((n, n), np.int16)
    for k in range(0, VALUES, STEP):
        for c in range(k, k + STEP):
            equal += sig[:, c][:, None] == sig[:, c][None, :]
        alive &= equal >= least_equal(k + STEP, THRESHOLD, TOLERANCE)
        if not alive.any():
            break
    return alive


def verified(sig: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j that reach the threshold: the survivors by their signatures, then the exact sets of the rows that still have a partner."""
    alive = survivors(sig, side)
    rows = np.flatnonzero(alive.any(0) | alive.any(1))
    if not len(rows):
        return rows, rows
    both = overlaps([sets[i] for i in rows])
    size = np.array([len(sets[i]) for i in rows])
    # |a & b| / |a | b| >= threshold, in whole numbers where the threshold is a hundredth
    whole = round(THRESHOLD * 100)
    good = both * 100 >= whole * (size[:, None] + size[None, :] - both)
    good &= alive[np.ix_(rows, rows)]
    i, j = np.nonzero(good)
    return rows[i], rows[j]


def _blocks(rows: DataFrame) -> DataFrame:
    """rows of groups of n, once for each pair of blocks (i, j) of GROUP_BLOCK texts that its block is part of."""
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / GROUP_BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def _in_blocks(rows: DataFrame, run, schema: str) -> DataFrame:
    return rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "node").mapInArrow(run, schema)


def _paired(members: DataFrame, classes: DataFrame) -> DataFrame:
    """label, i, j, node, block: where members of groups of several blocks have a partner left, by their signatures alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, ["label", "i", "j"]):
            keys = np.stack([t.column(c).to_numpy() for c in ("label", "i", "j")])
            sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint32).reshape(-1, VALUES)
            new = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)))
            block, keep = t.column("block").to_numpy(), np.zeros(t.num_rows, bool)
            for x, y in zip(new, np.append(new[1:], t.num_rows), strict=True):
                alive = survivors(sig[x:y], block[x:y] != keys[1, x])
                keep[x:y] = alive.any(0) | alive.any(1)
            for batch in t.select(["label", "i", "j", "node", "block"]).filter(pa.array(keep)).combine_chunks().to_batches():
                yield batch

    rows = members.select("label", "n", "node").join(classes.select(F.col("rep").alias("node"), "signature"), "node")
    return _in_blocks(_blocks(rows), run, "label long, i int, j int, node long, block int")


def verify(docs: DataFrame, classes: DataFrame, groups: DataFrame, key: str, text: str) -> DataFrame:
    """rep, other, links: other links rep into a forest of the verified pairs; links are counts of verified partners, weighted by the partners' copies.

    Texts meet their members by keys alone; signatures are made again for these few. In a group of several blocks only
    texts that have a partner left by their signatures send their shingles, and only where that partner is.
    """
    sizes = groups.groupBy("label").agg(F.count("*").alias("n"))
    members = groups.join(sizes, "label").join(classes.select(F.col("rep").alias("node"), F.col("first.doc_id").alias("id"), F.col("first.digest").alias("digest"), "copies"), "node")
    members = saved(members.select("id", "digest", "node", "label", "n", "copies"), "members")
    texts = docs.select(F.col(key).cast("long").alias("id"), digest(text).alias("digest"), F.col(text).alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, buf, off in shards(batch.column(4), SHARD_BYTES):
                values, at = shingles(Scan(buf, off), WORDS)
                sig = pa.array([x.tobytes() for x in minhash(values, at)], pa.binary())
                own = [np.unique(values[at[i] : at[i + 1]]).tobytes() for i in range(end - begin)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(begin, end - begin) for i in range(4)), sig, pa.array(own, pa.binary())], names=["node", "label", "n", "copies", "signature", "shingles"])

    def shingled(some: DataFrame) -> DataFrame:
        rows = texts.join(small(some), ["id", "digest"]).select("node", "label", "n", "copies", "text")
        return rows.mapInArrow(sets, "node long, label long, n long, copies long, signature binary, shingles binary")

    rows = shingled(members.where(F.col("n") <= GROUP_BLOCK)).withColumns({c: F.lit(0) for c in ("block", "i", "j")})
    large = members.where(F.col("n") > GROUP_BLOCK)
    if not large.isEmpty():
        met = saved(_paired(large, classes), "paired")
        some = large.join(met.select("node").distinct(), "node", "left_semi").select(*members.columns)
        rows = rows.unionByName(shingled(some).join(met.drop("label"), "node").select(*rows.columns))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, ["label", "i", "j"]):
            name, label, low = (t.column(c).to_numpy() for c in ("node", "label", "i"))
            first = np.append(True, (name[1:] != name[:-1]) | (label[1:] != label[:-1]) | (low[1:] != low[:-1]) | (t.column("j").to_numpy()[1:] != t.column("j").to_numpy()[:-1]))
            if not first.all():  # rows that repeat a doc_id and its text
                t = t.filter(pa.array(first))
            node, copies, block = (t.column(c).to_numpy() for c in ("node", "copies", "block"))
            keys = np.stack([t.column(c).to_numpy() for c in ("label", "i", "j")])
            sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint32).reshape(-1, VALUES)
            own = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            new = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)))
            out = []
            for x, y in zip(new, np.append(new[1:], len(node)), strict=True):
                side = (block[x:y] != keys[1, x]).astype(np.int64)
                i, j = verified(sig[x:y], own[x:y], side)
                if not len(i):
                    continue
                low = components(y - x, i, j)
                n = y - x
                links = np.bincount(i, copies[x:y][j], n) + np.bincount(j, copies[x:y][i], n)
                some = np.flatnonzero(links)
                out.append((node[x:y][some], node[x:y][low[some]], links[some].astype(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["rep", "other", "links"])

    return _in_blocks(rows, check, "rep long, other long, links long")


# ---- the whole -------------------------------------------------------------------------------------------------------


def classed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, digest, kept (doc_id and digest of the first text of the row's component), n_links: one row for each row of docs."""
    sketches = saved(sketch(docs, key, text), "sketches")
    known = sketches.where("doc_id is not null and words is not null")
    place = F.struct("doc_id", "digest")
    # one signature for each partition and class is shuffled, however many copies there are
    reps = known.groupBy("words").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.min_by(F.struct("signature", "bands"), place).alias("s"))
    reps = reps.select("words", "first", "copies", "s.signature", "s.bands")
    # numbered in the order of their first texts: copies of one text then have the same leader, it, in every band
    classes = saved(reps.orderBy("first").withColumn("rep", F.monotonically_increasing_id()), "classes")
    candidates = connected(links_in_bands(classes))
    pairs = saved(verify(docs, classes, candidates, key, text), "verified")
    links = pairs.groupBy("rep").agg(F.sum("links").alias("links"))
    final = connected(pairs.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    linked = classes.select("rep", "words", "first", "copies").join(final.select(F.col("node").alias("rep"), "label"), "rep", "left").join(links, "rep", "left")
    kept = linked.where("label is not null").groupBy("label").agg(F.min("first").alias("kept"))
    # a class of one row without links needs no row here
    by_words = linked.where("label is not null or copies > 1").join(kept, "label", "left")
    by_words = by_words.select("words", F.coalesce("kept", "first").alias("kept"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = sketches.select("doc_id", "digest", F.when(F.col("doc_id").isNotNull(), F.col("words")).alias("words")).join(by_words, "words", "left")
    return out.select("doc_id", "digest", F.coalesce("kept", F.struct("doc_id", "digest")).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, n_links: one row for each row of docs.

    class_id: the smallest doc_id of the connected component of texts with a Jaccard of 0.8 or more over five-word
    shingles. n_links: how many other documents (copies too) have that similarity with this one. Texts without words
    (null, empty, punctuation) are alike to nothing: their own class, no links; so are rows without a doc_id, whose
    class_id is null. Very long texts are taken whole, one at a time (some 30 bytes of memory for each of theirs). Rows that repeat a doc_id with one text count as copies; of a doc_id with several texts, each row
    has the class and links of its own text. An empty table gives an empty result. Extra columns are not read.
    """
    return classed(docs, key, text).select("doc_id", F.col("kept.doc_id").alias("class_id"), "n_links")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group: one whose doc_id is the class_id. Rows without a doc_id stay.

    Of rows that repeat a doc_id and its text one stays; a doc_id's other texts stay unless they are copies themselves.
    Texts without words (null, empty) are copies of nothing and stay; an empty table stays empty; other columns of any
    name stay as they are.
    """
    name, same, own = fresh(docs, "_name", "_same", "_own")
    rows = saved(classed(docs, key, text).where("doc_id is not null").select(F.col("doc_id").alias(name), F.col("digest").alias(same), ((F.col("doc_id") == F.col("kept.doc_id")) & (F.col("digest") == F.col("kept.digest"))).alias("stays")), "rows")
    marked = docs.where(F.col(f"`{key}`").isNotNull()).withColumn(own, digest(text))
    met = (F.col(f"`{key}`").cast("long") == F.col(name)) & (F.col(own) == F.col(same))
    # texts meet keys: those of what goes, and of the rows that repeat one another; other texts stay where they are
    out = marked.join(small(rows.where("not stays").select(name, same).distinct()), met, "left_anti")
    again = saved(rows.where("stays").groupBy(name, same).agg(F.count("*").alias("n")).where("n > 1").select(name, same), "again")
    if not again.isEmpty():
        once = out.join(small(again), met, "left_semi").dropDuplicates([key, own])
        out = out.join(small(again), met, "left_anti").unionByName(once)
    return out.drop(own).unionByName(docs.where(F.col(f"`{key}`").isNull()))
