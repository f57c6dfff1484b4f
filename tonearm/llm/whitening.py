"""Whitening of embeddings by merging singular value decompositions, level by level, without losing a dimension.

1. The fit list is each distinct integer vector once, by one distinct over all rows.
2. Every partition of it keeps its number of vectors, their exact sums and the full-rank singular values and vectors of what is
   left of them after their mean is taken away.
3. Two of these are merged by stacking singular values times vectors of both and one row that corrects for their means,
   sqrt(n m / (n + m)) times the difference of the means, and decomposing again. Groups of FAN are merged in a task, level by
   level, until one is left: nothing is squared, so no digits are lost to it, and no dimension is dropped.
4. The components are the right singular vectors; a last pass over the fit list measures the covariance of what they whiten.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

#: What is added to each floored entry; the largest of these (sums of 2 ** 40 of them fit into 38 digits).
SHIFT, LARGEST = 1_000_000, 2.0**40
#: Vectors decomposed at a time, decompositions merged by one task, and vectors whitened at a time.
ROWS, FAN, OUT_ROWS = 1024, 16, 4096
#: Singular values below this share of the largest are rounding errors of a component without variance.
NOTHING = 1e-11

PARTS = "dim int, part bigint, n bigint, sums array<decimal(38,0)>, s array<double>, v binary"


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, x): floor(scale * c) + SHIFT of each entry c as double. Left out are vectors that are null or empty or hold a null or non-finite entry, or one that LARGEST is too small for."""
    good = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * scale <= LARGEST))
    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).alias("e")).where(F.col("e").isNotNull() & (F.size("e") > 0) & good)
    return rows.select("vec_id", F.transform("e", lambda c: F.floor(c.cast("double") * scale) + F.lit(SHIFT).cast("long")).alias("x"))


class Decomposition:
    """Of n vectors: their exact sums, and singular values and right singular vectors of the vectors without their mean."""

    def __init__(self, n: int, sums: list[int], s: np.ndarray, v: np.ndarray):
        self.n, self.sums, self.s, self.v = n, sums, s, v

    @classmethod
    def of(cls, x: np.ndarray) -> Decomposition:
        n, sums = len(x), x.sum(0)
        _, s, v = np.linalg.svd((n * x - sums) / n, full_matrices=False)  # integers until here: 2 ** 40 * ROWS
        return cls(n, sums.tolist(), s, v)

    def merged(self, other: Decomposition) -> Decomposition:
        a, b = self.n, other.n
        apart = np.array([(x * b - y * a) / (a * b) for x, y in zip(self.sums, other.sums, strict=True)])
        rows = np.concatenate([self.s[:, None] * self.v, other.s[:, None] * other.v, np.sqrt(a * b / (a + b)) * apart[None]])
        _, s, v = np.linalg.svd(rows, full_matrices=False)
        return Decomposition(a + b, [x + y for x, y in zip(self.sums, other.sums, strict=True)], s, v)

    def row(self, dim: int, part: int) -> pa.Table:
        columns = {"dim": pa.array([dim], pa.int32()), "part": pa.array([part], pa.int64()), "n": pa.array([self.n], pa.int64())}
        columns |= {"sums": pa.array([[Decimal(x) for x in self.sums]], pa.list_(pa.decimal128(38, 0))), "s": pa.array([self.s.tolist()], pa.list_(pa.float64())), "v": pa.array([self.v.tobytes()], pa.binary())}
        return pa.table(columns)

    @classmethod
    def read(cls, r: dict) -> Decomposition:
        return cls(r["n"], [int(x) for x in r["sums"]], np.array(r["s"]), np.frombuffer(r["v"]).reshape(len(r["s"]), r["dim"]))


def by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the lists of each length: their places, and they themselves as rows of a matrix."""
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[(ends[at] - d)[:, None] + np.arange(d)]


def parts(fit: DataFrame) -> DataFrame:
    """A decomposition of each partition's vectors, for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Decomposition] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for _, x in by_length(batch.slice(at, ROWS).column(0)):
                    d, one = x.shape[1], Decomposition.of(x)
                    found[d] = found[d].merged(one) if d in found else one
        for d, one in found.items():
            yield from one.row(d, TaskContext.get().partitionId()).to_batches()

    return fit.select("x").mapInArrow(run, PARTS)


def merge(group: pa.Table) -> pa.Table:
    """The decompositions of a group in one."""
    rows = sorted(group.to_pylist(), key=lambda r: r["part"])
    one = Decomposition.read(rows[0])
    for r in rows[1:]:
        one = one.merged(Decomposition.read(r))
    return one.row(rows[0]["dim"], rows[0]["part"] // FAN)


class Model:
    """What whitens vectors of one length: exact n and sums, and `most` components at most, by falling eigenvalue."""

    def __init__(self, one: Decomposition, most: int):
        self.n, self.sums = one.n, one.sums
        kept = min(most, int((one.s > one.s[0] * NOTHING).sum())) if len(one.s) and one.s[0] > 0 else 0
        values = one.s**2 / one.n
        v = one.v[:kept]
        v = v * np.sign(v[np.arange(kept), np.abs(v).argmax(1)])[:, None] if kept else v
        self.project = (v / np.sqrt(values[:kept])[:, None]).T
        self.explained = values[:kept] / values.sum() if kept else np.zeros(0)

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly; as Python's integers where longs could overflow."""
        base, near = self.n * SHIFT, x - SHIFT
        most = self.n * int(np.abs(near).max(initial=0)) + max(abs(s - base) for s in self.sums)
        if most >= 2**62:
            near = near.astype(object)
        return self.n * near - np.array([s - base for s in self.sums], near.dtype)

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        return (apart.astype(float) / self.n) @ self.project

    @staticmethod
    def deviation(apart: np.ndarray) -> list[int | None]:
        """Sums of squares; null where they are no longs."""
        if apart.dtype != object and (int(np.abs(apart).max(initial=0)) ** 2) * apart.shape[1] < 2**63:
            return (apart * apart).sum(1).tolist()
        return [s if (s := sum(int(a) ** 2 for a in r)) < 2**63 else None for r in apart.tolist()]


def fitted(fit: DataFrame, most: int) -> dict[int, Model]:
    """A model for each length. The driver gets one decomposition for each length, of d * d numbers, however many vectors there are."""
    now = saved(parts(fit), "parts")
    last = now.agg(F.max("part")).first()[0]
    while last:
        now = now.groupBy("dim", F.floor(F.col("part") / FAN).alias("_p")).applyInArrow(lambda g: merge(g), PARTS)
        last //= FAN
    return {r["dim"]: Model(Decomposition.read(r.asDict()), most) for r in now.collect()}


def identity_error(fit: DataFrame, models: dict[int, Model]) -> float | None:
    """The largest entry, without its sign, of the covariance of the whitened fit list minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                for _, x in by_length(batch.slice(at, OUT_ROWS).column(0)):
                    m = models[x.shape[1]]
                    w = m.whitened(m.apart(x))
                    one = np.concatenate([w.sum(0), (w.T @ w).ravel()])
                    sums[x.shape[1]] = sums.get(x.shape[1], 0.0) + one
        for d, one in sums.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([d], pa.int32()), "sums": pa.array([one.tolist()], pa.list_(pa.float64()))})

    rows = fit.select("x").mapInArrow(run, "dim int, sums array<double>").select("dim", F.posexplode("sums").alias("i", "s")).groupBy("dim", "i").agg(F.sum("s").alias("s")).collect()
    worst = None
    for d in {r["dim"] for r in rows}:
        flat = np.array([r["s"] for r in sorted((r for r in rows if r["dim"] == d), key=lambda r: r["i"])]) / models[d].n
        k = models[d].project.shape[1]
        if k:
            mean, cov = flat[:k], flat[k:].reshape(k, k)
            worst = max(worst or 0.0, float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max()))
    return worst


def whiten(df: DataFrame, most: int = 16, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: `most` rows at most for each vector.

    Vectors that are null, hold a null or non-finite entry or one beyond 2 ** 40 / scale are left out; empty ones have no
    components. Vectors of different lengths are fitted and whitened by length. A component without variance (its singular
    value is below 1e-11 of the largest) can't be whitened and gives no rows: a fit list of m vectors has m - 1 components at
    most, and one vector alone gives none. A deviation that is no long is null. Null and repeated keys are rows like others;
    repeated vectors count once in the fit list and are all returned. An empty table gives an empty result. Extra columns are
    not read.
    """
    vectors = integer_vectors(df, key, vector, scale)
    fit = saved(vectors.select("x").distinct(), "fit")
    models = fitted(fit, most)
    error = identity_error(fit, models) if models else None
    kind = vectors.schema["vec_id"]
    schema = T.StructType([kind, *T._parse_datatype_string("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                some = batch.slice(at, OUT_ROWS)
                for places, x in by_length(some.column("x")):
                    m = models[x.shape[1]]
                    k, rows = m.project.shape[1], len(x)
                    apart = m.apart(x)
                    out = {"vec_id": some.column("vec_id").take(pa.array(np.repeat(places, k))), "component": pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), "n": pa.array(np.full(rows * k, m.n), pa.int64())}
                    deviation = pa.array(m.deviation(apart), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
                    yield pa.RecordBatch.from_pydict(out | {"deviation": deviation, "whitened": pa.array(m.whitened(apart).ravel()), "explained": pa.array(np.tile(m.explained, rows)), "identity_error": pa.array(np.full(rows * k, error if error is not None else np.nan))})

    return vectors.mapInArrow(run, schema)
