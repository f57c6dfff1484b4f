"""Centroid clustering of integer vectors in rounds of assignment and exact means, with Hamerly's bounds.

Every vector keeps, beside its cluster, an upper bound of the distance to its centroid and a lower bound of that to the second
nearest one. When centroids move, the bounds are loosened by their drift: the upper one by that of its own centroid, the lower
one by the largest of the others. A vector whose upper bound stays below its lower bound, or below half the distance from its
centroid to the next centroid, can't change its cluster. Of the rest the distance to their own centroid is taken exactly; those
that are still ambiguous get a full scan of all centroids in integers. Bounds are rounded outwards, and ties count as ambiguous.

A round is one pass: the table of vectors with their bounds is written anew into the shared folder, and at the end of each task
follow the sums of its vectors for each cluster, in columns of their own, so that reading the sums reads no vectors. Only sums
of tasks are shuffled; the driver sees k centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_saved, saved

#: Vectors worked on at a time.
ROWS = 8192
#: Bounds are rounded outwards by this share.
OFF = 1e-12
#: The largest squared length of an integer vector: squared distances then are below 2 ** 63.
LONGEST = 2.0**60


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, dim: int = 64) -> DataFrame:
    """(vec_id, x): floor(scale * c) of each component c as double, of vectors with exactly dim components, none null or non-finite, and no longer than LONGEST."""
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).alias("e")).where((F.size("e") == dim) & finite)
    whole = rows.select("vec_id", F.transform("e", lambda c: F.floor(c.cast("double") * scale)).alias("x"), F.transform("e", lambda c: c.cast("double") * scale).alias("e"))
    # a component that is floored may grow by one
    return whole.where(F.aggregate("e", F.lit(0.0), lambda a, c: a + (F.abs(c) + 1) * (F.abs(c) + 1)) <= LONGEST).select("vec_id", "x")


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose key has the smallest sha256 of seed and key; equal hashes by the components."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["x"] for r in vectors.select(digest.alias("h"), "x").orderBy("h", "x").limit(k).collect()], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Round:
    """One assignment: the centroids, and since the round before their drift."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None):
        self.c, self.first = now, before is None
        drift = np.zeros(len(now)) if before is None else np.sqrt(squared(now, before).astype(float)) * (1 + OFF)
        # of the others, the one that moved most: the second where it is the centroid itself
        order = np.argsort(-drift, kind="stable")
        self.own = drift
        self.others = np.where(np.arange(len(now)) == order[0], drift[order[1]] if len(now) > 1 else 0.0, drift[order[0]])
        gaps = np.array([[np.inf if i == j else squared(a[None], b)[0] for j, b in enumerate(now)] for i, a in enumerate(now)], float)
        self.half = np.sqrt(gaps.min(1)) / 2 * (1 - OFF)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Work cluster, upper and lower over; how many vectors got a full scan."""
        if self.first:
            left = np.arange(len(x))
        else:
            upper[:] = (upper + self.own[cluster]) * (1 + OFF)
            lower[:] = np.maximum(0.0, (lower - self.others[cluster]) * (1 - OFF))
            bar = np.maximum(lower, self.half[cluster])
            left = np.flatnonzero(upper >= bar)
            upper[left] = np.sqrt(squared(x[left], self.c[cluster[left]]).astype(float)) * (1 + OFF)
            left = left[upper[left] >= bar[left]]
        if len(left):
            all_of = np.stack([squared(x[left], c) for c in self.c], axis=1)
            cluster[left] = all_of.argmin(1)  # of equal distances the first, which has the smaller number
            near = np.sort(all_of, axis=1)[:, :2].astype(float)
            upper[left] = np.sqrt(near[:, 0]) * (1 + OFF)
            lower[left] = np.sqrt(near[:, 1]) * (1 - OFF) if len(self.c) > 1 else np.inf
        return len(left)


def assigned(vectors: DataFrame, now: np.ndarray, before: np.ndarray | None, last: bool) -> DataFrame:
    """vectors (vec_id, x and, but for the first round, their state) with the new state; after each task's rows its sums: cluster, n, scanned, total.

    last: with exact squared distances instead of vectors and bounds, and their sums instead of those of vectors.
    """
    key = vectors.schema["vec_id"]
    schema = T.StructType([key, *T._parse_datatype_string("cluster int, x array<bigint>, upper double, lower double, distance bigint, n bigint, scanned bigint, total array<decimal(38,0)>").fields])
    k, dim = now.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = Round(now, before)
        counts, scanned = np.zeros(k, np.int64), 0
        sums = [[0] * (1 if last else dim) for _ in range(k)]
        empty = lambda n: {f.name: pa.nulls(n, t) for f, t in zip(schema.fields, types, strict=True)}
        types = [None, pa.int32(), pa.list_(pa.int64()), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0))]
        for batch in batches:
            types[0] = batch.schema.field("vec_id").type
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                x = some.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                cluster, upper, lower = (some.column(c).to_numpy(zero_copy_only=False).copy() if not step.first else np.zeros(len(x), t) for c, t in (("cluster", np.int32), ("upper", float), ("lower", float)))
                scanned += step.assign(x, cluster, upper, lower)
                out = empty(len(x)) | {"vec_id": some.column("vec_id"), "cluster": pa.array(cluster, pa.int32())}
                far = squared(x, now[cluster]) if last else None
                out |= {"distance": pa.array(far)} if last else {"x": some.column("x"), "upper": pa.array(upper), "lower": pa.array(lower)}
                for j in np.unique(cluster):
                    mine = cluster == j
                    counts[j] += mine.sum()
                    part = [sum(far[mine].tolist())] if last else x[mine].sum(0).tolist()
                    sums[j] = [a + b for a, b in zip(sums[j], part, strict=True)]
                yield pa.RecordBatch.from_pydict(out)
        if types[0] is not None:
            here = np.flatnonzero(counts)
            out = empty(len(here)) | {"cluster": pa.array(here, pa.int32()), "n": pa.array(counts[here]), "scanned": pa.array([scanned if j == here[0] else 0 for j in here], pa.int64())}
            yield pa.RecordBatch.from_pydict(out | {"total": pa.array([[_decimal(s) for s in sums[j]] for j in here], types[-1])})

    return vectors.mapInArrow(run, schema)


def _decimal(n: int):
    from decimal import Decimal

    return Decimal(n)


def totals(state: DataFrame) -> dict[int, tuple[int, list[int], int]]:
    """Of each cluster that has vectors: their number, the sums and how many were scanned. The sums of tasks are added in Spark; k rows of each component come here."""
    each = state.where(F.col("n").isNotNull()).select("cluster", "n", "scanned", F.posexplode("total").alias("i", "s"))
    rows = each.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("scanned").alias("scanned"), F.sum("s").alias("s")).collect()
    out: dict[int, tuple[int, list[int], int]] = {}
    for r in sorted(rows, key=lambda r: (r["cluster"], r["i"])):
        n, s, seen = out.setdefault(r["cluster"], (int(r["n"]), [], int(r["scanned"])))
        s.append(int(r["s"]))
    return out


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, dim: int = 64, seed: str = "3:", log: list[dict] | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that integer_vectors() keeps.

    Centroids 0, 1, ... start as the k vectors of smallest sha256 of seed and key, equal hashes in the order of their components.
    Each round assigns every vector to the nearest centroid by squared distance, ties to the smaller number, and moves each
    centroid that has vectors to floor(sum / count) of every component; then vectors are assigned once more. Rounds that move
    no centroid end the iteration, as all later ones would repeat it.

    Left out are vectors that are null, of another length, hold null or non-finite components, or whose integers have a squared
    length above 2 ** 60, as distances would be no longs. A null key is kept and hashed as an empty one. Rows that repeat a key
    are vectors each. With fewer than k vectors there are as many centroids; an empty table gives an empty result. Sums of
    distances that are no longs are null. Extra columns are not read. log, if given, gets the vectors scanned in each round.
    """
    vectors = integer_vectors(df, key, vector, scale, dim)
    now, before = first_centroids(vectors, k, seed), None
    spark = df.sparkSession
    out = T.StructType([vectors.schema["vec_id"], *T._parse_datatype_string("cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string").fields])
    if not len(now):
        return spark.createDataFrame([], out)
    state, done = vectors, 0
    while done < rounds and (before is None or not np.array_equal(now, before)):
        new = saved(assigned(state, now, before, False), "state")
        if done:
            drop_saved(state)
        found = totals(new)
        if log is not None:
            log.append({"scanned": sum(x[2] for x in found.values()), "rows": sum(x[0] for x in found.values())})
        state = new.where(F.col("n").isNull())
        before, now = now, np.array([[s // found[j][0] for s in found[j][1]] if j in found else c for j, c in enumerate(now.tolist())], np.int64)
        done += 1
    near = saved(assigned(state, now, before, True), "nearest")
    if done:
        drop_saved(state)
    found = totals(near)
    long = lambda n: n if n < 2**63 else None
    every = sum(x[1][0] for x in found.values())
    named = [Row(cluster=j, cluster_inertia=long(s[0]), inertia=long(every), centroid_sha256=hashlib.sha256(",".join(map(str, now[j].tolist())).encode()).hexdigest()) for j, (_, s, _) in found.items()]
    about = spark.createDataFrame(named, T.StructType([f for f in out.fields if f.name not in ("vec_id", "distance")]))
    return near.where(F.col("n").isNull()).select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select(*out.names)  # about: k rows


def sql(k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, seed: str = "3:") -> str:
    """The same in DuckDB's SQL, over embeddings."""
    whole = f"{scale} * CAST(c AS DOUBLE)"
    parts = [
        f"""f AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(e, lambda c: CAST(floor({whole}) AS BIGINT)) AS x FROM f
  WHERE list_sum(list_transform(e, lambda c: (abs({whole}) + 1) * (abs({whole}) + 1))) <= {LONGEST}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS cluster, x AS c FROM (SELECT sha256('{seed}' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))"""
    ]
    for i in range(rounds + 1):
        apart = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        parts.append(f"d{i} AS (SELECT r, vec_id, x, cluster, CAST({apart} AS BIGINT) AS distance FROM v, c{i})")
        parts.append(f"a{i} AS MATERIALIZED (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT cluster, i, sum(CAST(s AS HUGEINT)) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY ALL)")
            parts.append(f"n{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM m{i} GROUP BY cluster)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN n{i} n USING (cluster))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(list_aggregate(c, 'string_agg', ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"""
