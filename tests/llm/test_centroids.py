"""Clustering against the plain rule in Python's integers, and against SQL."""

import hashlib

import duckdb
import numpy as np
import pytest

from tonearm.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def plain(rows, k, rounds, dim):
    whole = [(i, [int(np.floor(1024 * float(c))) for c in v]) for i, v, *_ in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) and abs(c) < 1e6 for c in v)]
    start = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in whole)[:k]
    cs = [x for _, x in start]
    apart = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    nearest = lambda x: min((apart(x, c), j) for j, c in enumerate(cs))[1]
    for _ in range(rounds):
        at = [nearest(x) for _, x in whole]
        for j in range(len(cs)):
            mine = [x for (_, x), a in zip(whole, at, strict=True) if a == j]
            if mine:
                cs[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    at = [nearest(x) for _, x in whole]
    far = [apart(x, cs[a]) for (_, x), a in zip(whole, at, strict=True)]
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return [(i, a, d, sum(f for f, b in zip(far, at, strict=True) if b == a), sum(far), digest(cs[a])) for (i, _), a, d in zip(whole, at, far, strict=True)]


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    centre = r.standard_normal((5, 6))
    v = (centre[r.integers(0, 5, 300)] + r.standard_normal((300, 6)) * 0.4).astype(np.float32)
    v[40:120] = v[0]  # a large group of equal vectors
    v[130:150] = np.round(v[130:150])  # ties
    out = [(i, [float(c) for c in v[i]], "x") for i in range(300)]
    out += [(7, out[8][1], "again"), (7, out[7][1], "again"), (None, out[9][1], "x"), (None, out[10][1], "x")]
    return [*out, (900, None, "x"), (901, [], "x"), (902, [1.0] * 5, "x"), (903, [1.0, None] * 3, "x"), (904, [float("nan")] * 6, "x"), (905, [float("inf")] * 6, "x"), (906, [1e30] * 6, "x"), (907, [-1e12, 0.0, 0.0, 0.0, 0.0, 0.0], "x")]


def key(r):
    return tuple(-1 if c is None else c for c in r)


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (3, 4), (1, 2), (8, 0)])
def test_against_the_plain_rule(spark, rows, k, rounds):
    log = []
    got = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), k, rounds, dim=6, log=log)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, k, rounds, 6), key=key)
    if rounds == 10:  # the bounds decide most vectors
        assert log[0]["scanned"] == log[0]["rows"] and all(x["scanned"] < x["rows"] / 2 for x in log[2:]) and len(log) > 3


def test_sql(rows):
    db = duckdb.connect()
    db.execute("create table embeddings (vec_id bigint, embedding float[])")
    db.executemany("insert into embeddings values (?, ?)", [r[:2] for r in rows])
    assert sorted(db.sql(centroids.sql(8, 10, dim=6)).fetchall(), key=key) == sorted(plain(rows, 8, 10, 6), key=key)


def test_few_equal_and_none(spark):
    few = [(i, [float(i), 0.0], "") for i in (1, 2, 3)]
    assert sorted(map(tuple, centroids.cluster(spark.createDataFrame(few, SCHEMA), dim=2).collect())) == sorted(plain(few, 8, 10, 2))
    same = [(i, [0.25, -0.25], "") for i in range(20)]  # all centroids are equal: the first gets all
    got = centroids.cluster(spark.createDataFrame(same, SCHEMA), dim=2).collect()
    assert sorted(map(tuple, got)) == sorted(plain(same, 8, 10, 2)) and {r["cluster"] for r in got} == {0}
    large = [(i, [c, 0.0], "") for i, c in enumerate((9e5, -9e5, 8e5, 1e5))]
    assert sorted(map(tuple, centroids.cluster(spark.createDataFrame(large, SCHEMA), 2, dim=2).collect())) == sorted(plain(large, 2, 10, 2))
    empty = centroids.cluster(spark.createDataFrame(few, SCHEMA).limit(0), dim=2)
    assert empty.collect() == [] and empty.columns == got[0].__fields__
