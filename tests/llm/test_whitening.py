"""Whitening against one eigendecomposition of the whole covariance; merges against one decomposition."""

import numpy as np
import pytest

from tonearm.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n string"


def plain(rows, most=16):
    """(vec_id, component): n, deviation, |whitened|, explained of vectors of one length."""
    good = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v, *_ in rows if v and all(c is not None and np.isfinite(c) and abs(c) < 2**34 for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    apart = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit]) / n
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in good:
        d = [n * c - s for c, s in zip(x, sums, strict=True)]
        for j in range(min(most, len(values))):
            if values[j] > values[0] * 1e-15:
                w = np.array(d) / n @ vectors[:, j] / np.sqrt(values[j])
                out.setdefault((i, j + 1), []).append((n, sum(c * c for c in d), abs(w), values[j] / values.sum()))
    return {k: sorted(v) for k, v in out.items()}


def check(got, want):
    found = {}
    for r in got:
        found.setdefault((r["vec_id"], r["component"]), []).append((r["n"], r["deviation"], abs(r["whitened"]), r["explained"]))
    assert found.keys() == want.keys()
    for k, v in found.items():
        for a, b in zip(sorted(v), want[k], strict=True):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-7, abs=1e-7)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(8)
    v = (r.standard_normal((400, 20)) * np.geomspace(9, 0.5, 20) + 30).astype(np.float32)
    v[100:200] = v[0]
    out = [(i, [float(c) for c in v[i]], "x") for i in range(400)]
    return [*out, (5, out[6][1], "x"), (None, out[3][1], "x"), (900, None, "x"), (901, [], "x"), (902, [1.0, None] * 10, "x"), (903, [float("nan")] * 20, "x"), (904, [float("-inf")] * 20, "x"), (905, [1e30] * 20, "x")]


@pytest.mark.parametrize(("parts", "fan", "rows_at_once"), [(1, 16, 1024), (7, 2, 16), (40, 3, 5)])
def test_against_one_decomposition(spark, rows, monkeypatch, parts, fan, rows_at_once):
    for name, value in (("FAN", fan), ("ROWS", rows_at_once), ("OUT_ROWS", 50)):
        monkeypatch.setattr(whitening, name, value)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got, plain(rows))
    sign = {}  # a component has one sign for all rows
    for r in got:
        sign.setdefault((r["vec_id"], r["component"]), r["whitened"])
    assert np.isclose(sign[5, 1], sign[6, 1]) or np.isclose(sign[5, 1], [r["whitened"] for r in got if r["vec_id"] == 5 and r["component"] == 1]).any()


def test_merges_lose_nothing():
    r = np.random.default_rng(2)
    x = r.integers(-40, 40, (50, 8)) + 1_000_000
    x[:, 5] = x[:, 4]  # rank is lost in the data, not in the merges
    one = whitening.Decomposition.of(x[:3])
    for a, b in ((3, 4), (4, 30), (30, 50)):
        one = one.merged(whitening.Decomposition.of(x[a:b]))
    whole = whitening.Decomposition.of(x)
    assert one.n == 50 and one.sums == x.sum(0).tolist() and len(one.s) == 8
    assert one.s == pytest.approx(whole.s, abs=1e-9)
    assert np.allclose((one.s[:, None] * one.v).T @ (one.s[:, None] * one.v), (x - x.mean(0)).T @ (x - x.mean(0)))


def test_little_variance_lengths_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [3.0, 2.0], ""), (2, [3.0, 2.0], ""), (3, [1.0, 2.0, 3.0], ""), (4, [0.0, 0.5, 3.0], ""), (5, [7.0], "")], SCHEMA)
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], abs(round(r["whitened"], 9)), round(r["explained"], 9)) for r in got) == [
        (1, 1, 2, 128**2, 1.0, 1.0), (2, 1, 2, 128**2, 1.0, 1.0), (2, 1, 2, 128**2, 1.0, 1.0), (3, 1, 2, 64**2 + 96**2, 1.0, 1.0), (4, 1, 2, 64**2 + 96**2, 1.0, 1.0)]
    assert whitening.whiten(df.limit(0)).collect() == [] == whitening.whiten(df.where("vec_id = 5")).collect()


def test_large_entries(spark):
    large = [(1, [1e10, 1.0], ""), (2, [-1e10, 2.0], ""), (3, [5e9, 5.0], "")]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(spark.createDataFrame(large, SCHEMA)).collect()}
    assert got[1, 1]["deviation"] is None and got[1, 1]["n"] == 3 and abs(got[1, 1]["whitened"]) < 3


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(queries.op13_embedding_whitening(spark, sf).collect(), plain(rows))
