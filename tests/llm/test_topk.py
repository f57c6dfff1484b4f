"""Exact top-k search against brute force, with exact and with wide cells, one and several blocks and spans."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tonearm.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, k=20):
    """Of each distinct query (id and vector): all rows of other ids and its length, best first."""
    kept = [(i, tuple(np.floor(64 * np.array(v, np.float64)).astype(int).tolist())) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) and abs(x) < 1e7 for x in v)]
    out = []
    for i, q in {x for x in kept if x[0] % 20 == 0}:
        scores = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in kept if j != i and len(v) == len(q)))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(1)
    v = r.standard_normal((260, 8)).astype(np.float32)
    v[50:130] = v[0]  # a large group of equal vectors
    v[131] = v[130] + 0.001
    out = [(i, [float(x) for x in v[i]], "e") for i in range(260)]
    out += [(20, out[20][1], "again"), (21, out[21][1], "again"), (40, out[41][1], "another"), (7, out[60][1], "e")]
    return [*out, (400, None, "e"), (420, [float("nan")] * 8, "e"), (440, [1.0, 2.0], "e"), (460, [], "e"), (480, [1.0, None], "e"), (None, out[1][1], "e"), (441, [1.0, -2.0], "e"), (500, [float("inf")] * 8, "e"), (520, [1e10] * 8, "e"), (521, [1e10] * 8, "e"), (540, [1e30, 0.0], "e"), (560, [5e6, -5e6], "e"), (561, [-5e6, 4e6], "e")]


@pytest.mark.parametrize(("bits", "block", "span", "asked"), [(6, 16384, 64, (512, 4096)), (8, 16384, 64, (512, 4096)), (3, 40, 64, (4, 4)), (2, 40, 2, (4, 4)), (1, 16384, 64, (512, 4096))])
def test_against_brute_force(spark, rows, monkeypatch, bits, block, span, asked):
    for name, value in (("CELL_BITS", bits), ("CELL_BLOCK", block), ("SPAN", span), ("QUERY_BLOCK", asked), ("SUB", 16)):
        monkeypatch.setattr(topk, name, value)
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]


def test_sql_agrees_on_repeated_rows(spark, rows):
    embeddings = pd.DataFrame([r[:2] for r in rows], columns=["vec_id", "embedding"]).astype({"vec_id": "Int64"})  # noqa: F841
    db = duckdb.connect()
    db.execute("create table embeddings (vec_id bigint, embedding float[])")
    db.executemany("insert into embeddings values (?, ?)", [r[:2] for r in rows])
    assert sorted(db.sql(queries.OP9).fetchall()) == brute(rows)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5], ""), (1, [0.5, 1.0], ""), (2, [-1.0, 0.0], "")], SCHEMA)
    assert sorted(map(tuple, topk.top_k(df).collect())) == [(0, 1, 1, 4096), (0, 2, 2, -4096)]
    assert topk.top_k(df.where("vec_id = 0")).collect() == [] == topk.top_k(df.limit(0)).collect() == topk.top_k(df.where("vec_id = 1")).collect()


def test_bounds_hold(rows):
    """Lower and upper bounds of a wide grid enclose the exact products."""
    r = np.random.default_rng(2)
    q, v = r.integers(-50, 50, (20, 6)), r.integers(-50, 50, (300, 6))
    s = topk.Scan(np.arange(20), np.arange(20) + 1000, q, 300, -50, 16)
    s.look(np.arange(300), np.arange(300), ((v + 50) // 16).astype(np.uint8))
    got = s.left().to_pandas()
    exact = (q @ v.T)[got.q_row, got.row]
    assert len(got) == 6000 and (got.lower <= exact).all() and (exact <= got.upper).all()
