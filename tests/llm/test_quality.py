"""The quality classifier against a plain scorer of one text, its gradient, held-out accuracy and odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonearm.llm import quality as Q

SF = "/root/testdata/sf0.001"


def plain_vectors(text):
    """The passages' vectors of one text, token by token and byte by byte."""
    b = (text or "").encode()
    tokens = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", b)]
    out = []
    for at in range(0, max(1, len(tokens)), Q.PASSAGE):
        own = tokens[at : at + Q.PASSAGE]
        x = [0.0] * Q.WIDTH
        if own:
            raw = b[own[0][0] : tokens[at + Q.PASSAGE][0] if at + Q.PASSAGE < len(tokens) else len(b)]
            grams = Counter()
            for i in range(len(raw) - 2):
                code = ((raw[i] * 0x9E3779B1 + raw[i + 1]) * 0x85EBCA6B + raw[i + 2]) * 0xC2B2AE35 % 2**32
                grams[code >> 23] += 1
            norm = math.sqrt(sum(math.log1p(n) ** 2 for n in grams.values())) + 1e-6
            for k, n in grams.items():
                x[k] = math.log1p(n) / norm
            words = [b[i:j] for i, j in own]
            seen = Counter(words)
            kinds = Counter(1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 3 if 48 <= c <= 57 else 4 if c > 127 else 5 if c in b"!#$%&*|" else 0 for c in raw)
            shape = [sum(p == q for p, q in zip(words, words[1:], strict=False)) / len(words), (len(words) - len(seen)) / len(words), math.log1p(sum(map(len, words)) / len(words)) / 3, math.log1p(len(words)) / 5]
            x[Q.BUCKETS :] = shape + [kinds[k] / len(raw) for k in range(6)]
        out.append(x)
    return out


def plain_score(model, text):
    p = {k: v.astype(float) for k, v in model.p.items()}
    hs, es = [], []
    for x in plain_vectors(text):
        h = np.tanh(np.array([np.dot(x, p["W"][:, j]) for j in range(Q.HIDDEN)]) + p["b"])
        hs.append(h)
        es.append(sum(p["w"][j] * math.tanh(h @ p["V"][:, j]) / (1 + math.exp(-(h @ p["U"][:, j]))) for j in range(Q.HIDDEN)))
    a = [math.exp(e - max(es)) for e in es]
    z = sum(w * h for w, h in zip(a, hs, strict=True)) / sum(a)
    return 1 / (1 + math.exp(-(z @ p["c"] + p["d"][0])))


@pytest.fixture(scope="module")
def model(spark):
    return Q.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))


def test_against_plain_scorer(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for r in Q.score(docs, model).collect():
        assert abs(r.score - plain_score(model, r.text)) < 2e-5 and r.predicted == (r.score >= 0.5)
        assert r.n_passages == len(plain_vectors(r.text))


def test_held_out(spark, model):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = Q.score(docs, model).join(labels, "doc_id").where(Q.remainder(F.col("doc_id")) == 1)
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a")).first()["a"] > 0.95


def test_vectors_depend_on_their_own_bytes(monkeypatch):
    """Whatever stands beside a text, and however it is cut into pieces."""
    monkeypatch.setattr(Q, "PASSAGE", 4)
    texts = ["  a b c d e f g", None, "x", "\n\n", " é è ü one two three four five " * 9, "", "q", "\ta"]
    buf = "".join(t or "" for t in texts).encode()
    off = np.append(0, np.cumsum([len((t or "").encode()) for t in texts]))
    x, first = Q.encode(np.frombuffer(buf, np.uint8), off)
    for i, t in enumerate(texts):
        one = np.frombuffer((t or "").encode(), np.uint8)
        own, _ = Q.encode(one, np.array([0, len(one)]))
        assert np.array_equal(x[first[i] : first[i + 1]], own) and np.allclose(own, plain_vectors(t), atol=1e-5)
        for n in (1, 2, 3):
            assert np.array_equal(np.concatenate([Q.encode(p, np.array([0, len(p)]))[0] for p in Q.pieces(one, n)]), own)


def test_long_texts_in_pieces(spark, model, monkeypatch):
    """Encoded, scored and learned from in pieces, a text gives what it gives as a whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    whole, learned = Q.score(docs, model).orderBy("doc_id").collect(), Q.train(docs, labels)
    for name, value in (("SHARD_BYTES", 200), ("PIECE", 2), ("STEP", 3 * 10**6)):
        monkeypatch.setattr(Q, name, value)
    cut = Q.score(docs, model).orderBy("doc_id").collect()
    assert all(abs(a.score - b.score) <= 2e-6 and a.n_passages == b.n_passages for a, b in zip(whole, cut, strict=True))
    again = Q.train(docs, labels)
    assert all(np.allclose(learned.p[k], again.p[k], atol=1e-4) for k in again.p)


def test_training_in_parts(spark, monkeypatch):
    """Vectors that don't fit one part are read part by part, steps with many passages are cut."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(Q, "PART_BYTES", 1 << 20)
    monkeypatch.setattr(Q, "STEP", 200)
    got = Q.score(docs, Q.train(docs, labels)).join(labels, "doc_id").where(Q.remainder(F.col("doc_id")) == 1)
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a")).first()["a"] > 0.93


def test_the_sample_is_fixed(spark):
    """Rows that repeat a key, with one text or several, leave the same model however they are ordered; null keys and labels take no part."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = docs.unionByName(docs.where("doc_id < 50").withColumn("text", F.lit("another"))).unionByName(docs.limit(30)).unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels = labels.unionByName(labels.limit(3).withColumn("quality", F.lit(None).cast(labels.schema["quality"].dataType)))
    a, b = Q.train(more, labels, sample=40), Q.train(more.repartition(5).orderBy(F.desc("doc_id")), labels.orderBy(F.desc("doc_id")), sample=40)
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)


def test_odd_rows(spark, odd, model):
    made = Q.score(odd, model)
    assert made.columns == [*odd.columns, "_score", "predicted", "n_passages"]
    rows = made.collect()
    assert all(abs(r["_score"] - plain_score(model, r.text)) < 1e-4 and r.predicted == (r["_score"] >= 0.5) for r in rows if len(r.text or "") < 10**4)
    assert len({r["_score"] for r in rows if r.text == "a b c d e f g h i j k l m n"}) == 1
    none = Q.train(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert none is None and {r["_score"] for r in Q.score(odd, none).collect()} == {0.5}
    assert Q.keep_good(odd, model).columns == odd.columns
    assert Q.score(odd.limit(0), model).collect() == [] == Q.keep_good(odd.limit(0), None).collect()
    assert [len(x) for _, _, parts in Q.vectors(pa.array([None, ""], pa.string())) for x, _ in parts] == [2]


def test_attention_gradient():
    r = np.random.default_rng(0)
    m = Q.Model()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, first, y = r.standard_normal((7, Q.BUCKETS + Q.SHAPES)), np.array([0, 3, 7]), np.array([1.0, 0.0])
    loss = lambda: -np.mean(y * np.log(m.score(x, first)) + (1 - y) * np.log(1 - m.score(x, first)))
    grad = m._gradient(x, first, y)
    for k, at in (("V", (1, 2)), ("U", (3, 4)), ("w", (5,)), ("c", (6,)), ("b", (7,))):
        kept, e = m.p[k][at], 1e-5
        m.p[k][at] = kept + e
        up = loss()
        m.p[k][at] = kept - e
        down = loss()
        m.p[k][at] = kept
        assert abs((up - down) / (2 * e) - grad[k][at]) < 1e-4
