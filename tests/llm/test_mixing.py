"""Mixing against a plain model of Pareto order sampling, and its inclusion probabilities."""

import hashlib
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tonearm.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int, size int"


def model(rows, weights=(5, 2, 1), share=1.5, most=2, seed="mix"):
    """(key, source, size, source_size, target, taken, copies) of rows (key, source, text), by sorting everything."""
    sized = [(k, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for k, s, t in rows]
    total = Counter()
    for _, s, n in sized:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = [s for s in order if s not in capped]
        level = (sum(total.values()) * share - sum(most * total[s] for s in capped)) / (sum(weight[s] for s in rest) or 1)
        more = {s for s in rest if weight[s] * level > most * total[s]}
        if not more:
            break
        capped |= more
    out = []
    for s in order:
        target = float(min(weight[s] * level, most * total[s])) if s not in capped else float(most * total[s])
        whole = int(target // total[s]) if total[s] else 0
        missing = target - whole * total[s]
        own = [(k, n) for k, t, n in sized if t == s]
        # certain documents: the largest ones, as long as their probability would reach 1
        certain, factor = set(), 0.0
        sizes = sorted((n for _, n in own if n), reverse=True)
        for size in sorted(set(sizes), reverse=True):
            factor = (missing - sum(n for n in sizes if n > size)) / float(sum(n * n for n in sizes if n <= size))
            if factor * size < 1:
                break
            certain.add(size)
        ranked = []
        for k, n in own:
            if n and missing > 0:
                draw = int(hashlib.md5(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:12], 16)
                u = (draw + 0.5) / 2.0**48
                p = n * factor
                q = 0.0 if p >= 1 else (u / (1 - u)) / (p / (1 - p))
                ranked.append((int(q / (1 + q) * 2.0**48), k is not None, k or 0, n))
        run, extra = 0, Counter()
        for q, has, k, n in sorted(ranked):
            run += n
            if (run - missing) * 2 <= n:
                extra[k if has else None, n] += 1
        for k, n in own:
            one = min(extra[k, n], 1)
            extra[k, n] -= one
            out.append((k, s, n, total[s], target, (whole + one) * n, whole + one))
    return Counter(out)


def rows_of(df):
    return [(r.doc_id, r.source, r.text) for r in df.collect()]


def sampled(df):
    return Counter(map(tuple, mixing.sample(df).collect()))


@pytest.mark.parametrize("many", [10_000, 3])
def test_against_the_model(spark, odd, monkeypatch, many):
    """Also with more sources than are broadcast."""
    monkeypatch.setattr(mixing, "MOST_SOURCES", many)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sampled(docs) == model(rows_of(docs))
    for table in (odd, odd.limit(0), odd.where("doc_id is null"), odd.where("text is null or text = ''")):
        assert sampled(table) == model(rows_of(table))


def test_near_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = mixing.sample(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.g) <= r.m / 2 for r in by)


def test_inclusion_probabilities(spark):
    """Over many seeds, documents are taken as often as their sizes say, certain ones always."""
    sizes = [1, 2, 4, 8, 16, 60] * 20
    docs = spark.createDataFrame([(i, "w " * n, "a") for i, n in enumerate(sizes)] + [(1000, "w " * 3000, "b")], "doc_id long, text string, source string").cache()
    taken, runs = Counter(), 16
    for seed in range(runs):
        for r in mixing.sample(docs.where("source = 'a'"), share=0.25, seed=str(seed)).collect():
            taken[r["size"]] += r.copies
    missing = Fraction(sum(sizes), 4)
    factor = missing / sum(n * n for n in sizes)
    for n in set(sizes):
        assert abs(taken[n] / (20 * runs) - float(factor * n)) < 0.11
    big = spark.createDataFrame([(i, "w " * (2000 if i == 3 else 10), "a") for i in range(100)], "doc_id long, text string, source string")
    assert all(r.copies == 1 for s in "abc" for r in mixing.sample(big, share=0.9, seed=s).collect() if r["size"] == 2000)


def test_mixed_documents_are_the_sample(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for table, size in ((docs, "size"), (odd, "_size"), (odd.limit(0), "_size"), (odd.where("doc_id is null"), "_size")):
        made = mixing.mixed_documents(table)
        assert made.columns == [*table.columns, size, "source_size", "target", "taken", "copies"]
        most = {}  # of the rows of a source, key and size
        for r in mixing.sample(table).collect():
            at = r.source, r.doc_id, r["size"]
            most[at] = max(most.get(at, 0), r.copies)
        rows = made.collect()
        assert len(rows) == table.count()
        assert all(r.copies == most[r.source, r.doc_id, r[size]] and r.taken == r.copies * r[size] for r in rows)
