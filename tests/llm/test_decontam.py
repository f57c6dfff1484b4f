"""Decontamination against brute force, with benchmarks of one block and of many."""

import random
import re

import pytest

from tonearm.llm import decontam

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = [("1", "a b c d e f g h i j k l m n o"), ("10", "one TWO"), ("2", "k l m"), ("3", None), ("4", "..."), ("5", "zz zz"), ("2", "k l m"), ("2", "a b"), (None, "a b c"), ("6", "a b c d e f g h i j k l m n o")]


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items):
    """Word count, hit words and for each item id the longest match (item_start, doc_start, n_words)."""
    w, hit, best = words(text), set(), {}
    at = {}
    for p, x in enumerate(w):
        at.setdefault(x, []).append(p)
    for i, t in items:
        v = words(t)
        n = min(13, len(v))
        if i is None or not n:
            continue
        for k in range(len(v) - n + 1):
            for p in at.get(v[k], ()):
                if w[p : p + n] == v[k : k + n]:
                    hit |= set(range(p, p + n))
                    size = n
                    while k + size < len(v) and p + size < len(w) and v[k + size] == w[p + size]:
                        size += 1
                    # short items are one window: matches aren't longer than it
                    best[i] = min(best.get(i, (0, 0, 0)), (-size, p, k))
    return len(w), len(hit), {i: (k, p, -s) for i, (s, p, k) in best.items()}


def check(rows, items):
    for r in rows:
        n, hit, best = brute(r.text, items)
        got = {m.item_id: (m.item_start, m.doc_start, m.n_words) for m in r.matches}
        assert (r.n_words, r.n_hit, got) == (n, hit, best) and len(r.matches) == len(got)
        assert r.contaminated == (bool(hit) and 20 * hit >= n)


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 30])
def test_odd_rows_against_brute_force(spark, odd, block_bytes):
    """Null, empty and very long texts, repeated rows, repeated and odd items, clashing names."""
    df = odd.withColumnRenamed("score", "matches").withColumnRenamed("size", "_row")
    made = decontam.annotate(df, spark.createDataFrame(ITEMS, "item_id string, text string"), block_bytes=block_bytes)
    assert made.columns == [*df.columns, "n_words", "n_hit", "_matches", "contaminated"]
    made = made.drop("matches").withColumnRenamed("_matches", "matches")
    rows = made.collect()
    assert len(rows) == 11
    check(rows, ITEMS)
    assert sorted(map(repr, rows)) == sorted(map(repr, made.collect()))


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 20_000])
def test_driver_tables_against_brute_force(spark, block_bytes):
    docs, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(str(r.item_id), r.text) for r in benchmark.collect()]
    # and documents that hold passages of several items
    r = random.Random(4)
    more = [" ".join(" ".join(words(t)[5:40]) for _, t in r.sample(items, 3) if t) + " end " * r.randrange(9) for _ in range(20)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    rows = decontam.annotate(docs, benchmark, block_bytes=block_bytes).collect()
    check(rows, items)
    assert sum(r.contaminated for r in rows) >= 20


def test_empty_tables(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    for block_bytes in (decontam.BLOCK_BYTES, 30):
        assert decontam.annotate(odd.limit(0), items, block_bytes=block_bytes).collect() == []
        assert {r.contaminated for r in decontam.annotate(odd, items.limit(0), block_bytes=block_bytes).collect()} == {False}
    kept = decontam.decontaminate(odd, items)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 4, 5, 8}
