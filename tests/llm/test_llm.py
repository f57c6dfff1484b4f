"""Operators of the llm subpackage: brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.llm import jaccard, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_links(rows):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows if (w := words(t))}
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    return {(i, j) for i in sets for j in sets if i != j and near(sets[i], sets[j])}


def test_jaccard_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    links = brute_links([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r for r in jaccard.near_duplicates(docs).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: sum(a == i for a, _ in links) for i in got}
    assert all(got[a].class_id == got[b].class_id for a, b in links)
    assert jaccard.keep_one(docs).count() == len({r.class_id for r in got.values()})


def test_jaccard_large_band_is_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BAND_BLOCK", 8)
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 6)
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(40):
        t = list(base)
        t[r.randrange(300)] = f"n{i}"
        rows.append((i, " ".join(t)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    links = brute_links(rows)
    assert {x.doc_id: x.n_links for x in got} == {i: sum(a == i for a, _ in links) for i, _ in rows}
    assert {x.class_id for x in got} == {0}


def drifting(n, size, seed):
    """Texts of which each is the one before with a word changed: a chain of links, its ends unlike."""
    r = random.Random(seed)
    t, rows = [f"w{r.randrange(10**6)}" for _ in range(size)], []
    for i in range(n):
        t[r.randrange(size)] = f"n{seed}x{i}"
        rows.append((seed * 10**6 + i, " ".join(t)))
    return rows


@pytest.mark.parametrize("tight", [jaccard.TIGHT, 2.0])
def test_jaccard_recall_in_split_bands(spark, monkeypatch, tight):
    """Bands and groups of many blocks, near copies as well as chains; with nothing TIGHT, blocks meet in pairs. All links are found."""
    monkeypatch.setattr(jaccard, "BAND_BLOCK", 16)
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 32)
    monkeypatch.setattr(jaccard, "TIGHT", tight)
    r = random.Random(11)
    base = [f"b{r.randrange(10**6)}" for _ in range(150)]
    near = []
    for i in range(200):
        t = list(base)
        for _ in range(r.randrange(4)):
            t[r.randrange(150)] = f"n{r.randrange(10**6)}"
        near.append((i, " ".join(t)))
    rows = near + drifting(120, 150, 1) + drifting(120, 90, 2)
    got = {x.doc_id: x for x in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links = brute_links(rows)
    found = {i: x.n_links for i, x in got.items()}
    assert found == {i: sum(a == i for a, _ in links) for i, _ in rows}
    assert all(got[a].class_id == got[b].class_id for a, b in links)


def test_jaccard_odd_rows(odd):
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got}
    assert by[0].n_links == by[1].n_links == by[2].n_links == 0 and by[5].class_id == 4 and by[7].class_id == 6 and by[7].n_links == 2
    assert by[None].class_id is None
    assert jaccard.near_duplicates(odd.limit(0)).collect() == []
    kept = jaccard.keep_one(odd.withColumnRenamed("score", "_own").withColumnRenamed("size", "_same"))
    assert kept.columns == [*odd.columns[:-2], "_own", "_same"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 6, 8] and kept.count() == 8
    assert jaccard.keep_one(odd.limit(0)).collect() == []


def test_jaccard_of_texts_under_one_id(spark):
    """Two unrelated texts of one doc_id, each with a near copy, and a text of a doc_id that another one keeps."""
    r = random.Random(7)
    made = [[f"w{r.randrange(10**6)}" for _ in range(200)] for _ in range(3)]
    near = lambda i: " ".join([*made[i][:-1], "other"])
    a, b, c = map(" ".join, made)
    rows = [(1, a), (1, b), (2, near(0)), (3, near(1)), (4, a), (5, b), (4, c), (6, near(2)), (7, c), (7, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.near_duplicates(docs).collect()))
    assert got == sorted([(1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 1, 2), (5, 1, 2), (4, 4, 3), (6, 4, 3), (7, 4, 3), (7, 4, 3)])
    assert sorted(map(tuple, jaccard.keep_one(docs).collect())) == sorted([(1, a), (1, b), (4, c)])


def test_warc_round_trip(spark, monkeypatch):
    """Also with archives of a few records each, so that revisits and their responses lie apart, and a very long payload."""
    long, very = "<p>é" + "x" * 200, "<b>" * 700_000
    rows = [(5, "http://a b/\n?q=1", long), (3, None, long), (9, "http://c", "short"), (10, "http://c", "short"), (7, "http://d", None), (3, "http://e", long), (-4, "dns:x", "WARC/1.1\r\n\r\n" * 20), (11, "http://v", very), (12, "http://w", very), (None, "http://n", long), (None, None, None)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, archive string").coalesce(2)
    for size in (16 << 20, 300):
        monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
        got = warc.archived(pages).collect()
        assert len(got) == len(rows)
        for r in got:
            htmls = {(h or "").encode() for i, _, h in rows if i == r.page_id}
            assert (r.payload_bytes, r.payload_digest) in {(len(h), hashlib.sha256(h).hexdigest()) for h in htmls}
        revisits = sorted((r.page_id is None, r.page_id, r.refers_to_page) for r in got if r.warc_type == "revisit")
        assert revisits == [(False, 3, 3), (False, 5, 3), (False, 12, 11), (True, None, 3)]
        assert all(r.refers_to in {x.record_id for x in got} for r in got if r.warc_type == "revisit")
    assert warc.archived(pages.limit(0)).collect() == []


def test_arc_version_2_and_broken_archives():
    body = b"HTTP/1.0 200 OK\n\nhi"
    data = warc.version_block("x", 2) + b"\n" + warc.header_line("http://a", "text/html", len(body), 2) + body + b"\n"
    (_, v, f, block), = [x for x in warc.arc_records(data) if not x[2]["url"].startswith("filedesc")]
    assert (v, f["url"], f["status"], warc.split_http(block)[1]) == (2, "http://a", "200", b"hi")
    with pytest.raises(ValueError):
        list(warc.arc_records(data[:-4]))
