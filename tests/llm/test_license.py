"""License scans against a plain scorer of one text, and notices in all kinds of places."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.llm import license as L

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return [m[0] for m in WORD.finditer((t or "").translate({c: c + 32 for c in range(65, 91)}))]


def pairs(w):
    return set(zip(w, w[1:], strict=False))


def ngrams(w):
    return {tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


class Plain:
    """The same classifier, with words instead of hashes and loops instead of arrays."""

    def __init__(self):
        c = L.classifier()
        place = {int(h): i for i, h in enumerate(c.vocab)}
        self.heat, self.least, self.bias = c.heat, c.least, c.w[-1]
        self.weight = {}
        for t, _ in L.table()[0]:
            w = words(t)
            for g in ngrams(w):
                self.weight.setdefault(g, c.w[place[int(L.grams(L.hashes(" ".join(g)))[-1])]])
        said = L.notices() + [(t, k) for k, ts in L.SENTENCES.items() for t in ts]
        plain = {p for t in L.ordinary() for p in pairs(words(t))}
        self.telling = {p for t, _ in said for p in pairs(words(t)) if not (p[0] in L.COMMON and p[1] in L.COMMON)} - plain
        self.templates = [(k, pairs(words(t))) for t, k in said if len(words(t)) > 1]

    def judge(self, w):
        have = [self.weight[g] for g in ngrams(w) if g in self.weight]
        scale = max(1.0, math.sqrt(len(have))) / 3
        z = [(sum(x[k] for x in have) / scale + self.bias[k]) / self.heat for k in range(len(L.FAMILIES))]
        e = [math.exp(x - max(z)) for x in z]
        p = [x / sum(e) for x in e]
        k = p.index(max(p))
        if L.FAMILIES[k] == "unknown" or p[k] < self.least or len(w) < 2:
            return None
        near = max(len(pairs(w) & t) / min(len(pairs(w)), len(t)) for f, t in self.templates if f == L.FAMILIES[k])
        return (L.FAMILIES[k], p[k], near) if near >= L.SIMILAR else None

    def scan(self, text):
        blocks, last = [], True
        for line in (text or "").split("\n"):
            blank = not line.strip(" \t\r\v\f")
            if not blank and last:
                blocks.append([])
            if not blank:
                blocks[-1].append(line)
            last = blank
        out = []
        for number, block in enumerate(blocks):
            own = ("\n".join(block) + "\n").translate({c: c + 32 for c in range(65, 91)})
            found = [(m.start(), m.end()) for m in WORD.finditer(own)]
            w = words(own)
            hits = [i for i in range(len(w) - 1) if (w[i], w[i + 1]) in self.telling]
            groups = []
            for i in hits:
                if groups and i - groups[-1][1] <= L.GAP:
                    groups[-1][1] = i
                else:
                    groups.append([i, i])
            best = {}
            for x, y in groups:
                a, b = max(0, x - L.AROUND), min(len(w), y + 2 + L.AROUND)
                cuts = [a, *(i for i in range(a + 1, b) if re.search(r"[.;][ \t-\r]", own[found[i - 1][1] : found[i][0]])), b]
                said = [self.judge(w[p:q]) for p, q in zip(cuts, cuts[1:], strict=False)]
                if not any(said) and len(cuts) > 2:
                    said = [self.judge(w[a:b])]
                for s in said:
                    if s and (s[0] not in best or best[s[0]][0] < s[1] - 1e-12):
                        best[s[0]] = s[1:]
            out += [(f, number, *best[f]) for f in sorted(best)]
        return len(blocks), out


def found(df):
    return {r.doc_id: (r.n_paragraphs, [(x.family, x.paragraph, pytest.approx(x.probability), pytest.approx(x.similarity)) for x in r.licenses]) for r in L.scan(df).collect()}


def test_against_plain_scorer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got, plain = found(docs), Plain()
    want = {r.doc_id: plain.scan(r.text) for r in docs.collect()}
    assert {k: (v[0], v[1]) for k, v in want.items()} == got
    assert sum(bool(v[1]) for v in want.values()) > 3


MIT = "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the Software),\nto deal in the Software without restriction."


def test_notices_in_all_places(spark):
    filler = "the people of the village walked along the river to the market and talked about the weather of the last days "
    texts = [
        "Nothing here.\nReleased under the MIT License.\nThe end.",
        "LICENSED!! UNDER!! CC!! BY-NC!! 4.0.!!",
        "The license to drive a car",
        None,
        "",
        MIT,
        f"Intro.\n \n{MIT}\n\n\nAll rights reserved.",
        filler * 300 + "Released under the BSD 3-Clause License. " + filler * 300,
        "This library is covered by the GNU Lesser General Public License, version 3.",
        "All rights are reserved for the owner of the building",
        "Released under the MIT License. Licensed under CC BY 4.0. All rights reserved.",
        "This is published under the ISC License, the rest under the GNU Affero General Public License.",
        "This is free and unencumbered software released into the public domain.",
        "...",
        "MIT",
        " \n\t\n ",
    ]
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    families = {k: [(f, p) for f, p, _, _ in v[1]] for k, v in got.items()}
    assert [families[i] for i in range(11)] == [[("mit", 0)], [("cc", 0)], [], [], [], [("mit", 0)], [("mit", 1), ("proprietary", 2)], [("bsd", 0)], [("lgpl", 0)], [], [("cc", 0), ("mit", 0), ("proprietary", 0)]]
    assert families[12] == [("unlicense", 0)] and families[13] == families[14] == families[15] == []
    assert [got[i][0] for i in (0, 3, 4, 6, 13, 15)] == [1, 0, 0, 3, 1, 0]
    plain = Plain()
    assert {i: plain.scan(t) for i, t in enumerate(texts)} == got


def test_calibration():
    """Wordings and sentences that weren't trained on."""
    c = L.classifier()
    assert c.accuracy > 0.95 and c.false_rate <= L.FALSE_RATE and len(L.FAMILIES) > 20
    assert not {t for t, _ in L.table()[0]} & {t for t, _ in L.table()[1]}


def test_odd_rows(spark, odd):
    """Nulls, very long texts, ties, repeated rows, clashing names, an empty table: what is found is kept, and looked at."""
    df = odd.withColumns({"licenses": F.lit("x"), "text": F.concat("text", F.lit(" Licensed under the zlib License."))})
    made = L.scan(df)
    assert made.columns == [*odd.columns, "licenses", "n_paragraphs", "_licenses"]
    for r in made.collect():
        assert [x.family for x in r["_licenses"]] == ([] if r.text is None else ["zlib"])
    assert L.scan(odd.limit(0)).collect() == []
    assert np.isclose(L.softmax(np.zeros((2, 4))).sum(), 2)
