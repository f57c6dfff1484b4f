"""License scans: a trained paragraph classifier with a calibrated unknown class, confirmed by template comparison.

Paragraphs are what blank lines separate; a notice may be wrapped over lines, be a line of its own or stand inside a long
paragraph. Places to be judged are found by telling word pairs: pairs of the notices' words that aren't both common words
and don't occur in the ordinary sentences. Hits that are close together, with a few words around them, are a place; it is
cut into sentences. The n-grams (1 to 3 words) of a piece are the features of a softmax regression over license families
and "unknown".

Training, calibration and threshold use separate rows: a temperature is fitted on notices in wordings that weren't trained
on and on ordinary sentences that weren't either; the least probability that counts is the lowest at which at most
FALSE_RATE of those sentences are taken for a notice. A family is reported if it also compares with one of its templates:
at least SIMILAR of the smaller one's word pairs are shared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh
from .words import Scan, mixed, raw, shards

SIMILAR, FALSE_RATE = 0.6, 0.01
#: Words between hits of one place, and words around it.
GAP, AROUND = 6, 3
SHARD_BYTES = 1 << 20

#: The names of licenses by family, as notices have them; then sentences of their own texts.
NAMES = {
    "apache": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 license", "Apache-2.0"),
    "mit": ("the MIT License", "the MIT license", "the Expat MIT License", "the X11 MIT license"),
    "gpl": ("the GNU General Public License, version 3", "the GNU General Public License version 2 or later", "the GNU GPL version 2", "the GNU GPL v3", "GPLv3", "GPL-2.0-or-later"),
    "lgpl": ("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License version 2.1 or later", "the GNU Library General Public License, version 2", "the GNU LGPL version 2.1", "LGPLv3", "LGPL-2.1-only"),
    "agpl": ("the GNU Affero General Public License, version 3", "the GNU Affero General Public License version 3 or later", "the GNU AGPL version 3", "AGPLv3", "AGPL-3.0-only"),
    "gfdl": ("the GNU Free Documentation License, version 1.3", "the GNU Free Documentation License", "the GNU FDL version 1.2"),
    "bsd": ("the BSD 3-Clause License", "the BSD 2-Clause License", "the two clause BSD license", "the three clause BSD license", "the New BSD License", "the Simplified BSD License", "BSD-3-Clause"),
    "isc": ("the ISC License", "the ISC license", "the Internet Systems Consortium license"),
    "mpl": ("the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0", "the MPL 2.0", "MPL-2.0"),
    "epl": ("the Eclipse Public License 2.0", "the Eclipse Public License, version 1.0", "the Eclipse Public License v2.0", "EPL-2.0"),
    "cddl": ("the Common Development and Distribution License 1.0", "the Common Development and Distribution License, version 1.1", "the CDDL 1.0"),
    "cc": ("CC BY 4.0", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC BY-NC 4.0", "CC BY-ND 4.0", "CC BY-NC-SA 4.0", "a Creative Commons Attribution 4.0 International License", "a Creative Commons Attribution-ShareAlike 3.0 Unported License", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc0": ("CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication", "the Creative Commons Zero dedication"),
    "unlicense": ("the Unlicense", "the Unlicense license"),
    "zlib": ("the zlib License", "the zlib/libpng License", "the zlib license"),
    "boost": ("the Boost Software License, Version 1.0", "the Boost Software License 1.0", "the Boost Software License"),
    "artistic": ("the Artistic License 2.0", "the Perl Artistic License", "the Artistic License"),
    "ofl": ("the SIL Open Font License, Version 1.1", "the SIL Open Font License 1.1", "the Open Font License"),
    "odbl": ("the Open Database License", "the Open Data Commons Open Database License 1.0", "the ODbL 1.0"),
    "psf": ("the Python Software Foundation License Version 2", "the Python Software Foundation License", "the PSF License 2"),
}
SENTENCES = {
    "apache": ("You may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "See the License for the specific language governing permissions and limitations under the License."),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program."),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "You should have received a copy of the GNU Lesser General Public License along with this library."),
    "agpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "You should have received a copy of the GNU Affero General Public License along with this program."),
    "gfdl": ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License.",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org."),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License.",),
    "cddl": ("The contents of this file are subject to the terms of the Common Development and Distribution License.",),
    "cc": ("This work is licensed under a Creative Commons license.", "To view a copy of this license, visit creativecommons.org/licenses/by/4.0."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "zlib": ("This software is provided as-is, without any express or implied warranty; in no event will the authors be held liable for any damages arising from the use of this software.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    "boost": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.",),
    "artistic": ("You may distribute this package under the same terms as Perl itself.", "This is free software; you can redistribute it under the same terms as Perl itself."),
    "ofl": ("This Font Software is licensed under the SIL Open Font License.", "The Font Software may be modified, and redistributed under the same name only with a reserved font name."),
    "odbl": ("This database is made available under the Open Database License; any rights in individual contents are licensed under the Database Contents License.",),
    "psf": ("Copyright Python Software Foundation; the Python license applies to this module.",),
    "proprietary": ("All rights reserved.", "Copyright by the publisher. All rights reserved.", "All rights reserved by the author.", "Copyright, all rights reserved worldwide.", "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.", "Unauthorized copying of this file, via any medium, is strictly prohibited.", "This document is proprietary and confidential.", "For internal use only; do not distribute."),
}
FAMILIES = (*SENTENCES, "unknown")
#: Wordings that are trained on, and wordings that only calibrate. {}: the name.
FORMS = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This project is released under the terms of {}.", "This software is distributed under {}.", "Distributed under the terms of {}.", "{}", "License: {}")
HELD_FORMS = ("Available under {}.", "The code in this file is covered by {}.", "Use of this package is governed by {}, see LICENSE.", "Published under {}.")
HELD_SENTENCES = (("Copyright 2019 by the author, all rights reserved.", "proprietary"), ("Copying this file without the written permission of the publisher is strictly prohibited.", "proprietary"), ("Free of charge, any person obtaining a copy of this software may deal in the Software without restriction.", "mit"), ("You can redistribute it under the terms of the GNU General Public License as published by the FSF.", "gpl"), ("Use in source and binary forms, with or without modification, is permitted provided that these conditions are met.", "bsd"), ("You may use this file only in compliance with the License.", "apache"))
#: Ordinary sentences with the notices' words; {}: a thing.
ORDINARY = ("A driver needs a license to drive the {} on this road.", "She released a new version of the {} in spring.", "All of the rights of way near the {} are marked on the map.", "All rights are reserved for the owner of the {}.", "This work is under way and the {} is open to the public.", "The general public is free to use the {}.", "You may not use this {}.", "The version of the {} that he told was under discussion.", "In the source of the river the {} is cold.", "The following conditions of the {} are common.", "The terms of the agreement about the {} were published in a book.", "No part of the {} was spared.", "Permission to enter the {} is given at the gate.", "Copyright law is taught beside the {}.", "He had a copy of the document with him at the {}.", "Public transport to the {} is available free of charge.", "The {} was sold under the terms of the contract.", "The {} works under a license of the city.", "Seats in the {} are reserved for guests.", "The museum is open on all days but the {} is not.", "Any person may see the {} without restriction.", "The software of the {} was modified and distributed to the schools.")
HELD_ORDINARY = ("The fishing license for the {} costs more this year.", "The rights of the workers in the {} were not reserved to a few.", "The {} was released into the sea under the eyes of the public.", "He asked for the permission of the owner to copy the plan of the {}.", "Redistribution of land around the {} was discussed in general terms.", "It is provided that the {} stays open to any person.", "The library holds the first version of the book about the {}.", "A notice at the {} said that use of the road is free.", "The conditions in the {} were the subject of an open letter.", "The author has published a history of the {}, with a map.")
THINGS = ("garden", "harbour", "railway", "concert hall", "village", "old mill")
COMMON = frozenset("a all an and any are as at be been by can for from has have he her his if in is it its may must not of on one or other she should shall that the their there these this to under use used was were which who will with without you your".split())


def notices(forms: tuple[str, ...] = FORMS) -> list[tuple[str, str]]:
    """Every form with every name, and its family."""
    return [(f.format(name), family) for family, names in NAMES.items() for name in names for f in forms]


def ordinary(forms: tuple[str, ...] = ORDINARY) -> list[str]:
    return [f.format(t) for f in forms for t in THINGS]


def parts(words: list[str], size: int = 12) -> list[list[str]]:
    """A sentence, and if it is long its runs of `size` words, each beginning in the middle of the one before."""
    return [words, *(words[i : i + size] for i in range(0, len(words) - size // 2, size // 2) if len(words) > size)]


def table() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Rows to train on and rows to calibrate with: notices, notices with words of running text around them, ordinary sentences."""

    def rows(own: list[tuple[str, str]], plain: list[str]) -> list[tuple[str, str]]:
        out = list(own)
        for i, (t, k) in enumerate(own):
            before, after = plain[(7 * i) % len(plain)].split(), plain[(11 * i + 3) % len(plain)].split()
            out.append((" ".join([*before[-(i % (AROUND + 1)) or len(before) :], t, *after[: (i + 2) % (AROUND + 1)]]), k))
        return out + [(t, "unknown") for t in plain]

    whole = [(" ".join(part), k) for k, ts in SENTENCES.items() for t in ts for part in parts(t.split())]
    return rows(notices() + whole, ordinary()), rows(notices(HELD_FORMS) + list(HELD_SENTENCES), ordinary(HELD_ORDINARY))


def grams(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of one to three words."""
    out = [h]
    for n in (2, 3):
        if len(h) >= n:
            x = np.zeros(len(h) - n + 1, np.uint64)
            for k in range(n):
                x = mixed(x + h[k : len(h) - n + 1 + k] * np.uint64(2 * k + 3))
            out.append(x + np.uint64(n))
    return np.concatenate(out)


def pairs(h: np.ndarray) -> np.ndarray:
    x = mixed(mixed(h[:-1] * np.uint64(3)) + h[1:] * np.uint64(5))
    return x + np.uint64(2)


def hashes(text: str) -> np.ndarray:
    return Scan(*raw(pa.array([text], pa.large_string()))).hash


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Classifier:
    """heat: the temperature; least: the probability that counts; accuracy, false_rate: of the calibration rows."""

    def __init__(self, epochs: int = 500, rate: float = 0.5, decay: float = 1e-4):
        rows, held = table()
        own = [hashes(t) for t, _ in rows]
        self.vocab = np.unique(np.concatenate([grams(h) for h in own]))
        plain = np.concatenate([pairs(hashes(t)) for t in ordinary()])
        common = np.concatenate([hashes(w) for w in sorted(COMMON)])
        said = [(hashes(t), k) for t, k in notices() + [(t, k) for k, ts in SENTENCES.items() for t in ts]]
        telling = [pairs(h)[~(np.isin(h[:-1], common) & np.isin(h[1:], common))] for h, _ in said if len(h) > 1]
        self.telling = np.setdiff1d(np.concatenate(telling), plain)
        self.templates = {f: list({np.unique(pairs(h)).tobytes(): np.unique(pairs(h)) for h, k in said if k == f and len(h) > 1}.values()) for f in SENTENCES}
        x, y = np.stack([self.features(h) for h in own]), np.array([FAMILIES.index(k) for _, k in rows])
        # from zero, the weights stay sums of rows: what is fitted is each row's share
        kernel, target = x @ x.T, np.eye(len(FAMILIES))[y]
        share = np.zeros_like(target)
        # every family has the same weight, the ordinary sentences that of all families together
        heavy = 1 / np.bincount(y)[y]
        heavy = (heavy / np.where(y == len(FAMILIES) - 1, 2, 2 * len(SENTENCES)))[:, None]
        step = np.zeros_like(share)
        for _ in range(epochs):
            step = 0.9 * step + rate * (heavy * (target - softmax(kernel @ share)) - decay * share)
            share += step
        self.w, self.heat = x.T @ share, 1.0
        hx, hy = np.stack([self.features(hashes(t)) for t, _ in held]), np.array([FAMILIES.index(k) for _, k in held])
        heats = np.exp(np.linspace(-3, 3, 61))
        loss = [-np.log(softmax(hx @ self.w / t)[np.arange(len(hy)), hy] + 1e-12).mean() for t in heats]
        self.heat = float(heats[int(np.argmin(loss))])
        p = softmax(hx @ self.w / self.heat)
        best, known = p.argmax(1), p[:, :-1].max(1)
        none = hy == len(FAMILIES) - 1
        taken = lambda least: float(((best != len(FAMILIES) - 1) & (known >= least))[none].mean())
        self.least = next(t for t in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0) if taken(t) <= FALSE_RATE)
        self.false_rate = taken(self.least)
        self.accuracy = float(((best == hy) & (known >= self.least))[~none].mean())

    def features(self, h: np.ndarray) -> np.ndarray:
        """The vocabulary's n-grams that the words have, scaled to length 3, and a constant."""
        g = np.unique(grams(h))
        at = np.minimum(np.searchsorted(self.vocab, g), len(self.vocab) - 1)
        x = np.zeros(len(self.vocab) + 1)
        x[at[self.vocab[at] == g]] = 1
        x /= max(1.0, np.sqrt(x.sum())) / 3
        x[-1] = 1
        return x

    def judge(self, h: np.ndarray) -> tuple[str, float, float] | None:
        """Family, calibrated probability and template similarity; None: unknown."""
        p = softmax(self.features(h) @ self.w / self.heat)
        k = int(np.argmax(p))
        if FAMILIES[k] == "unknown" or p[k] < self.least or len(h) < 2:
            return None
        mine = np.unique(pairs(h))
        near = max(len(np.intersect1d(mine, t, assume_unique=True)) / min(len(mine), len(t)) for t in self.templates[FAMILIES[k]])
        return (FAMILIES[k], float(p[k]), float(near)) if near >= SIMILAR else None


@lru_cache
def classifier() -> Classifier:
    return Classifier()


def paragraphs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where lines begin, the number (from 0, over all texts) of each line's paragraph, and how many paragraphs each text has."""
    breaks = np.flatnonzero(buf == 10) + 1
    starts = np.unique(np.concatenate([off[:-1], breaks[breaks < len(buf)]]))
    starts = starts[starts < len(buf)]
    if not len(starts):
        return starts, starts, np.zeros(len(off) - 1, np.int64)
    solid = np.add.reduceat(((buf > 32) | ((buf < 9) | (buf > 13)) & (buf < 32)).astype(np.int64), starts) > 0
    doc = np.searchsorted(off, starts, "right") - 1
    before = np.append(False, solid[:-1] & (doc[1:] == doc[:-1]))
    new = solid & ~before
    return starts, np.cumsum(new) - 1, np.bincount(doc[new], minlength=len(off) - 1)


def places(c: Classifier, s: Scan, buf: np.ndarray, paragraph: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
    """First and end word of each place, and the words in it with which sentences begin."""
    if len(s.hash) < 2:
        return
    p = pairs(s.hash)
    spot = np.minimum(np.searchsorted(c.telling, p), len(c.telling) - 1)
    hit = np.flatnonzero((c.telling[spot] == p) & (paragraph[1:] == paragraph[:-1]))
    if not len(hit):
        return
    new = np.append(True, (hit[1:] - hit[:-1] > GAP) | (paragraph[hit][1:] != paragraph[hit][:-1]))
    heads = np.flatnonzero(new)
    low = np.maximum(hit[heads] - AROUND, np.searchsorted(paragraph, paragraph[hit[heads]], "left"))
    high = np.minimum(hit[np.append(heads[1:], len(hit)) - 1] + 2 + AROUND, np.searchsorted(paragraph, paragraph[hit[heads]], "right"))
    stops = np.isin(buf, (46, 59))
    stops[:-1] &= (buf[1:] == 32) | ((buf[1:] > 8) & (buf[1:] < 14))
    count = np.append(0, np.cumsum(stops))
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        cut = count[s.start[a + 1 : b]] > count[s.end[a : b - 1]]
        yield a, b, (np.flatnonzero(cut) + a + 1).tolist()


HIT = T.StructType([T.StructField("family", T.StringType()), T.StructField("paragraph", T.IntegerType()), T.StructField("probability", T.DoubleType()), T.StructField("similarity", T.DoubleType())])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_paragraphs and licenses (family, paragraph from 0, probability, similarity; by paragraph and family).

    Of a family that a paragraph holds several times, the most probable place is given (of equal ones the first). A
    null, empty or blank text has no paragraphs. Very long texts are looked at to their end; only places with telling
    words are judged. Repeated rows are judged alike; an empty table gives an empty result. If names clash, the new
    columns get underscores before them. Nothing is shuffled.
    """
    names = fresh(docs, "n_paragraphs", "licenses")
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.IntegerType()), T.StructField(names[1], T.ArrayType(HIT))])
    at = docs.columns.index(text)
    kind = pa.struct([("family", pa.string()), ("paragraph", pa.int32()), ("probability", pa.float64()), ("similarity", pa.float64())])
    c = classifier()  # trained once, here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [], [np.zeros(0, np.int64)]
            for begin, end, buf, off in shards(batch.column(at), SHARD_BYTES):
                s = Scan(buf, off)
                lines, number, n = paragraphs(buf, off)
                first = np.append(0, np.cumsum(n))
                own: list[dict] = [{} for _ in range(end - begin)]
                paragraph = number[np.searchsorted(lines, s.start, "right") - 1] if len(s.start) else np.zeros(0, np.int64)
                for a, b, cuts in places(c, s, buf, paragraph):
                    parts = [c.judge(s.hash[x:y]) for x, y in zip([a, *cuts], [*cuts, b], strict=True)]
                    if not any(parts) and cuts:
                        parts = [c.judge(s.hash[a:b])]
                    d = int(np.searchsorted(first, paragraph[a], "right")) - 1
                    for said in filter(None, parts):
                        spot = (int(paragraph[a] - first[d]), said[0])
                        if spot not in own[d] or own[d][spot][0] < said[1]:
                            own[d][spot] = said[1:]
                found += [[{"family": k[1], "paragraph": k[0], "probability": v[0], "similarity": v[1]} for k, v in sorted(x.items())] for x in own]
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(counts).astype(np.int32)), pa.array(found, pa.list_(kind))], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)
