"""W4 with names that are there already, and numbering in ranges, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tonearm.operators import dedup, numbering


def plain(rows, taken):
    """rows of one folder in order: (name, own name or None)."""
    there, got, out = {n.lower() for n in taken} | {o.lower() for _, o in rows if o is not None}, set(), []
    for name, own in rows:
        head, dot, tail = name.rpartition(".")
        stem, ext = (head, dot + tail) if head else (name, "")
        i, target = 0, name
        while target.lower() in got or (target.lower() in there and (own is None or target.lower() != own.lower())):
            i += 1
            target = f"{stem} ({i}){ext}"
        got.add(target.lower())
        out.append(target)
    return out


def test_free_numbers_of_one_base():
    """The stream of one base: names that are there, names that come later, own names."""
    r = random.Random(1)
    base = ("f", "b", "e")
    for _ in range(2000):
        k, there = r.randrange(8), r.sample(range(8), r.randrange(6))
        times = sorted(r.sample(range(0, 40, 2), k))
        own = [n if r.random() < 0.5 else None for n in r.sample([*there, *[None] * 8], k)]
        later = {n: r.randrange(20) * 2 + 1 for n in r.sample(range(1, 9), r.randrange(5)) if n not in own}
        rows = [(base, n, 0, -1, None, None) for n in there] + [(base, n, 0, t, None, None) for n, t in later.items()] + [(base, j, 1, t, o, j) for j, (t, o) in enumerate(zip(times, own, strict=True))]
        taken, want = set(), {}
        for j, (t, o) in enumerate(zip(times, own, strict=True)):
            n = 0
            while n in taken or (n in there and n != o) or later.get(n, 99) < t:
                n += 1
            taken.add(n)
            want[j] = n
        assert {i: n for *_, i, n in dedup._free_numbers(iter(sorted(rows, key=lambda x: x[1:3])))} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_taken_and_own_names(spark, seed):
    r = random.Random(seed)
    name = lambda: r.choice(["a", "A", "a (1)", "a (1) (1)", "a (2)", "a (01)", "b", "b (x)", ".hid", ".hid (1)", "c (10)", "e"]) + r.choice(["", ".mp3", ".MP3", ".tar.gz"])
    folders = ["d0", "d1", None]
    taken = {d: {n.lower(): n for n in (name() for _ in range(r.randrange(25)))} for d in folders}
    free = {d: list(t.values()) for d, t in taken.items()}
    for f in free.values():
        r.shuffle(f)
    rows = []
    for i in range(400):
        d = r.choice(folders)
        rows.append((d, name(), free[d].pop() if free[d] and r.random() < 0.2 else None, f"{i:05}", i))
    df = spark.createDataFrame(rows, "folder string, name string, own string, o string, extra long").repartition(5)
    there = spark.createDataFrame([(d, n) for d, t in taken.items() for n in t.values()], "folder string, name string")
    for kwargs, known in (({"taken": there, "own": "own"}, True), ({}, False)):
        found = dedup.unique_targets(df, "folder", "name", "o", **kwargs)
        got = {x["extra"]: x["target"] for x in found.collect()}
        assert found.columns == [*df.columns, "target"] and len(got) == 400
        for d in folders:
            mine = [(n, own if known else None, i) for f, n, own, _, i in rows if f == d]
            assert [got[i] for *_, i in mine] == plain([(n, own) for n, own, _ in mine], taken[d].values() if known else [])
    assert dedup.unique_targets(df.limit(0), "folder", "name", "o", there).collect() == []
    assert [x["target"] for x in dedup.unique_targets(df.where("extra = 3"), "folder", "name", "o", there.limit(0)).collect()] == [rows[3][1]]


def test_numbers(spark):
    """Nulls first, any types, empty tables; as many ranges as the rows need."""
    rows = [(None if i % 9 == 0 else i * 31 % 50, i, "x" * (i % 3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b long, c string").repartition(6)
    want = {b: n for n, (_, b) in enumerate(sorted((-1 if a is None else a, b) for a, b, _ in rows))}
    assert {r["b"]: r["number"] for r in numbering.numbered(df, ["a", "b"]).collect()} == want
    down = numbering.numbered(df, [F.desc("b")], "n")
    assert {r["b"]: r["n"] for r in down.collect()} == {i: 1999 - i for i in range(2000)} and down.columns == ["a", "b", "c", "n"]
    within = {}
    for a, b, _ in sorted(rows, key=lambda x: x[1]):
        within.setdefault(a, []).append(b)
    assert {r["b"]: r["number"] for r in numbering.numbered_within(df, ["a"], "b").collect()} == {b: n for v in within.values() for n, b in enumerate(v)}
    assert numbering.numbered(df.limit(0), ["a", "b"]).collect() == []
    assert numbering.ranges(df) == 4 and numbering.ranges(spark.range(10**12)) > 1000 and numbering.ranges(spark.range(10).crossJoin(df)) == 4
