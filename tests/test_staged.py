"""Pages that follow one another, and JSON walks, against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tonearm.functions import nested, staged
from tonearm.operators.chains import followed


def walk(x, keys):
    out = []
    if isinstance(x, dict):
        for k, v in x.items():
            if k in keys:
                out.append((k, json.dumps(v, ensure_ascii=False)))
            out += walk(v, keys)
    elif isinstance(x, list):
        for v in x:
            out += walk(v, keys)
    return out


def some_json(r, depth):
    if depth == 0 or r.random() < 0.25:
        return r.choice([None, True, 3, -1.5, "x", 'a, "b": {c} \\ é', "", "0000000001k", [], {}])
    if r.random() < 0.5:
        return [some_json(r, depth - 1) for _ in range(r.randrange(4))]
    return {k: some_json(r, depth - 1) for k in r.sample(["k", "q", "z", 'j"k', "a b", "", "1"], r.randrange(5))}


def test_values_at_any_depth(spark):
    """Order of the document, names inside texts, white space, broken and very deep documents."""
    r = random.Random(6)
    docs = [json.dumps(some_json(r, 6), indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5) for _ in range(300)]
    docs += ['{"a":' * n + '{"k": 1}' + "}" * n for n in (200, 900)]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, doc string")
    for i, found in df.select("i", nested.find_each(F.col("doc"), "k", "q")).collect():
        assert [tuple(x) for x in found] == walk(json.loads(docs[i]), ("k", "q")), docs[i]
    odd = ['{"a":' * 5000 + "1" + "}" * 5000, "[1,", "", None, '{"k": 1', "k", '{"k": 1} tail {"k": 2}', '{"k": 1, "k": 2}', '{"k": "' + '\\"' * 30000 + '"}']
    got = [r["v"] for r in spark.createDataFrame(list(enumerate(odd)), "i int, doc string").select("i", nested.find_all(F.col("doc"), "k").alias("v")).orderBy("i").collect()]
    assert got[:-1] == [[], [], [], [], [], [], ["1"], ["1", "2"]] and got[-1] == ['"' + '\\"' * 30000 + '"']


def test_page_data(spark):
    pages = ['<script>var ytInitialData = {"a": "};</script>", "b": {"c": 1.0}};var z={"b":1};</script>', 'ytInitialData={"x":[1]}', "ytInitialData = nothing", "<p>", None, 'ytInitialData = {"x": ', 'x = {"no": 1}; ytInitialData = [{"x": 2}]']
    got = [r["v"] for r in spark.createDataFrame(list(enumerate(pages)), "i int, p string").select("i", staged.page_data(F.col("p")).alias("v")).orderBy("i").collect()]
    assert got[0] is not None and json.loads(got[0]) == {"a": "};</script>", "b": {"c": 1.0}}
    assert got[1:] == ['{"x": [1]}', None, None, None, None, '{"x": 2}']


@pytest.mark.parametrize("most", [None, 1, 5, 6, 80])
def test_chains(spark, most):
    """Long chains, cycles, shared tails, ends that aren't staged, starts without a key."""
    r = random.Random(2)
    links = [(f"a{i}", f"a{i + 1}") for i in range(100)] + [("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("s", "s"), ("x", None), ("y", "gone"), ("t1", "a40"), ("n", "x")]
    starts = [("A", "a0"), ("B", "a7"), ("C", "c1"), ("S", "s"), ("X", "x"), ("Y", "y"), ("T", "t1"), ("G", "gone"), ("N", None), ("M", "n")]
    r.shuffle(links)
    want, by = set(), dict(links)
    for name, key in starts:
        step, met = 1, set()
        while key in by and key not in met and (most is None or step <= most):
            want.add((name, step, key))
            met.add(key)
            key, step = by[key], step + 1
    got = followed(spark.createDataFrame(starts, "list string, key string"), spark.createDataFrame(links, "key string, next string"), most)
    assert {tuple(x) for x in got.select("list", "step", "key").collect()} == want and got.count() == len(want)


def test_paged_titles(spark):
    """Against the loop from page to page: shuffled responses, an empty page, one that isn't staged, a token staged twice, a cycle."""
    page = lambda titles, token: {"c": [{"lockupViewModel": {"m": {"lockupMetadataViewModel": {"title": {"content": t}}}}} for t in titles], "e": {"continuationCommand": {"token": token}} if token else {}}
    bodies = {f"l{i}": page([f"t{i}-{j}" for j in range(i % 3 + 1)], f"l{i + 1}") for i in range(1, 100)}
    bodies |= {"e1": page(["one"], "e2"), "e2": page([], "e3"), "e3": page(["never"], None), "g1": page(["g"], "gone"), "y1": page(["y1"], "y2"), "y2": page(["y2"], "y1")}
    lists = {"long": ([], "l1"), "empty": (["first"], "e1"), "gone": (["first", "second"], "g1"), "cycle": ([], "y1"), "alone": (["only"], None)}
    rows = [(k, json.dumps(v)) for k, v in bodies.items()] + [("e1", json.dumps(page(["zzz"], "e3")) + " "), (None, "{}"), ("bad", "{")]
    random.Random(1).shuffle(rows)
    html = lambda t, k: f"<html><script>var ytInitialData = {json.dumps(page(t, k))};var other = {{}};</script>"
    df = spark.createDataFrame([(k, html(*v)) for k, v in lists.items()] + [("none", "<html>")], "list string, page string")
    responses = spark.createDataFrame(rows, "token string, response string")
    for newest, most in ((0, 80), (3, 80), (0, 4)):
        want = set()
        for name, (titles, token) in lists.items():
            titles, n, met = list(titles), 0, set()
            while token in bodies and token not in met and n < most:
                met.add(token)
                new = [x["lockupViewModel"]["m"]["lockupMetadataViewModel"]["title"]["content"] for x in bodies[token]["c"]]
                titles += new
                token, n = bodies[token]["e"].get("continuationCommand", {}).get("token"), n + 1
                if not new:
                    break
            want |= {(name, i + 1, t) for i, t in enumerate(titles) if not newest or i < newest}
        got = staged.titles_of_lists(df, responses, newest=newest, most=most)
        assert {tuple(x) for x in got.collect()} == want and got.columns == ["list", "position", "title"]


def test_linked_wants(spark):
    page = lambda ids, next_: json.dumps({"wants": [{"id": i, "basic_information": {"title": f"t{i}"}} for i in ids], "pagination": {"urls": {"next": next_} if next_ else {}}})
    responses = spark.createDataFrame([("u3", page([5, 1], None)), ("u1", page([1, 2], "u2")), ("u2", page([3], "u3")), ("c1", json.dumps({"releases": [{"id": 9, "basic_information": {"title": "c"}}, {"id": 2}]}))], "url string, response string")
    pages = staged.linked_pages(spark.createDataFrame([(0, "u1"), (1, "c1"), (2, "no")], "list int, url string"), responses)
    assert {(r["id"], r["list"], r["number"], r["i"]) for r in staged.wanted_releases(pages).collect()} == {(1, 0, 1, 0), (2, 0, 1, 1), (3, 0, 2, 0), (5, 0, 3, 0), (9, 1, 1, 0)}
    assert [r["id"] for r in staged.wanted_releases(pages, newest=3).collect()] == [1, 2, 3]
