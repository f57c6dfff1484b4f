"""URL rules and the regression on character n-grams."""

import duckdb

from tonearm.llm import urls


def judged(spark, rows):
    return {r.page_id: r for r in urls.judge(spark.createDataFrame([(*r, "h") for r in rows], "page_id int, url string, host string")).collect()}


def test_rules(spark):
    rows = [(1, "http://A.Example.NET/en/x?y"), (2, "http://example.net.org/fr/"), (3, None), (4, "no scheme"), (5, "http://freepoker-slots.example.org/en/1"), (6, "http://x.example.com/de/1#z"), (7, "http://example.net?x")]
    got = judged(spark, rows)
    assert (got[1]["_host"], got[1].rule, got[1].verdict) == ("a.example.net", "example.net/en/", "allow")
    assert got[2].rule == "org/fr/" and got[3]["_host"] == got[4].path == "" and got[5].verdict == "block" and got[6].rule == "example.com/de/"
    assert got[7].rule is None and got[7].path == ""
    assert got[3].verdict == got[4].verdict == "allow"


def test_regression_on_words_not_learned():
    """The table is learned, and words that weren't learned are judged better than by chance."""
    bias, w = urls.train()
    assert all((bias + sum(w[g] for g in set(urls.grams(*urls.split_url(u)))) > 0) == bool(y) for u, y in urls.labelled())
    assert urls.held_out_accuracy() > 0.75
    assert not any(x in u for u, _ in urls.labelled() for x in ("example", "spam", "casino", "pills", "adult", "ads-", "thth"))


def test_odd_rows_by_plain_python_and_sql(spark):
    """Very long and odd urls, repeated rows and an empty table, by plain Python and by SQL."""
    rows = [(1, None), (2, ""), (3, "http://"), (4, "http://h"), (5, "x://É.Org/fr/ü?q"), (6, "http://poker.com/" + "a/b-" * 50_000), (6, "http://poker.com/" + "a/b-" * 50_000), (7, "a://b://c/d"), (8, "http://a.NET/\nnew#l"), (None, "http://net/x")]
    made = urls.judge(spark.createDataFrame([(*r, "h") for r in rows], "page_id int, url string, host string"))
    assert made.columns == ["page_id", "url", "host", "_host", "path", "rule", "score", "verdict"]
    bias, w = urls.train()
    for r in made.collect():
        host, path = urls.split_url(r.url)
        z = bias + sum(w[g] for g in set(urls.grams(host, path)))
        assert (r["_host"], r.path, r.score) == (host, path, z / urls.UNIT)
        assert r.rule is not None or r.verdict == ("block" if z > 0 else "allow")
    db = duckdb.connect()
    db.execute("create table pages (page_id int, url varchar)")
    db.executemany("insert into pages values (?, ?)", [list(r) for r in rows if r[1] is not None and len(r[1]) < 1000] + [[1, None]])
    want = sorted(db.sql(urls.sql()).fetchall(), key=repr)
    assert sorted(((r.page_id, r["_host"], r.path, r.rule, r.verdict) for r in made.collect() if len(r.url or "") < 1000), key=repr) == want
    assert urls.judge(spark.createDataFrame([], "page_id int, url string")).collect() == []
