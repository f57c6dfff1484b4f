"""The pipeline's stages, each on what the one before has left, against brute force."""

import random
from collections import Counter

import pytest
from test_decontam import brute as brute_benchmark
from test_llm import brute_links
from test_mixing import model as brute_mix
from test_pii import KEY
from test_pii import model as brute_pii
from test_quality import plain_score

import corpus_pipeline as P
from tonearm.llm import common, pii, quality

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, tmp_path):
    """The driver's smallest tables, with odd rows among the documents."""
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    r = random.Random(5)
    long = " ".join(r.choice(["river", "market", "garden", "people", "weather", "mountain"]) + r.choice(["", "s"]) for _ in range(20_000))
    first = docs.orderBy("doc_id").limit(3).collect()
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, long, "en", None, len(long)), (10**6 + 3, long + " end", "en", "s", 1), (None, first[0].text, "en", "s", 5), (None, None, None, None, None)]
    odd += [tuple(first[1]), (first[2].doc_id, first[2].text + " Mr Smith, 8.8.8.8", "en", "s", 1)]
    docs = docs.select(*COLUMNS).unionByName(spark.createDataFrame(odd, docs.select(*COLUMNS).schema))
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def test_every_stage_against_brute_force(spark, folder):
    spark.conf.set(pii.KEY, KEY)
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    docs, made = read("documents"), {}
    for name, stage in P.STAGES:
        made[name] = (docs, common.saved(stage(spark, docs, folder), "test"))
        docs = made[name][1]
    names = [n for n, _ in P.STAGES]
    assert all(made[n][1].columns == COLUMNS for n in names[:-1])

    before, after = made[names[0]]
    model = quality.train(before, read("labels"))
    scores = {r.text: plain_score(model, r.text) for r in before.collect()}
    assert all(abs(s - 0.5) > 1e-4 for s in scores.values())
    assert rows(after) == [r for r in rows(before) if scores[r[1]] >= 0.5]

    before, after = made[names[1]]
    texts = sorted({(r.doc_id, r.text) for r in before.collect() if r.doc_id is not None}, key=repr)
    group = list(range(len(texts)))
    for a, b in sorted(brute_links([(i, t) for i, (_, t) in enumerate(texts)])):
        x, y = group[a], group[b]
        group = [min(x, y) if g in (x, y) else g for g in group]
    one = {}
    for i, g in enumerate(group):
        one[g] = min(one.get(g, (float("inf"), "")), (texts[i][0], i))
    left = Counter((r.doc_id, r.text) for r in after.collect())
    ids = Counter(i for i, _ in left if i is not None)
    assert all(n == 1 for (i, _), n in left.items() if i is not None)
    assert ids == Counter(i for i, _ in one.values())
    assert Counter(r.text for r in after.collect() if r.doc_id is None) == Counter(r.text for r in before.collect() if r.doc_id is None)

    before, after = made[names[2]]
    items = [(str(r.item_id), r.text) for r in read("benchmark").collect()]
    judged = {r.text: brute_benchmark(r.text, items) for r in before.collect()}
    assert rows(after) == [r for r in rows(before) if not (judged[r[1]][1] and 20 * judged[r[1]][1] >= judged[r[1]][0])]

    before, after = made[names[3]]
    old = before.collect()
    new = [t for t, _ in brute_pii([r.text for r in old])]
    assert rows(after) == sorted(((r.doc_id, t, r.lang, r.source, None if t is None else len(t)) for r, t in zip(old, new, strict=True)), key=repr)

    before, after = made[names[4]]
    want = brute_mix([(r.doc_id, r.source, r.text) for r in before.collect()])
    assert Counter((r.doc_id, r.source, r["size"], r.source_size, r.target, r.taken, r.copies) for r in after.collect()) == Counter({k: n for k, n in want.items() if k[-1]})


def test_run(spark, folder):
    """The whole, and that what it writes on its way goes: of all new tables only the result's is left."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{common.shared_dir(spark)}/tonearm")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    tables = lambda: {f.getPath().getName() for f in fs.listStatus(path)} if fs.exists(path) else set()
    before = tables()
    one = P.run(spark, folder)
    assert one.count() > 0 and "copies" in one.columns
    assert tables() - before == {f.rsplit("/", 2)[1] for f in one.inputFiles()} and len(tables() - before) == 1
    again = P.run(spark, folder)
    assert sorted(map(repr, one.drop("text").collect())) == sorted(map(repr, again.drop("text").collect()))


def test_empty_tables(spark, folder, tmp_path_factory):
    empty = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert P.run(spark, empty).collect() == []
