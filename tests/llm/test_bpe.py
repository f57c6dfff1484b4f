"""Encoding against the library of rank files, decoding as a round trip."""

import base64
import random
import time
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm import bpe, queries

PATHS = [public_tokenizers.path(f"{n}.tiktoken") for n in ("byte_bpe_multi_50k", "byte_bpe_50k")]


def library(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize("unit", [1 << 25, 500])
def test_ids_and_bytes(spark, odd, monkeypatch, path, unit):
    monkeypatch.setattr(bpe, "UNIT_BYTES", unit)
    monkeypatch.setattr(bpe, "PIECE_CHARS", 1 << 25 if unit > 500 else 1000)
    r = random.Random(5)
    spaces = [" \n\t 's 1١² 'llama don't   x  \r\n", "aaaaaaaaaaaaaaa" * 50, "\x1c\x85 　՘'se\U0003d000's", "".join(chr(r.choice((r.randrange(32, 127), r.randrange(160, 0xD7FF), r.randrange(0x10000, 0x110000)))) for _ in range(3000)), "<|endoftext|> x"]
    df = odd.select("doc_id", "text", F.lit(7).alias("ids")).unionByName(spark.createDataFrame([(100 + i, t, 7) for i, t in enumerate(spaces)], "doc_id long, text string, ids int"))
    got = bpe.decode(bpe.encode(df, path, public_tokenizers.PATTERN), path, "_ids")
    assert got.columns == ["doc_id", "ids", "_ids", "decoded"]
    encoding = library(path)
    want = sorted((i if i is not None else -1, encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in df.collect())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["_ids"], bytes(r["decoded"])) for r in got.collect()) == want
    assert bpe.encode(df.limit(0), path, public_tokenizers.PATTERN).collect() == []
    assert len(bpe.encode(df.select("text"), path, public_tokenizers.PATTERN).collect()) == len(want)


@pytest.mark.parametrize("frame", ["a{}b", "1{}'s", " {}9 ", "\n {}"])
def test_every_character(frame):
    """Letters, numbers and white space are the library's, whatever version of Unicode the pattern modules know."""
    words, encoding = bpe.Words(bpe.Merges(bpe.ranks(PATHS[0])), public_tokenizers.PATTERN, bpe.disputed()), library(PATHS[0])
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(frame.format(c) for c in every[i : i + 64]) for i in range(0, len(every), 64)]
    numbers = [words.numbers(t) for t in texts]
    words.settle()
    assert all(words.ids_of(n).tolist() == e for n, e in zip(numbers, encoding.encode_ordinary_batch(texts), strict=True))


def test_ids_without_tokens(spark):
    rows = [(None,), ([],), ([1, None],), ([10**7],), ([0, 1],)]
    token = {r: t for t, r in bpe.ranks(PATHS[0]).items()}
    got = bpe.decode(spark.createDataFrame(rows, "ids array<int>").coalesce(1), PATHS[0]).collect()
    assert [r["decoded"] if r["decoded"] is None else bytes(r["decoded"]) for r in got] == [None, b"", None, None, token[0] + token[1]]


def in_process(make, *columns):
    """What a task of make(df) does with its batches, called here."""
    kept, schema = [], T.StructType([T.StructField(*c) for c in columns])
    make(SimpleNamespace(columns=schema.names, schema=schema, mapInArrow=lambda run, schema: kept.append(run)))
    return kept[0]


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
@pytest.mark.parametrize("kind", [pa.int32(), pa.int64()])
def test_decoding_against_the_plain_rule(monkeypatch, tmp_path, limit, kind):
    """Ranks with gaps, nulls among rows and ids, unknown and negative ids, no ids, no rows, batches that are slices."""
    monkeypatch.setattr(bpe, "JOINED_IDS", limit, raising=False)
    r = random.Random(7)
    token = {i: bytes(r.randrange(256) for _ in range(r.randrange(1, 5))) for i in r.sample(range(400), 300)}
    token = {i: t for t, i in {t: i for i, t in token.items()}.items()}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in token.items()))
    known, other = sorted(token), [*sorted(set(range(402)) - set(token)), -1, 10**7, None]
    rows = [None if r.random() < 0.2 else [r.choice(known if r.random() < 0.95 else other) for _ in range(r.randrange(12))] for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(rows, pa.list_(kind))], names=["n", "ids"])
    run = in_process(lambda df: bpe.decode(df, str(path)), ("n", T.LongType()), ("ids", T.ArrayType(T.IntegerType())))
    got = [x for b in run(iter([batch.slice(0, 0), batch.slice(0, 90), batch.slice(90)])) for x in b.to_pylist()]
    assert got == [{"n": n, "ids": v, "decoded": None if v is None or any(i not in token for i in v) else b"".join(token[i] for i in v)} for n, v in enumerate(rows)]


def test_decoding_makes_no_object_for_an_id():
    """Decoding takes less than making the ids Python objects, which took a large part of the query."""
    lists = pa.ListArray.from_arrays(pa.array(range(0, 1_000_001, 1000), pa.int32()), pa.array([i * 7919 % 50_000 for i in range(1_000_000)], pa.int32()))
    run = in_process(lambda df: bpe.decode(df, PATHS[0]), ("ids", T.ArrayType(T.IntegerType())))
    batch = pa.RecordBatch.from_arrays([lists], names=["ids"])
    list(run(iter([batch.slice(0, 1)])))  # reads the file

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    assert min(seconds(lambda: list(run(iter([batch])))) for _ in range(3)) < min(seconds(lambda: lists.values.to_pylist()) for _ in range(3))


def test_tables_are_made_once_in_a_process(monkeypatch):
    run = in_process(lambda df: bpe.encode(df, PATHS[0], public_tokenizers.PATTERN), ("text", T.StringType()))
    batch = pa.RecordBatch.from_arrays([pa.array(["one two"])], names=["text"])
    want = [b.to_pylist() for b in run(iter([batch]))]
    monkeypatch.setattr(bpe.Merges, "__init__", None)
    monkeypatch.setattr(bpe, "_spelled_out", None)
    assert [b.to_pylist() for b in run(iter([batch]))] == want


@pytest.mark.parametrize("many", [1, 3, 10**9])
def test_merges_against_the_plain_rule(monkeypatch, many):
    """Small random rank tables, in which new pairs often have lower ranks than the merge that made them; equal letters overlap."""
    monkeypatch.setattr(bpe, "MANY", many)
    r = random.Random(11)
    for _ in range(60):
        tokens = {bytes([b]) for b in range(256)}
        extra = {bytes(r.choice(b"abc") for _ in range(r.randrange(2, 6))) for _ in range(25)}
        extra = r.sample(sorted(extra), len(extra))
        table = {t: i for i, t in enumerate([*sorted(tokens), *extra])}
        merges = bpe.Merges(table)
        words = [bytes(r.choice(b"abcd") for _ in range(r.randrange(1, 40))) for _ in range(50)]

        def plain(word):
            if word in table:
                return [table[word]]
            parts = [word[i : i + 1] for i in range(len(word))]
            while True:
                able = [(table[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in table]
                if not able:
                    return [table[p] for p in parts]
                i = min(able)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]

        ids, counts = merges.replay(words)
        at = 0
        for w, n in zip(words, counts.tolist(), strict=True):
            assert ids[at : at + n].tolist() == plain(w), w
            at += n
        assert at == len(ids)
    assert [x.tolist() for x in merges.replay([])] == [[], []]


def test_query(spark):
    import hashlib

    path, sf = PATHS[0], "/root/testdata/sf0.001"
    encoding = library(path)
    want = []
    for i, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = encoding.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, queries.op12_byte_level_bpe(spark, sf).collect())) == sorted(want)
