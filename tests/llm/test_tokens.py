"""Token counts against the libraries of the vocabulary files."""

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tonearm.llm import queries, tokens

SPECIAL = "a<|endoftext|> b's  c\n\n d 12 é <|endoftext|>"
LONG = ["x" * 150_000, "word " * 30_000, "日本語" * 40_000, "  two  spaces  " * 8_000, "a\n" * 60_000, "1234 " * 20_000 + "é" * 70_000, " " * 100_000, SPECIAL * 2_000]


def library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return path, lambda t: len(model.encode(t))
    model = Tokenizer.from_file(path)
    return path, lambda t: len(model.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, odd, name):
    """Odd rows, special strings, and long texts with safe boundaries and without any."""
    path, count = library(name)
    got = tokens.token_counts(odd, path)
    assert got.columns == [*odd.columns, "n_bytes", "n_tokens", "over_limit"]
    for r in got.collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), count(r.text or ""), count(r.text or "") > 1024)
    some = [SPECIAL, "", *(LONG if name != "piece_bpe_32k.model" else [t[:20_000] for t in LONG])]
    assert tokens.Counter(path).count(some) == [count(t) for t in some]
    assert tokens.token_counts(odd.limit(0), path).collect() == []


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", 5)], "N_Tokens long, text string, over_limit int")
    made = tokens.token_counts(df, queries.vocabulary(), limit=2)
    assert made.columns == ["N_Tokens", "text", "over_limit", "n_bytes", "_n_tokens", "_over_limit"] and made.first()["_over_limit"]


def test_pieces_are_the_text():
    for t in LONG:
        made = tokens.pieces(t, 100)
        assert "".join(made) == t
        assert all(a[-1] != " " and b[0] == " " and b[1] != " " for a, b in zip(made, made[1:], strict=False))
