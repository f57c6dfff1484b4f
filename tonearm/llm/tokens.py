"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import fresh

#: Bytes of one encoding batch, and characters of a piece of a long text.
BATCH_BYTES, PIECE_CHARS = 1 << 18, 1 << 15


def pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """Split a long text where no token can span: before a single space between two characters that aren't white space.

    Byte-level patterns join a space only with what follows it, and no pattern joins what stands on both sides of such
    a place. A run without such a place stays whole.
    """
    out, start = [], 0
    while len(text) - start > limit:
        at = start + limit
        while 0 <= at < len(text) - 1 and not (text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()):
            at += 1
        if at >= len(text) - 1:
            break
        out.append(text[start:at])
        start = at
    out.append(text[start:])
    return out


class Counter:
    """Counts tokens as the library of the vocabulary file does, without begin, end or other added special tokens.

    ``.json``: the tokenizers library. Where the file is a plain byte-level BPE (regular split, no normaliser, merges in
    the order of ids), its merges are a rank table, which tiktoken runs about four times faster with the same counts;
    tests hold the two against each other, and pieces without a safe boundary go to tokenizers itself.
    ``.model``: sentencepiece, whole texts (it has no safe boundary of the kind above).
    """

    def __init__(self, path: str):
        self.fast = self.slow = None
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.model = None
        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._ranks(spec)

    @staticmethod
    def _ranks(spec: dict):
        """A tiktoken encoding of the same merges, or None where the file is of another kind."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or spec.get("normalizer") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            return None
        added = spec.get("added_tokens", [])
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            return None
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocab, names = model["vocab"], {t["content"] for t in added}
        last = -1
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if vocab[a + b] <= last:
                return None
            last = vocab[a + b]
        ranks = {bytes(byte[c] for c in k): v for k, v in vocab.items() if k not in names}
        import tiktoken

        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})

    def _slowly(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.slow.encode_batch(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if self.model is not None:
            return [len(x) for x in self.model.encode(texts, num_threads=1)] if texts else []
        parts = [pieces(t) if self.fast and len(t) > PIECE_CHARS else [t] for t in texts]
        flat = [p for x in parts for p in x]
        got = self._slowly(flat) if self.fast is None else [0] * len(flat)
        if self.fast is not None:
            long = [i for i, p in enumerate(flat) if len(p) > 4 * PIECE_CHARS]
            for i, n in zip(long, self._slowly([flat[i] for i in long]) if long else [], strict=True):
                got[i] = n
            usual = [i for i, p in enumerate(flat) if len(p) <= 4 * PIECE_CHARS]
            if any(s in flat[i] for s in self.special for i in usual):
                done = self.fast.encode_batch([flat[i] for i in usual], num_threads=1, allowed_special="all")
            else:
                done = self.fast.encode_ordinary_batch([flat[i] for i in usual], num_threads=1)
            for i, x in zip(usual, done, strict=True):
                got[i] = len(x)
        out, at = [], 0
        for x in parts:
            out.append(sum(got[at : at + len(x)]))
            at += len(x)
        return out


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows each keep their count; an empty table stays empty. If
    df has columns of these names already, the new ones get underscores before them. Very long texts are split where no
    token can span (.model files and texts without such a place are encoded whole). No shuffle: the scan's partitions
    are encoded in place, in batches of about BATCH_BYTES whatever the texts' lengths.
    """
    names = fresh(df, "n_bytes", "n_tokens", "over_limit")
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in zip(names, (T.LongType(), T.LongType(), T.BooleanType()), strict=True))])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(path)
        for batch in batches:
            column = batch.column(at)
            sizes = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            counts: list[int] = []
            group: list[str] = []
            held = 0
            for value, size in zip(column, sizes.to_pylist(), strict=True):
                group.append(value.as_py() or "")
                held += size
                if held >= BATCH_BYTES:
                    counts += counter.count(group)
                    group, held = [], 0
            counts += counter.count(group)
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes, n, pc.greater(n, limit)], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)
