"""A training corpus from the documents table: good, single, clean of benchmarks and personal data, mixed to weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as Parquet into the shared
folder and reads them again as the next one's docs. All stages but the last return the columns of documents.

Odd rows are defined by the operators and hold in every stage: null and empty texts are rows like others (the classifier
judges them, they are copies of nothing, hold no benchmark words and no entities, and are taken as often as their source
is for certain); very long texts are worked on whole; rows that repeat a key are decided alike, and of those that repeat
its text too one stays; a null source is a source; empty tables stay empty; further columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm import decontam, jaccard, mixing, pii, quality
from tonearm.llm.common import drop_saved, fresh, mark, release, saved, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the rows that its contract allows; without any, all stay (0.5)."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the smallest doc_id. Rows without a doc_id stay."""
    return jaccard.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; an empty benchmark leaves all."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates; n_chars follows the text."""
    (count,) = fresh(docs, "n_entities")
    out = pii.pseudonymise(docs, pii.session_key(spark)).drop(count)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each with its number of copies."""
    copies = fresh(docs, "size", "source_size", "target", "taken", "copies")[4]
    return mixing.mixed_documents(docs).where(F.col(copies) > 0)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", pii_surrogates),
    ("mixing sources to target weights", mixing_to_weights),
]

#: A trained model, MinHash groups and keyed surrogates can't be written in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage has written on its way goes with it, its input when its rows are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        since = mark()
        docs = saved(stage(spark, docs, sf_dir), "stage-" + "".join(c if c.isalnum() else "-" for c in name))
        release(spark, since, keep=docs)
        if before is not None:
            drop_saved(before)
        before = docs
    return docs
