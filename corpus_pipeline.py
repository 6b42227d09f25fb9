"""A training corpus from raw documents: language ID, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphweave.llm import langid, linededup, mixing, ngram_join, packing
from glyphweave.llm.common import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; the model is fitted on a bounded labelled sample of them."""
    return langid.keep_known(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every line only at its first place; those of which no line is left go. n_chars follows."""
    left = linededup.dedup(docs)[1].filter("lines_kept > 0 or lines_in = 0")
    cols = [F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return left.select(*cols)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the tempered target weights; none is lost."""
    return mixing.mix(docs, mixing.source_rates(docs), copy_col=None)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of documents under token, document and attention limits."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mixture),
    ("best_fit_packing", sequences),
]

#: Language ID and packing have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
