"""Token weights and sparse document vectors in long form."""

from __future__ import annotations

import importlib
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vocabulary import exploded

#: Terms up to which a vocabulary is broadcast to the documents; beyond, the join shuffles.
BROADCAST_TERMS = 500_000


def idf(vocab: DataFrame, n_docs: int) -> DataFrame:
    return vocab.withColumn("weight", F.log2(F.lit(float(n_docs)) / F.col("df")))


def unit_weights(vocab: DataFrame, n_docs: int) -> DataFrame:
    return vocab.withColumn("weight", F.lit(1.0))


def token_counts(tokens: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(id, token, n): how often each token occurs in each document; rows that repeat an id count as one document."""
    return exploded(tokens, F.col(tokens_col), id_col).groupBy(id_col, "token").agg(F.count("*").alias("n"))


def entropy(vocab: DataFrame, counts: DataFrame, labels: DataFrame, label_col: str = "klass", id_col: str = "doc_id") -> DataFrame:
    """1 minus the normalised entropy of a token's classes, each class with 3 pseudo-counts. labels: (id, label)."""
    labels = labels.select(id_col, F.col(label_col).cast("string").alias("k"))
    classes = labels.select("k").distinct().count()
    seen = counts.select(id_col, "token").join(labels, id_col).groupBy("token", "k").agg((F.count("*") + 3).cast("double").alias("c"))
    # classes that a token lacks have 3 each, without a row for each
    lack = F.lit(classes) - F.count("*")
    s = F.sum("c") + 3.0 * lack
    cl = F.sum(F.col("c") * F.log2("c")) + lack * F.lit(3.0) * F.log2(F.lit(3.0))
    w = 1 + (cl / s - F.log2(s)) / F.lit(max(1.0, math.log2(classes)) if classes > 2 else 1.0)
    return vocab.join(seen.groupBy("token").agg(w.alias("weight")), "token")


def _known(counts: DataFrame, vocab: DataFrame, terms: int | None) -> DataFrame:
    v = vocab.select("token", "token_id", "weight")
    if terms is None:
        terms = vocab.count()
    return counts.join(F.broadcast(v) if terms <= BROADCAST_TERMS else v, "token")


def term_freq(counts: DataFrame, vocab: DataFrame, id_col: str = "doc_id", terms: int | None = None) -> DataFrame:
    """(id, token, token_id, tf): a token's share of the document's known tokens."""
    return _known(counts, vocab, terms).withColumn("tf", F.col("n") / F.sum("n").over(Window.partitionBy(id_col))).drop("n")


def tfidf(counts: DataFrame, vocab: DataFrame, unit: bool = True, id_col: str = "doc_id", terms: int | None = None) -> DataFrame:
    """(id, token, token_id, value): tf times weight, of length 1 per document if unit."""
    x = term_freq(counts, vocab, id_col, terms).withColumn("value", F.col("tf") * F.col("weight")).drop("tf", "weight")
    if not unit:
        return x
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(id_col)))
    return x.withColumn("_l", norm).withColumn("value", F.when(F.col("_l") > 0, F.col("value") / F.col("_l")).otherwise(F.lit(0.0))).drop("_l")


def tf(counts: DataFrame, vocab: DataFrame, unit: bool = True, id_col: str = "doc_id", terms: int | None = None) -> DataFrame:
    """Term frequencies alone; unit has no effect."""
    return term_freq(counts, vocab, id_col, terms).withColumnRenamed("tf", "value").drop("weight")


def entropy_rows(counts: DataFrame, vocab: DataFrame, unit: bool = True, id_col: str = "doc_id", terms: int | None = None) -> DataFrame:
    """The weight of each distinct known token, neither counted nor normalised."""
    return _known(counts, vocab, terms).select(id_col, "token", "token_id", F.col("weight").alias("value"))


#: Names of weightings: how documents become rows.
ROWS: dict[str, Callable[..., DataFrame]] = {"tfidf": tfidf, "tf": tf, "entropy": entropy_rows}


def rows_of(weighting: str) -> Callable[..., DataFrame]:
    """One of ROWS, or any function of the same arguments by its dotted path; its vocabulary has inverse document
    frequencies as weights."""
    return ROWS[weighting] if weighting in ROWS else named(weighting)


def named(path: str) -> Callable:
    """What a dotted path names."""
    module, _, name = path.rpartition(".")
    if not module:
        raise ValueError(f"neither a known name nor a dotted path: {path}")
    return getattr(importlib.import_module(module), name)


def as_vectors(long: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, vec, vecsize): pairs (token_id, value) in order of id; a document without known tokens has an empty vec."""
    # the size is counted by itself, so that who wants it alone has no vectors made
    v = long.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("token_id", "value"))).alias("vec"), F.count("*").cast("int").alias("vecsize"))
    none = F.array().cast("array<struct<token_id:int,value:double>>")
    return docs.select(id_col).join(v, id_col, "left").select(id_col, F.coalesce("vec", none).alias("vec"), F.coalesce("vecsize", F.lit(0)).alias("vecsize"))


def unknown(tokens: DataFrame, vocab: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(id, token): distinct tokens that the vocabulary lacks."""
    return exploded(tokens, F.array_distinct(tokens_col), id_col).join(vocab.select("token"), "token", "left_anti").select(id_col, "token")
