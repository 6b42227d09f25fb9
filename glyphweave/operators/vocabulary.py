"""Vocabularies: document frequencies, filters, ids, and counters with their algebra."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TextConfig
from ..sources.tables import stored
from .ranking import numbered, value_bucket


def exploded(tokens: DataFrame, array: Column, *keep: str) -> DataFrame:
    """A row for each token. Outer, as that keeps Catalyst from inferring a filter that computes the array again."""
    return tokens.select(*keep, F.explode_outer(array).alias("token")).filter("token is not null")


def doc_freq(tokens: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(token, df): in how many documents a token occurs; partial counts before the shuffle."""
    return exploded(tokens, F.array_distinct(tokens_col)).groupBy("token").agg(F.count("*").alias("df"))


def drop_constant(df: DataFrame, n_docs: int) -> DataFrame:
    """Without tokens that every document has."""
    return df.filter(F.col("df") < n_docs)


def bounds(n_docs: int, low: float, high: float) -> tuple[int | None, float | None]:
    """Counts at or beyond which a token goes; shares of the documents become counts. None: no bound."""
    if low <= 0 and high == 1:
        return None, None
    least = max(1, int(n_docs * low)) if low < 1 else int(low) if low == int(low) else low
    most = None if high == 1 else int(n_docs * high) if high < 1 else high
    return least, most


def filter_counts(df: DataFrame, n_docs: int, low: float = 0, high: float = 1) -> DataFrame:
    least, most = bounds(n_docs, low, high)
    if least is not None:
        df = df.filter(F.col("df") > least)
    return df if most is None else df.filter(F.col("df") < most)


def most_frequent(df: DataFrame, k: int) -> DataFrame:
    """The k tokens in most documents, ties in order of token."""
    return df.orderBy(F.desc("df"), "token").limit(k)


def with_ids(df: DataFrame, bucket_rows: int | None = None) -> DataFrame:
    """token_id 0, 1, ... in order of token, from ranges of tokens. df is read several times."""
    ids = numbered(df, value_bucket(df, "token", df.count(), bucket_rows), [F.col("token")], "token_id")
    return ids.withColumn("token_id", F.col("token_id").cast("int"))


def vocabulary(tokens: DataFrame, cfg: TextConfig, n_docs: int, tokens_col: str = "tokens") -> DataFrame:
    """(token, df, token_id) after all filters of the configuration."""
    return vocabulary_of(doc_freq(tokens, tokens_col), cfg, n_docs)


def vocabulary_of(df: DataFrame, cfg: TextConfig, n_docs: int) -> DataFrame:
    """The same from document frequencies."""
    df = drop_constant(df, n_docs)
    if cfg.max_dimension:
        k = cfg.token_max_filter
        if k != int(k) or k <= 1:
            raise ValueError("max_dimension needs an integer token_max_filter above 1")
        df = most_frequent(df, int(k))
    else:
        df = filter_counts(df, n_docs, cfg.token_min_filter, cfg.token_max_filter)
    return with_ids(stored(df, "terms"))


@dataclass
class Counter:
    """Counts of tokens, and of how many documents they were taken from."""

    counts: DataFrame  # token, n
    update_calls: int

    @classmethod
    def of(cls, tokens: DataFrame, tokens_col: str = "tokens") -> Counter:
        return cls(doc_freq(tokens, tokens_col).withColumnRenamed("df", "n"), tokens.count())

    def _with(self, other: Counter, sign: int) -> Counter:
        a, b = self.counts.withColumnRenamed("n", "a"), other.counts.withColumnRenamed("n", "b")
        n = F.coalesce("a", F.lit(0)) + sign * F.coalesce("b", F.lit(0))
        both = a.join(b, "token", "full_outer").select("token", n.alias("n")).filter("n > 0")
        return Counter(both, self.update_calls + sign * other.update_calls)

    def __add__(self, other: Counter) -> Counter:
        return self._with(other, 1)

    def __sub__(self, other: Counter) -> Counter:
        return self._with(other, -1)

    def to_json(self) -> str:
        return json.dumps({"dict": {r.token: r.n for r in self.counts.orderBy("token").collect()}, "update_calls": self.update_calls})

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> Counter:
        d = json.loads(text)
        return cls(spark.createDataFrame(sorted(d["dict"].items()), "token string, n long"), d["update_calls"])

    def weights(self) -> DataFrame:
        """(token, df, token_id, weight): a vocabulary of all tokens, constant ones with weight 0 included."""
        v = with_ids(stored(self.counts.withColumnRenamed("n", "df"), "terms"))
        return v.withColumn("weight", F.log2(F.lit(float(self.update_calls))) - F.log2("df"))
