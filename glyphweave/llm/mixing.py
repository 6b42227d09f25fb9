"""Mixing sources to target weights.

Tokens are summed for each source over the whole table; a source's repetition rate follows from its target weight; each
document is emitted floor(rate) times, plus once more if its hash-seeded uniform number is below the fraction. The table
is read twice, once for the sums and once for the copies: the rates, a row for each source, are written between.

Defined results: a null source is a source of its own; a null or empty text has 0 tokens; a source without tokens
has rate 1, unless a weight was named for it that isn't positive (rate 0). Rows that repeat a doc_id share its draw, a null id draws as an id of its own.
An empty table gives an empty table. Other columns pass through; a clash with the added `copy` replaces the input's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, word_count, written

SEED = 17
ALPHA = 0.8


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 of seed and key: the same in any engine."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float | None = None, alpha: float = ALPHA, text_col: str = "text", source_col: str = "source", tokens_col: str | None = None) -> DataFrame:
    """(source, tokens, rate), written. tokens_col: a count that the table has; else whitespace words. weights: target share of each source (absent: tokens ** alpha). budget: tokens to emit;
    None takes the least budget at which no weighted source falls below one copy, so no document is lost."""
    t = docs.groupBy(F.col(source_col).alias("source")).agg(F.coalesce(F.sum(F.col(tokens_col).cast("long") if tokens_col else word_count(F.col(text_col))), F.lit(0)).alias("tokens"))
    t = written(t, "source-tokens")
    if weights is None:
        w = F.pow(F.col("tokens").cast("double"), F.lit(float(alpha)))
    else:
        w = F.lit(0.0)
        for k, v in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(w)
    t = t.withColumn("w", w)
    some = F.when((F.col("tokens") > 0) & (F.col("w") > 0), F.col("w") / F.col("tokens"))
    all_ = t.agg(F.min(some).alias("least"), F.sum(F.when(F.col("tokens") > 0, F.col("w"))).alias("sum_w"))
    per = F.col("w") / F.col("tokens")
    rate = per / F.col("least") if budget is None else per * F.lit(float(budget)) / F.col("sum_w")
    none = F.lit(False) if weights is None else F.col("w") <= 0
    rate = F.when(none, F.lit(0.0)).when(F.col("tokens") == 0, F.lit(1.0)).otherwise(F.round(rate, 6))
    # one row on the other side: a broadcast of fixed size
    return written(t.crossJoin(F.broadcast(all_)).select("source", "tokens", rate.alias("rate")), "source-rates")


def mix(docs: DataFrame, rates: DataFrame, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", copy_col: str | None = "copy") -> DataFrame:
    """Emits the copies, numbered from 0 in copy_col (None: not numbered). The rates are joined by broadcast while a
    count allows it, else by a shuffle; the texts then move once."""
    r = rates.select(F.col("source").alias("s"), "rate")
    cols = [F.col(f"`{c}`") for c in docs.columns if c != copy_col]
    d = docs.select(F.struct(*cols).alias("row"), F.col(source_col).alias("source"), uniform(F.col(id_col), seed).alias("u"))
    d = d.join(small(r), F.col("source").eqNullSafe(F.col("s")), "inner")
    n = F.floor("rate") + F.when(F.col("u") < F.col("rate") - F.floor("rate"), F.lit(1)).otherwise(F.lit(0))
    d = d.withColumn("n", n.cast("int")).filter("n > 0").select("row", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("c"))
    return d.select("row.*", *([F.col("c").alias(copy_col)] if copy_col else []))
