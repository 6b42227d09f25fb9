"""Hold-out and k-fold splits and class balance, by hashed row order: deterministic and independent of partitioning.

No split ranks its table in one task: see ranking. Rows that repeat an id are rows of their own."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import hash_bucket, numbered


def shuffled(id_col: str, seed: int) -> list[Column]:
    return [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)]


def _placed(df: DataFrame, out: str, id_col: str, seed: int, order: list[Column] | None, group: str | None = None) -> DataFrame:
    """An order of the caller's begins with its bucket: a column that doesn't fall where the order rises."""
    bucket, *order = order or [hash_bucket(shuffled(id_col, seed)[0]), *shuffled(id_col, seed)]
    return numbered(df, bucket, order, out, group)


def holdout_sizes(n: int, train: float, test: float | None = None) -> tuple[int, int]:
    a = min(n, math.ceil(n * train))
    return a, min(n - a, math.ceil(n * (1 - train if test is None else test)))


def parse_ratio(text: str) -> tuple[float, float | None]:
    """'0.7' or '0.5:0.2'."""
    a, mark, b = text.partition(":")
    return float(a), float(b) if mark else None


def holdout(df: DataFrame, train: float = 0.7, test: float | None = None, id_col: str = "doc_id", seed: int = 0, order: list[Column] | None = None) -> DataFrame:
    """The rows with part 'train', 'test' or null, in exact sizes."""
    a, b = holdout_sizes(df.count(), train, test)
    part = F.when(F.col("_r") < a, "train").when(F.col("_r") < a + b, "test")
    return _placed(df, "_r", id_col, seed, order).withColumn("part", part).drop("_r")


def folds(df: DataFrame, k: int, label_col: str | None = None, id_col: str = "doc_id", seed: int = 0, order: list[Column] | None = None) -> DataFrame:
    """The rows with fold 0..k-1; with a label each class is spread evenly over the folds."""
    return _placed(df, "_r", id_col, seed, order, label_col).withColumn("fold", (F.col("_r") % k).cast("int")).drop("_r")


def balanced(df: DataFrame, label_col: str = "klass", text_col: str = "text", id_col: str = "doc_id", seed: int = 0, faithful: bool = False) -> DataFrame:
    """(slot, klass, texts): as many rows for each class as the smallest has; surplus documents join a slot at random, so
    that no text is lost. faithful: a surplus document replaces what had joined its slot before."""
    k = F.col(label_col).cast("string")
    d = df.select(k.alias("klass"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sizes = d.groupBy("klass").agg(F.count("*").alias("n"))
    least = sizes.agg(F.min("n").alias("least"))
    r = _placed(d, "r", "id", seed, None, "klass").crossJoin(F.broadcast(least))  # one row
    extra = F.col("r") >= F.col("least")
    r = r.withColumn("slot", F.when(extra, F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.col("least"))).otherwise(F.col("r")).cast("int"))
    if faithful:  # a slot's own document and the last one that joined it
        own = r.filter("r < least").select("klass", "slot", F.col("text").alias("own"))
        last = r.filter("r >= least").groupBy("klass", "slot").agg(F.max_by("text", "r").alias("last"), F.count("*").alias("joined"))
        texts = F.when(F.col("joined").isNull(), F.array("own")).otherwise(F.array("own", "last"))
        return own.join(last, ["klass", "slot"], "left").select("slot", "klass", texts.alias("texts"))
    g = r.groupBy("klass", "slot").agg(F.array_sort(F.collect_list(F.struct("r", "text"))).alias("s"))
    return g.select("slot", "klass", F.transform("s", lambda x: x["text"]).alias("texts"))
