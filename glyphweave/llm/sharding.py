"""Sharding by histogram sort.

A table is cut into ranges of a long key with near-equal bytes: in each round the exact bytes below candidate boundaries
are counted over all partitions and the candidates refined around each wanted quantile, until every splitter is within
the tolerance or is the exact key at which its quantile falls; then the rows are exchanged once, each to its shard.
A round has PROBES candidates for each open quantile, fewer where there are very many quantiles (ALL_PROBES in all), so
what the driver holds is a few arrays of as many numbers as shards; rows find their shard by a binary search in them.

Defined results: a null key counts as below all keys and goes to shard 0; a null text has 0 bytes. Equal keys stay
together, so a key heavier than a shard makes its shard heavy, and shards after it may be empty. Repeated rows all
stay. Extra columns pass through; a clash with `shard` replaces the input's. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SHARD_BYTES = 32 << 20
PROBES, ALL_PROBES = 63, 1 << 20


def _weights(docs: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(k, w): key and bytes, the only columns that the rounds read."""
    return docs.select(F.col(key_col).cast("long").alias("k"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("w"))


def _below(narrow: DataFrame, probes: np.ndarray) -> np.ndarray:
    """Exact bytes of the keys below each probe; each partition sends one histogram of the intervals, which are summed
    in Spark before they reach the driver: as many numbers as probes."""
    shared = narrow.sparkSession.sparkContext.broadcast(probes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = np.zeros(len(shared.value) + 1, np.int64)
        for b in batches:
            np.add.at(h, np.searchsorted(shared.value, b.k.to_numpy(), side="right"), b.w.to_numpy())
        some = np.flatnonzero(h)
        yield pd.DataFrame({"i": some, "w": h[some]})

    got = narrow.mapInPandas(run, "i long, w long").groupBy("i").agg(F.sum("w").alias("w")).toPandas()
    h = np.zeros(len(probes) + 1, np.int64)
    h[got.i.to_numpy(np.int64)] = got.w.to_numpy(np.int64)
    return np.cumsum(h)[:-1]  # keys k < probe: interval i holds probe[i-1] <= k < probe[i]


def refine(low: int, high: int, goal: np.ndarray, slack: float, below: Callable[[np.ndarray], np.ndarray], probes: int = PROBES) -> np.ndarray:
    """For each goal the least key of which the bytes up to and including it exceed the goal (low if all do), or within the
    slack an earlier one that was probed. below: exact bytes of the keys below each of some sorted probes."""
    lo, hi = np.full(len(goal), low, np.int64), np.full(len(goal), high, np.int64)  # the answer lies in [lo, hi]
    lo_at = np.where(goal < 0, 0, -(1 << 62)).astype(np.int64)  # bytes below lo, where probed
    done = goal < 0
    while not done.all():
        j = np.flatnonzero(~done)
        step = min(probes, max(1, ALL_PROBES // len(j)))
        start = lo[j].view(np.uint64)  # differences of longs may need 64 bits
        q, r = np.divmod(hi[j].view(np.uint64) - start, np.uint64(step + 1))
        far = [q * np.uint64(p) + (r * np.uint64(p) + np.uint64(step)) // np.uint64(step + 1) for p in range(1, step + 1)]
        keys = np.unique(np.concatenate([(start + x).view(np.int64) for x in far]))  # all above lo, none beyond hi
        values = below(keys)
        i = np.searchsorted(values, goal[j], side="right")  # first probe with more than the goal below it
        up, down = j[i > 0], j[i < len(keys)]
        last, next_ = i[i > 0] - 1, i[i < len(keys)]
        above = keys[last] > lo[up]
        lo[up[above]], lo_at[up[above]] = keys[last[above]], values[last[above]]
        hi[down] = np.minimum(hi[down], keys[next_] - 1)
        done[j] = (lo[j] >= hi[j]) | ((slack > 0) & (np.abs(lo_at[j] - goal[j]) <= slack))
    return lo


def find_splitters(narrow: DataFrame, shards: int, tolerance: float = 0.0, probes: int = PROBES) -> np.ndarray:
    """Splitters s_1..s_{shards-1}: shard j holds s_j <= key < s_{j+1}. The exact splitter of quantile q is the least key
    of which the bytes up to and including it exceed q; within the tolerance (a share of a shard) an earlier one does."""
    low, high, null_bytes, total = narrow.agg(F.min("k"), F.max("k"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("w"))), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    if low is None or shards < 2 or not total:
        return np.zeros(0, np.int64)
    keyed = narrow.filter("k is not null")
    goal = np.array([total * j // shards - null_bytes for j in range(1, shards)], np.int64)
    return refine(low, high, goal, tolerance * total / shards, lambda p: _below(keyed, p), probes)


def shard_of(spark: SparkSession, key: Column, splitters: np.ndarray) -> Column:
    """Number of splitters not above the key, by binary search in a broadcast array (8 bytes a shard)."""
    shared = spark.sparkContext.broadcast(np.asarray(splitters, np.int64))

    @F.pandas_udf("int")
    def count(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, k.to_numpy(np.int64), side="right").astype(np.int32))

    # a null key is below all keys
    return F.when(key.isNull(), F.lit(0)).otherwise(count(F.coalesce(key.cast("long"), F.lit(-(2**63)))))


def shard(docs: DataFrame, shard_bytes: int = SHARD_BYTES, shards: int | None = None, tolerance: float = 0.0, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their shard, one shard to a partition, in key order. shards defaults to total bytes / shard_bytes."""
    narrow = written(_weights(docs, key_col, text_col), "shard-keys")
    if shards is None:
        shards = max(1, -(-(narrow.agg(F.sum("w")).first()[0] or 0) // shard_bytes))
    cuts = find_splitters(narrow, shards, tolerance)
    cols = [F.col(f"`{c}`") for c in docs.columns if c != "shard"]
    d = docs.select(*cols, shard_of(docs.sparkSession, F.col(key_col), cuts).cast("int").alias("shard"))
    return d.repartitionById(shards, F.col("shard")).sortWithinPartitions(F.col(key_col))
