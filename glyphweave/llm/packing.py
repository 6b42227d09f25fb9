"""Vector best-fit packing of documents into training sequences.

A bin has three capacities: tokens, documents and attention cost (the sum of squared piece lengths, as attention stays
within a document). Items go in decreasing size to the open bin that all three residuals admit and that scores best:
by the weighted dot product of demand and residual ("dot", largest) or the weighted norm of what would remain ("norm",
least). Documents longer than a bin are cut into consecutive pieces, so that whole texts are packed.

Defined results: a null or empty text has no token and is placed nowhere: it is in no bin and gives no row. Ties among
items go by (doc_id, row's place), among bins to the oldest. Repeated rows are items of their own. An empty table gives
an empty table. Other columns are ignored, clashing names included.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_count

CAPACITY, MAX_DOCS, GROUP_ITEMS = 4096, 32, 20_000
WEIGHTS = (1.0, 0.25, 0.25)
SCHEMA = "bin_id string, slot int, doc_id long, piece int, first_token long, tokens long"


def best_fit(tokens: np.ndarray, capacity: int, max_docs: int, attention: float, rule: str = "norm", weights: tuple = WEIGHTS) -> np.ndarray:
    """Bin of each item, for items in the order given."""
    caps, w = np.array([capacity, max_docs, attention], float), np.array(weights)
    demand = np.column_stack([tokens, np.ones(len(tokens)), tokens.astype(float) ** 2])
    if (demand > caps).any():
        raise ValueError("an item exceeds a bin")
    demand = demand / caps
    least = demand.min(axis=0) if len(demand) else caps
    room = np.empty((256, 3))  # residuals of the open bins, in order of opening
    ids = np.empty(256, np.int64)
    open_, made, out = 0, 0, np.empty(len(tokens), np.int64)
    for i, d in enumerate(demand):
        left = room[:open_] - d
        fits = np.flatnonzero((left >= -1e-12).all(axis=1))
        if len(fits):
            score = (left[fits] ** 2) @ w if rule == "norm" else -(room[fits] @ (w * d))
            k = fits[score.argmin()]
        else:
            if open_ == len(room):
                room, ids = np.vstack([room, np.empty_like(room)]), np.concatenate([ids, np.empty_like(ids)])
            k, open_ = open_, open_ + 1
            room[k], ids[k], made = 1.0, made, made + 1
        out[i] = ids[k]
        room[k] -= d
        if (room[k] < least - 1e-12).any():  # nothing fits there any more
            room[k : open_ - 1], ids[k : open_ - 1] = room[k + 1 : open_].copy(), ids[k + 1 : open_].copy()
            open_ -= 1
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, attention: float | None = None, rule: str = "norm", weights: tuple = WEIGHTS, group_items: int = GROUP_ITEMS, text_col: str = "text", id_col: str = "doc_id", tokens_col: str | None = None) -> DataFrame:
    """(bin_id, slot, doc_id, piece, first_token, tokens). attention defaults to 0.75 capacity². tokens_col: a count that
    the table has; else whitespace words. Items are dealt by hash to groups of about group_items, as many as the table
    needs; each is packed on its own, so a task's memory doesn't grow with the table; only ids and lengths move."""
    if attention is None:
        attention = 0.75 * capacity**2
    longest = int(min(capacity, math.isqrt(int(attention))))
    n = F.col(tokens_col).cast("long") if tokens_col else word_count(F.col(text_col))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n")).filter("n > 0")
    pieces = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / longest).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("long") * longest).alias("first_token"), F.least(F.lit(longest).cast("long"), F.col("n") - F.col("piece").cast("long") * longest).alias("tokens"))
    rows = docs.select(F.lit(1)).count()
    groups = max(1, round(rows / group_items))
    pieces = pieces.withColumn("g", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "piece", "tokens"), F.lit(groups)))

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable", na_position="first")
        k = best_fit(b.tokens.to_numpy(), capacity, max_docs, attention, rule, weights)
        return pd.DataFrame({"bin_id": [f"{key[0]}-{x}" for x in k], "slot": pd.Series(k).groupby(k).cumcount().astype("int32").to_numpy(), "doc_id": b.doc_id.astype("Int64").to_numpy(), "piece": b.piece.to_numpy(), "first_token": b.first_token.to_numpy(), "tokens": b.tokens.to_numpy()})

    return pieces.groupBy("g").applyInPandas(run, SCHEMA)
