"""Exact top-k inner-product search with ball trees: a stated set of queries against all rows.

Vectors are dealt to shards; each shard holds a ball tree. A block of queries goes down a tree together: at a node of
centre c and radius r no inner product exceeds q.c + |q| r, so queries whose k-th score lies above that leave, and the
child with the larger bound is visited first. Each query first searches its own shard and so has a k-th score before it
meets others; a block of queries carries its k-th scores from shard to shard within a task, so each shard is searched with
the best bound so far. A task holds one block of queries and one tree at a time, whatever the table's size.

Scores are rounded to 6 digits and ties go to the lower id, so that results don't depend on the order of summation.

Defined results: a vector that is null, empty, of another length than most, or holds null or non-finite numbers is
neither query nor result; so is a row without id. A query's own id is left out, repeated rows of it too. Fewer than k
others give fewer rows. Extra columns are ignored, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

K, SHARD_ROWS, LEAF = 10, 4096, 128
#: The queries are the rows whose id is divisible by EVERY; so many of them form a block, so many blocks or trees a partition.
EVERY, QUERY_ROWS, SPAN = 50, 1024, 64
EPS = 1e-6


def build(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> dict:
    """A ball tree in arrays: nodes are (start, end, left, right), left -1 at a leaf; rows in tree order."""
    order = np.arange(len(x))
    nodes, centre, radius = [], [], []

    def grow(lo: int, hi: int) -> int:
        own = x[order[lo:hi]]
        c = own.mean(axis=0)
        d = np.sqrt(((own - c) ** 2).sum(axis=1))
        me = len(nodes)
        nodes.append([lo, hi, -1, -1]), centre.append(c), radius.append(d.max())
        if hi - lo > leaf and radius[me] > 0:
            a = own[d.argmax()]  # far ends of the ball; the rows split at the median between them
            b = own[((own - a) ** 2).sum(axis=1).argmax()]
            o = np.argsort(own @ (b - a), kind="stable")
            order[lo:hi] = order[lo:hi][o]
            mid = (lo + hi) // 2
            left = grow(lo, mid)
            nodes[me][2:] = [left, grow(mid, hi)]
        return me

    if len(x):
        grow(0, len(x))
    return {"ids": ids[order], "x": x[order], "nodes": nodes, "centre": np.array(centre), "radius": np.array(radius)}


def fresh(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Empty results: scores and ids of k places for n queries."""
    return np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)


def search(tree: dict, qid: np.ndarray, q: np.ndarray, score: np.ndarray, who: np.ndarray, some: np.ndarray | None = None) -> int:
    """Betters the results (in place, best first) of the queries at some places (all if None) by the tree's rows; returns
    the inner products it computed."""
    if not tree["nodes"]:
        return 0
    norm, k, done = np.sqrt((q**2).sum(axis=1)), score.shape[1], 0
    some = np.arange(len(q)) if some is None else some
    stack = [(0, some, np.full(len(some), np.inf))]
    while stack:
        node, act, bound = stack.pop()
        act = act[bound + EPS >= score[act, -1]]
        if not len(act):
            continue
        lo, hi, left, right = tree["nodes"][node]
        if left < 0:
            s = np.round(q[act] @ tree["x"][lo:hi].astype(np.float64).T, 6)
            done += s.size
            ids = tree["ids"][lo:hi]
            s[qid[act][:, None] == ids[None, :]] = -np.inf
            better = np.flatnonzero((s >= score[act, -1:]).any(axis=1))
            if len(better):
                rows, s = act[better], s[better]
                if s.shape[1] > 2 * k:  # all that reach the row's k-th score of the leaf take part, ties included
                    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                    s = np.where(s >= kth, s, -np.inf)
                    width = int((s > -np.inf).sum(axis=1).max())
                    pick = np.argsort(-s, axis=1, kind="stable")[:, :width]
                    cand, ci = np.take_along_axis(s, pick, axis=1), ids[pick]
                else:
                    cand, ci = s, np.broadcast_to(ids, s.shape)
                alls, alli = np.hstack([score[rows], cand]), np.hstack([who[rows], np.where(cand > -np.inf, ci, np.iinfo(np.int64).max)])
                o = np.lexsort((alli, -alls), axis=1)[:, :k]
                score[rows], who[rows] = np.take_along_axis(alls, o, axis=1), np.take_along_axis(alli, o, axis=1)
            continue
        ub = {c: q[act] @ tree["centre"][c] + norm[act] * tree["radius"][c] for c in (left, right)}
        near, far = (left, right) if ub[left].mean() >= ub[right].mean() else (right, left)
        stack += [(far, act, ub[far]), (near, act, ub[near])]
    return done


def _matrix(vectors: list) -> np.ndarray:
    return np.array(vectors, np.float64).reshape(len(vectors), -1)


def clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a finite vector of the most frequent length."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    d = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
    sizes = d.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").limit(1).collect()
    return d.filter(F.size("v") == (sizes[0].s if sizes else 0))


def top_k(df: DataFrame, k: int = K, every: int = EVERY, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbour_id, score) for every vector whose id is divisible by every, against all vectors."""
    d = clean(df, id_col, vector_col)
    rows = d.count()
    shards = max(1, -(-rows // shard_rows))
    blocks = max(1, -(-rows // (every * QUERY_ROWS)))
    state = "ids binary, home binary, x binary, s binary, w binary"

    def plant(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.drop_duplicates("id").sort_values("id")
        ids, x = b.id.to_numpy(), _matrix(b.v.tolist())
        tree = build(ids, x)
        if (tree["x"].astype(np.float32) == tree["x"]).all():
            tree["x"] = tree["x"].astype(np.float32)
        ask = ids % every == 0
        s, w = fresh(int(ask.sum()), k)
        search(tree, ids[ask], x[ask], s, w)  # its own shard first
        return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps(tree)], "ids": [ids[ask].tobytes()], "home": [np.full(len(s), key[0], np.int64).tobytes()], "x": [x[ask].tobytes()], "s": [s.tobytes()], "w": [w.tobytes()]})

    def unite(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], **{c: [b"".join(b[c])] for c in ("ids", "home", "x", "s", "w")}})

    trees = written(d.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).groupBy("shard").applyInPandas(plant, f"shard long, tree binary, {state}"), "ball-trees")
    asked = trees.select(F.pmod("shard", F.lit(blocks)).alias("block"), "ids", "home", "x", "s", "w").groupBy("block").applyInPandas(unite, f"block long, {state}")
    asked = written(asked.filter("length(ids) > 0"), "queries")
    # every block of queries meets every tree: a grid of tasks, as many as blocks times shards ask for
    least = min(shards, max(8, df.sparkSession.sparkContext.defaultParallelism))
    q = asked.repartition(-(-blocks // SPAN), "block")
    base = trees.select("shard", "tree").repartition(max(least, -(-shards // SPAN)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, home, x, s, w = (None,) * 6

        def found() -> pa.RecordBatch:
            ok = s > -np.inf
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, ok.sum(axis=1))), pa.array(w[ok]), pa.array(s[ok])], names=["query_id", "neighbour_id", "score"])

        for b in batches:
            for r in range(b.num_rows):
                if (now := b.column(0)[r].as_py()) != block:
                    if block is not None:
                        yield found()
                    block, ids = now, np.frombuffer(b.column(1)[r].as_py(), np.int64)
                    home = np.frombuffer(b.column(2)[r].as_py(), np.int64)
                    x = np.frombuffer(b.column(3)[r].as_py()).reshape(len(ids), -1)
                    s = np.frombuffer(b.column(4)[r].as_py()).reshape(-1, k).copy()
                    w = np.frombuffer(b.column(5)[r].as_py(), np.int64).reshape(-1, k).copy()
                search(pickle.loads(b.column(7)[r].as_py()), ids, x, s, w, np.flatnonzero(home != b.column(6)[r].as_py()))
        if block is not None:
            yield found()

    # every task gives the rows of the queries' own shards: repeats go, and the best k of all tasks stay
    got = q.crossJoin(base).mapInArrow(run, "query_id long, neighbour_id long, score double").distinct()
    best = got.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "neighbour_id"))), 1, k).alias("b"))
    return best.select("query_id", F.posexplode("b").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.neighbour_id").alias("neighbour_id"), (-F.col("x.m")).alias("score"))
