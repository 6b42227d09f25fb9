"""Linear classifiers and regressors on sparse vectors.

The objective is that of the usual linear SVM: half the squared weights plus C times the squared hinge loss over all
rows, one class against the rest, with the bias as a weight; the regressor has the absolute loss (rounded within 0.01).
Rows are kept on disk as blocks of arrays, each bounded by its entries, with the entries in order of row and of column.
Each step of L-BFGS sums loss and gradient over the blocks in numpy, adds the tasks' sums up in Spark, and fetches one
gradient; the driver never holds rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of training rows that are worth a task of their own, about, and numbers of a gradient that are summed up together.
PART_ENTRIES, SLICE = 250_000, 1 << 17
#: Entries and rows that Python has in hand at a time, however large the batches are that it gets.
BLOCK_ENTRIES, BLOCK_ROWS = 250_000, 4096
SOFT = 0.01
#: Most labels a classifier takes: one output and one column of weights for each.
MOST_LABELS = 10_000


def pieces(ids: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of the lists with BLOCK_ENTRIES entries and BLOCK_ROWS lists at most; a longer list is a range by itself."""
    upto = np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ids):
        most = (upto[at - 1] if at else 0) + BLOCK_ENTRIES
        end = min(max(at + 1, int(np.searchsorted(upto, most, "right"))), at + BLOCK_ROWS, len(ids))
        yield at, end
        at = end


@dataclass
class Rows:
    """Sparse rows: entry i has value v[i] at column c[i] of row r[i]."""

    r: np.ndarray
    c: np.ndarray
    v: np.ndarray
    y: np.ndarray

    @classmethod
    def of(cls, ids: pa.Array, vals: pa.Array, y: np.ndarray, width: int) -> Rows:
        """From lists of columns and values; unseen or broken entries don't count."""
        r = np.repeat(np.arange(len(ids), dtype=np.int32), pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))
        c = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        v = vals.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False)
        ok = np.isfinite(v) & (c < width) & (c >= 0)
        return cls(r[ok], c[ok], v[ok], y)

    def dump(self) -> bytes:
        """The rows as a Block, whose columns are numbered by themselves."""
        cols, c, uses = np.unique(self.c, return_inverse=True, return_counts=True)
        c = c.astype(np.uint16 if len(cols) <= 1 << 16 else np.int32)
        by = np.argsort(c, kind="stable").astype(np.int32)
        of_row = np.bincount(self.r, minlength=len(self.y)).astype(np.int32)
        return pickle.dumps((self.y.astype(float), cols.astype(np.int32), c, self.v, of_row, by, uses.astype(np.int32)), 5)

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.y), w.shape[1]))
        for k in range(w.shape[1]):
            out[:, k] = np.bincount(self.r, self.v * w[self.c, k], minlength=len(self.y)) + w[-1, k]
        return out


def _sums(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of x, as many as counts says."""
    out = np.zeros(len(counts))
    if len(x):
        full = counts > 0
        out[full] = np.add.reduceat(x, (np.cumsum(counts) - counts)[full])
    return out


class Block:
    """Training rows: targets y; columns cols; by row the entries' columns (places in cols) and values, by column their rows and values."""

    def __init__(self, data: bytes):
        self.y, self.cols, self.c, self.v, self.of_row, by, self.of_col = pickle.loads(data)
        self.r = np.repeat(np.arange(len(self.y), dtype=np.int32), self.of_row)[by]
        self.u = self.v[by]

    def times(self, w: np.ndarray, k: int) -> np.ndarray:
        return _sums(self.v * w[self.cols, k][self.c], self.of_row) + w[-1, k]

    def add_back(self, g: np.ndarray, k: int, to: np.ndarray) -> None:
        to[self.cols, k] += _sums(self.u * g[self.r], self.of_col)
        to[-1, k] += g.sum()


def _loss(x: Block, w: np.ndarray, classes: int | None, to: np.ndarray) -> float:
    """The block's loss; its gradient is added to to."""
    total = 0.0
    for k in range(w.shape[1]):
        f = x.times(w, k)
        if classes is None:
            d = f - x.y
            near = np.abs(d) < SOFT
            total += np.where(near, d * d / (2 * SOFT) + SOFT / 2, np.abs(d)).sum()
            g = np.where(near, d / SOFT, np.sign(d))
        else:
            s = np.where(x.y == (k if w.shape[1] > 1 else 1), 1.0, -1.0)
            m = np.maximum(0, 1 - s * f)
            total += (m * m).sum()
            g = -2 * s * m
        x.add_back(g, k, to)
    return float(total)


def lbfgs(fun: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int = 60, tol: float = 1e-4) -> np.ndarray:
    shape, w = w.shape, w.ravel()
    f, g = fun(w.reshape(shape))
    g = g.ravel()
    start, hist = np.linalg.norm(g), []
    for _ in range(steps):
        if np.linalg.norm(g) <= tol * max(start, 1e-12):
            break
        d, alphas = -g, []
        for s, y, rho in reversed(hist):
            a = rho * (s @ d)
            alphas.append(a)
            d = d - a * y
        if hist:
            s, y, _ = hist[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, np.linalg.norm(g))
        for (s, y, rho), a in zip(hist, reversed(alphas), strict=True):
            d = d + s * (a - rho * (y @ d))
        t, slope = 1.0, g @ d
        while True:
            fn, gn = fun((w + t * d).reshape(shape))
            if fn <= f + 1e-4 * t * slope or t < 1e-8:
                break
            t /= 2
        gn = gn.ravel()
        s, y = t * d, gn - g
        if s @ y > 1e-12:
            hist = [*hist[-9:], (s, y, 1 / (s @ y))]
        w, f, g = w + s, fn, gn
    return w.reshape(shape)


def _ids(vec: str) -> Column:
    return F.transform(vec, lambda p: p["token_id"])


def _vals(vec: str) -> Column:
    return F.transform(vec, lambda p: p["value"])


def packed(rows: DataFrame, width: int) -> tuple[RDD, int]:
    """The training rows as blocks, kept on the executors' disks (a pass gets them one by one, and no heap holds them),
    and the number of tasks that a pass over them takes: never more than there are cores, as each has a gradient of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end in pieces(b.column(0)):
                part = b.slice(at, end - at)
                x = Rows.of(part.column(0), part.column(1), part.column(2).to_numpy(), width)
                yield pa.RecordBatch.from_pydict({"entries": [len(x.v)], "n": [len(x.y)], "block": [x.dump()]})

    d = rows.select(_ids("vec").alias("ids"), _vals("vec").alias("vals"), F.col("y").cast("double").alias("y"))
    blocks = d.mapInArrow(run, "entries long, n long, block binary").rdd.map(tuple).persist(StorageLevel.DISK_ONLY)
    entries, n = blocks.map(lambda b: b[:2]).fold((0, 0), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    if not n:
        raise ValueError("nothing to learn from: no rows")
    return blocks, max(1, min(-(-entries // PART_ENTRIES), rows.sparkSession.sparkContext.defaultParallelism))


@dataclass
class LinearModel:
    """weights: (width + 1, outputs), the last row the biases; labels: the classes, None for a regressor."""

    weights: np.ndarray
    labels: list[str] | None

    @classmethod
    def fit(cls, rows: DataFrame, width: int, labels: list[str] | None, c: float = 1.0) -> LinearModel:
        """rows: (vec, y), vec as as_vectors() makes it; y the number of the class or the target."""
        classes = None if labels is None else len(labels)
        if classes is not None and not 2 <= classes <= MOST_LABELS:
            raise ValueError(f"nothing to learn from: {classes} classes")
        outputs = 1 if classes is None or classes <= 2 else classes
        blocks, parts = packed(rows, width)
        tasks, context = blocks.coalesce(parts), rows.sparkSession.sparkContext

        def total(w: np.ndarray) -> tuple[float, np.ndarray]:
            shared = context.broadcast(w)

            def run(found: Iterator[tuple[int, int, bytes]]) -> Iterator[tuple[int, tuple[float, np.ndarray]]]:
                f, g = 0.0, np.zeros_like(shared.value)
                for _, _, block in found:
                    f += _loss(Block(block), shared.value, classes, g)
                flat = g.ravel()
                for s, at in enumerate(range(0, len(flat), SLICE)):
                    yield s, (0.0 if s else f, flat[at : at + SLICE])

            got = tasks.mapPartitions(run)
            if parts > 1:  # sums of the tasks' sums: what the driver gets is one gradient
                got = got.reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), min(parts, -(-w.size // SLICE)))
            f, g = 0.0, np.zeros(w.size)
            for s, (fs, part) in got.collect():
                f += fs
                g[s * SLICE : s * SLICE + len(part)] += part
            shared.destroy()
            return f, g.reshape(w.shape)

        def fun(w: np.ndarray) -> tuple[float, np.ndarray]:
            f, g = total(w)
            return 0.5 * float((w * w).sum()) + c * f, w + c * g

        try:
            return cls(lbfgs(fun, np.zeros((width + 1, outputs))), labels)
        finally:
            blocks.unpersist()

    def decide(self, vectors: DataFrame, proba: bool = False) -> DataFrame:
        """The rows with decision (array) and predicted (label, or value of a regressor). proba adds predict_proba, a
        number for each class: the logistic function of the decisions, scaled to sum to 1."""
        shared = vectors.sparkSession.sparkContext.broadcast(self.weights)

        @F.arrow_udf("array<double>")
        def scores(ids: pa.Array, vals: pa.Array) -> pa.Array:
            w, f = shared.value, np.empty((len(ids), shared.value.shape[1]))
            for at, end in pieces(ids):
                f[at:end] = Rows.of(ids.slice(at, end - at), vals.slice(at, end - at), np.zeros(end - at), len(w) - 1).times(w)
            return pa.ListArray.from_arrays(np.arange(len(f) + 1, dtype=np.int32) * f.shape[1], f.ravel())

        d = vectors.withColumn("decision", scores(_ids("vec"), _vals("vec")))
        if self.labels is None:
            return d.withColumn("predicted", F.get("decision", 0))
        one = lambda x: 1 / (1 + F.exp(-x))
        if proba:
            if len(self.labels) == 2:
                p = one(F.get("decision", 0))
                d = d.withColumn("predict_proba", F.array(1 - p, p))
            else:
                each = F.transform("decision", one)
                of_all = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
                d = d.withColumn("predict_proba", F.transform(each, lambda x: F.when(of_all > 0, x / of_all).otherwise(1.0 / len(self.labels))))
        if len(self.labels) == 2:
            return d.withColumn("predicted", F.when(F.get("decision", 0) > 0, self.labels[1]).otherwise(self.labels[0]))
        names = F.array(*[F.lit(x) for x in self.labels])
        return d.withColumn("predicted", F.get(names, F.array_position("decision", F.array_max("decision")).cast("int") - 1))
