"""Reversible, incremental line deduplication.

A line (without surrounding white space; blank lines are left alone) stays at its first place by (doc_id, line number)
and goes wherever it occurs again. The state is a LineIndex in the shared folder:

* places: a row for each line of each document (128-bit hash, doc_id, line number), by which a deletion is undone;
* refs: the exact table of distinct lines, their reference counts and their first places;
* filters: for each shard of the hash space a cuckoo filter of the lines in refs. An insertion asks the filters first,
  and only lines they don't rule out look into refs; a deletion takes out the fingerprints of lines whose count ends.

The first places of new lines come from one aggregation with map-side combining, and documents are rebuilt from the
first places they own, so a line that a tenth of all documents share never gathers in one task.

Defined results: a null text stays null, an empty one empty; a document that loses all its lines is emitted with an
empty text and lines_kept 0. Rows that repeat a doc_id count as one document: each keeps the line numbers that the id
keeps. A null doc_id is an id, and sorts first. Extra columns pass through; clashes with lines_in or
lines_kept replace the input's. An empty table gives an empty table and leaves the index as it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, mix64, work_dir, written

SLOTS, FULL = 4, 0.96
SHARD_LINES = 1_000_000
_TRIM = " \t\r\x0b\x0c"


class CuckooFilter:
    """16-bit fingerprints in buckets of four; every operation takes arrays of 64-bit hashes."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _spots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = mix64(h.astype(np.uint64))
        f = ((x >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        m = len(self.table) - 1
        a = (x & np.uint64(m)).astype(np.int64)
        return f, a, self._other(f, a)

    def _other(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        return b ^ (mix64(f.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        f, a, b = self._spots(h)
        return (self.table[a] == f[:, None]).any(axis=1) | (self.table[b] == f[:, None]).any(axis=1)

    def _place(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Puts fingerprints where their bucket has room; returns which were put."""
        o = np.argsort(b, kind="stable")
        fs, bs = f[o], b[o]
        first = np.flatnonzero(np.concatenate(([True], bs[1:] != bs[:-1])))
        rank = np.arange(len(bs)) - np.repeat(first, np.diff(np.append(first, len(bs))))
        free = self.table[bs] == 0
        ok = rank < free.sum(axis=1)
        order = np.argsort(~free[ok], axis=1, kind="stable")  # free slots first
        self.table[bs[ok], order[np.arange(ok.sum()), rank[ok]]] = fs[ok]
        done = np.zeros(len(f), bool)
        done[o] = ok
        return done

    def add(self, h: np.ndarray) -> bool:
        """False if it got too full: the caller rebuilds it larger. What can't fit isn't tried."""
        if not len(h):
            return True
        if np.count_nonzero(self.table) + len(h) > FULL * self.table.size:
            return False
        f, a, b = self._spots(h)
        left = ~self._place(f, a)
        f, b = f[left], b[left]
        if not len(f):
            return True
        left = ~self._place(f, b)
        f, b = f[left], b[left]
        if not len(f):
            return True
        rng = np.random.default_rng(1)
        at = b
        for _ in range(500):  # each full bucket evicts one fingerprint for one that waits; the evicted moves on
            _, one = np.unique(at, return_index=True)
            slot = rng.integers(0, SLOTS, len(one))
            out = self.table[at[one], slot].copy()
            self.table[at[one], slot] = f[one]
            wait = np.ones(len(f), bool)
            wait[one] = False
            f, at = np.concatenate([f[wait], out]), np.concatenate([at[wait], self._other(out, at[one])])
            real = f != 0
            f, at = f[real], at[real]
            left = ~self._place(f, at) if len(f) else np.zeros(0, bool)
            f, at = f[left], at[left]
            if not len(f):
                return True
        return False

    def remove(self, h: np.ndarray) -> None:
        """One fingerprint for each hash; only for hashes that were added."""
        f, *spots = self._spots(h)
        for k in (0, 1):  # the second bucket for those that the first one lacks
            left, had = np.arange(len(f)), np.zeros(len(f), bool)
            while len(left):  # a round takes at most one fingerprint out of each bucket
                _, one = np.unique(spots[k][left], return_index=True)
                now = left[one]
                hit = self.table[spots[k][now]] == f[now][:, None]
                has = hit.any(axis=1)
                self.table[spots[k][now[has]], hit[has].argmax(axis=1)] = 0
                had[now[has]] = True
                left = np.delete(left, one)
            f, spots = f[~had], [x[~had] for x in spots]

    @classmethod
    def of(cls, h: np.ndarray) -> CuckooFilter:
        n = len(h)
        while not (c := cls.sized(n)).add(h):
            n *= 2
        return c


def line_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, line_no, h1, h2): the non-blank lines."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    line = F.trim(F.col("line"), F.lit(_TRIM))
    d = d.withColumn("line", line).filter("line <> ''")
    return d.select("doc_id", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


@dataclass
class LineIndex:
    """The state's tables, by path; each operation returns a new state and leaves the old one readable."""

    spark: SparkSession
    shards: int
    refs: str | None = None
    filters: str | None = None
    places: tuple[str, ...] = ()

    def _shard(self) -> Column:
        return F.pmod(F.shiftright("h2", 7), F.lit(self.shards)).alias("shard")

    def _write(self, df: DataFrame, what: str) -> str:
        path = work_dir(self.spark, what)
        df.write.parquet(path)
        return path

    def forget(self, places: bool = False) -> None:
        """Deletes the tables of a state that nothing reads any more; the places only if the next state doesn't share them."""
        for p in (self.refs, self.filters, *(self.places if places else ())):
            if p:
                drop_path(self.spark, p)

    def _filters(self, refs: str) -> str:
        """The filters of all of refs, each built by one task from the hashes of its shard."""
        ref = self.spark.read.parquet(refs)
        make = lambda key, b: pd.DataFrame({"shard": [key[0]], "blob": [CuckooFilter.of(b.h1.to_numpy(np.int64).view(np.uint64)).dump()]})
        return self._write(ref.select(self._shard(), "h1").groupBy("shard").applyInPandas(make, "shard long, blob binary"), "line-filters")

    def _known(self, new: DataFrame) -> DataFrame:
        """The rows of new (one for each line) that refs has: filters first, refs for the rest."""
        blobs = self.spark.read.parquet(self.filters)

        def probe(b: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
            if not len(b) or not len(f):
                return b.iloc[:0]
            return b[CuckooFilter.load(f.blob.iloc[0]).contains(b.h1.to_numpy(np.int64).view(np.uint64))]

        maybe = new.select(self._shard(), "h1", "h2").groupBy("shard").cogroup(blobs.groupBy("shard")).applyInPandas(probe, "shard long, h1 long, h2 long")
        return maybe.join(self.spark.read.parquet(self.refs).select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2")

    def _updated(self, old: str, new: str, gone: str | None = None) -> str:
        """The filters with the fingerprints of new in and of gone out; one that overflows is built anew."""
        empty = self.spark.createDataFrame([], "h1 long, h2 long")
        read = lambda p: self.spark.read.parquet(p).select("h1", "h2") if p else empty
        change = read(new).select(self._shard(), "h1", F.lit(True).alias("put")).unionByName(read(gone).select(self._shard(), "h1", F.lit(False).alias("put")))

        def step(b: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
            shard = (b if len(b) else f).shard.iloc[0]
            c = CuckooFilter.load(f.blob.iloc[0]) if len(f) else CuckooFilter.sized(len(b))
            h = b.h1.to_numpy(np.int64).view(np.uint64)
            put = b.put.to_numpy(bool)
            c.remove(h[~put])
            return pd.DataFrame({"shard": [shard], "blob": [c.dump()], "full": [not c.add(h[put])]})

        got = written(change.groupBy("shard").cogroup(self.spark.read.parquet(old).groupBy("shard")).applyInPandas(step, "shard long, blob binary, full boolean"), "line-filters")
        if got.filter("full").isEmpty():
            return self._write(got.select("shard", "blob"), "line-filters")
        return ""

    def insert(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[LineIndex, DataFrame]:
        """The state with the documents in it, and the places their lines keep: (doc_id, line_no)."""
        lines = self._write(line_rows(docs, text_col, id_col), "line-places")
        place = self.spark.read.parquet(lines)
        new = self._write(place.groupBy("h1", "h2").agg(F.count("*").alias("refs"), F.min(F.struct("doc_id", "line_no")).alias("first")), "line-batch")
        batch = self.spark.read.parquet(new)
        if self.refs is None:
            made = LineIndex(self.spark, self.shards, new, self._filters(new), (lines,))
            return made, batch.select("first.doc_id", "first.line_no")
        known = written(self._known(batch), "line-known")
        fresh = self._write(batch.join(known, ["h1", "h2"], "left_anti"), "line-fresh")
        old = self.spark.read.parquet(self.refs)
        # a known line keeps the place it has, and counts the new references
        both = old.join(batch.select("h1", "h2", F.col("refs").alias("more")), ["h1", "h2"], "left").select("h1", "h2", (F.col("refs") + F.coalesce("more", F.lit(0))).alias("refs"), "first")
        refs = self._write(both.unionByName(self.spark.read.parquet(fresh)), "line-refs")
        filters = self._updated(self.filters, fresh) or self._filters(refs)
        return LineIndex(self.spark, self.shards, refs, filters, (*self.places, lines)), self.spark.read.parquet(fresh).select("first.doc_id", "first.line_no")

    def delete(self, ids: DataFrame) -> tuple[LineIndex, DataFrame]:
        """The state without the documents of the ids, and the places that lines get anew by it: (doc_id, line_no)."""
        ids = ids.select(F.col(ids.columns[0]).alias("doc_id")).distinct()
        place = self.spark.read.parquet(*self.places)
        same = place.doc_id.eqNullSafe(ids.doc_id)
        left = self._write(place.join(ids, same, "left_anti"), "line-places")
        lost = written(place.join(ids, same, "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("less")), "line-lost")
        old = self.spark.read.parquet(self.refs)
        rest = self.spark.read.parquet(left).join(lost, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("then"))
        hit = written(old.join(lost, ["h1", "h2"]).join(rest, ["h1", "h2"], "left").select("h1", "h2", (F.col("refs") - F.col("less")).alias("refs"), "first", "then"), "line-hit")
        gone = self._write(hit.filter("refs <= 0").select("h1", "h2"), "line-gone")
        # a line keeps its place if the document there stays, else it gets the least that is left
        stays = hit.filter("refs > 0").join(ids.withColumnRenamed("doc_id", "i"), F.col("first.doc_id").eqNullSafe(F.col("i")), "left_semi")
        moved = written(stays.select("h1", "h2", F.col("then").alias("first")), "line-moved")
        unmoved = hit.filter("refs > 0").join(moved.select("h1", "h2"), ["h1", "h2"], "left_anti").select("h1", "h2", "refs", "first")
        again = hit.select("h1", "h2", "refs").join(moved, ["h1", "h2"]).select("h1", "h2", "refs", "first")
        refs = self._write(old.join(lost, ["h1", "h2"], "left_anti").unionByName(unmoved).unionByName(again), "line-refs")
        filters = self._updated(self.filters, "", gone) or self._filters(refs)
        return LineIndex(self.spark, self.shards, refs, filters, (left,)), moved.select("first.doc_id", "first.line_no")


def rebuild(docs: DataFrame, kept: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents with only the kept and the blank lines, with lines_in and lines_kept (non-blank lines)."""
    names = ["lines_in", "lines_kept"]
    cols = [c for c in docs.columns if c not in names]
    own = kept.groupBy("doc_id").agg(F.collect_list("line_no").alias("_kept")).withColumnRenamed("doc_id", "_own")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    d = d.join(own, F.col("_id").eqNullSafe(F.col("_own")), "left").select("row", "_text", "_kept")
    at = cols.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, before, after = [], [], []
            for t, k in zip(b.column("_text").to_pylist(), b.column("_kept").to_pylist(), strict=True):
                if t is None:
                    texts.append(None), before.append(0), after.append(0)
                    continue
                lines, stay, n = t.split("\n"), set(k or ()), 0
                blank = [not x.strip(_TRIM) for x in lines]
                out = [x for i, x in enumerate(lines) if blank[i] or i in stay]
                n = len(lines) - sum(blank)
                kept_n = len(out) - sum(blank)
                texts.append("\n".join(out) if kept_n or not n else "")
                before.append(n), after.append(kept_n)
            flat = b.column("row").flatten()
            flat[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*flat, pa.array(before, pa.int32()), pa.array(after, pa.int32())], names=[*cols, *names])

    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in cols]).schema.fields, *[T.StructField(n, T.IntegerType()) for n in names]])
    return d.mapInArrow(run, schema)


def new_index(docs: DataFrame, shard_lines: int = SHARD_LINES) -> LineIndex:
    """An empty index whose number of shards suits about as many documents (nine lines each)."""
    rows = docs.select(F.lit(1)).count()
    return LineIndex(docs.sparkSession, max(1, -(-rows * 9 // shard_lines)))


def redelivered(docs: DataFrame, again: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents as they remain after a correction: those that again holds for come first, then the rest, to whose lines
    the filters are asked; then the first ones are deleted, which gives lines that others have their next places, and come
    once more, as the last. So a line stays at its first place among the rest, or else among those delivered again."""
    late = docs.filter(F.coalesce(again, F.lit(False)))
    one, _ = new_index(docs).insert(late, text_col, id_col)
    two, kept = one.insert(docs.filter(~F.coalesce(again, F.lit(False))), text_col, id_col)
    one.forget()
    three, moved = two.delete(late.select(id_col))
    two.forget(places=True)
    four, last = three.insert(late, text_col, id_col)
    three.forget()
    four.forget(places=True)
    return rebuild(docs, kept.unionByName(moved).unionByName(last), text_col, id_col)


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[LineIndex, DataFrame]:
    """All documents inserted into an empty index; the state and the documents as they remain."""
    index, kept = new_index(docs).insert(docs, text_col, id_col)
    return index, rebuild(docs, kept, text_col, id_col)
