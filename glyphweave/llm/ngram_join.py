"""Exact self-join on the Jaccard similarity of word n-gram sets: rarest n-grams as keys, parity sketches, verification.

All n-grams have one order: those that a sample of the documents repeats come last, by their count there, equal ones by
hash. Two sets that reach the threshold t have their first 1 + SPARE common n-grams (all, if t asks for fewer) within the
first n - ceil(t * n) + 1 + SPARE of either, so that these are the keys of a set, and no such pair has fewer in common. The
sample decides on run lengths only, never on results. A key goes with its place and the set's size: the places of these
common n-grams leave room for the overlap that t asks for, and sizes are in the proportion t. Both tests are rounded so
that they err towards keeping.

A sketch XORs one bit per n-gram of the whole set into a power of two of bits, by size band (bands grow by 1/t, one of them
ends at STRICT); folding it in halves gives the shorter sketch. The Hamming distance of two sketches never exceeds the
size of the symmetric difference, folded or not, and is held against the largest one that t allows: no pair that reaches t
is dropped.

Rows with the same set are one content, the node of all that follows. The pairs of key runs of up to RUN contents are
counted, and those with 1 + SPARE keys tested by sketch: a pair with fewer reaches t only if it meets in a longer run. Of
such a run, each content is tested with NEXT others at first; only contents that no link connects by then are held against each other, all pairs in blocks, of whose hits only the links that keep them connected go on. A
passage that m contents share and that isn't in the sample costs m * m sketch distances if they aren't near each other.
Connected components are verified exactly, all pairs of a component in blocks.

Results: classes() has a row for each document, (doc_id, class_id, links): the least doc_id that it is connected with
(its own if there is none) and the number of other documents whose similarity with it reaches the threshold, copies
included. A block of verified pairs sends on only these counts and links that keep its contents connected, and copies of
a content are counted, never listed: rows grow with the documents, not with the pairs. pairs() has the exact pairs of
class representatives (the least doc_id of each content), membership() the representative of each document.

Defined results: null and empty texts, or those of punctuation only, have no n-gram and join nothing (class_id their own,
links 0); a text of fewer than n words is one gram. Repeated rows are copies of their own, a row each; rows that
repeat a doc_id with another text belong to the content of that text. Rows without doc_id are left out. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, mix64, normal_bytes, shingle_set, shuffle_parts, small, word_hashes, written

N, THRESHOLD, STRICT, BLOCK = 3, 0.6, 24, 1500
RUN, RUN_BLOCK, NEXT, SPARE = 128, 4000, 4, 2
#: Share of the documents from whose n-grams the order is taken (of the table, so that the runs of what it doesn't name don't
#: grow with it), and n-grams that it names at most.
SAMPLE, COMMON = 1 / 16, 2_000_000
#: Keys of a task's rows for one slot; steps of the logarithm of sizes that a key carries.
BLOB, STEPS = 256, 2048
MARKS = "doc_id long, n int, node long, keys binary, sketch binary"


def size_band(n: int, t: float) -> int:
    """The band of sets of n n-grams: bands reach up to STRICT * t ** k, the least has number 0."""
    return _strict_band(t) + math.ceil(math.log(n / STRICT) / -math.log(t) - 1e-9)


def _strict_band(t: float) -> int:
    return int(math.log(STRICT) / -math.log(t) + 1e-9)


def band_top(band: int, t: float) -> float:
    return STRICT * t ** (_strict_band(t) - band)


def prefix(grams: np.ndarray, t: float, common: np.ndarray | None = None, count: np.ndarray | None = None) -> np.ndarray:
    """The first n-grams of a sorted set in the order of all: 1 + SPARE of them are among those of any set that reaches t."""
    k = len(grams) - math.ceil(t * len(grams) - 1e-9) + 1 + SPARE
    if common is None or not len(common):
        return grams[:k]
    at = np.searchsorted(common, grams)
    at[at == len(common)] = 0
    return grams[np.argsort(np.where(common[at] == grams, count[at], 0), kind="stable")[:k]]


def sketch(grams: np.ndarray, band: int, t: float, common: np.ndarray | None = None, count: np.ndarray | None = None) -> tuple[np.ndarray, bytes]:
    """The keys of a sorted set, and its parity sketch as bytes: at least four bits for each n-gram of a full band."""
    bits = 1 << max(6, math.ceil(math.log2(4 * band_top(band, t))))
    spot = (mix64(grams ^ np.uint64(0x9E3779B97F4A7C15)) & np.uint64(bits - 1)).astype(np.int64)
    return prefix(grams, t, common, count).view(np.int64), np.packbits(np.bincount(spot, minlength=bits).astype(np.uint8) & 1).tobytes()


def node_of(grams: np.ndarray) -> int:
    """64 bits that stand for a set of n-grams, as these stand for their words."""
    x = mix64(np.bitwise_xor.reduce(mix64(grams + np.uint64(1)), keepdims=True) + np.add.reduce(mix64(grams ^ np.uint64(0x5BF03635)), keepdims=True))
    return int(x.view(np.int64)[0])


def _to_slots(batches: Iterator[tuple[np.ndarray, np.ndarray]], slots: int) -> Iterator[pa.RecordBatch]:
    """(slot, blob) rows of 64-bit hashes and of the records that go with them, by the upper half of the hashes."""

    def blobs(h: np.ndarray, rec: np.ndarray) -> pa.RecordBatch:
        slot = ((h >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        o = np.argsort(slot, kind="stable")
        slot, rec = slot[o], rec[o]
        start = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        cut = np.append(start, len(slot))
        return pa.RecordBatch.from_arrays([pa.array(slot[start], pa.int32()), pa.array([rec[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())], names=["slot", "blob"])

    hs, recs, held = [], [], 0
    for h, rec in batches:
        hs.append(h), recs.append(rec)
        held += len(h)
        if held >= slots * BLOB or held >= 1 << 22:
            yield blobs(np.concatenate(hs), np.concatenate(recs))
            hs, recs, held = [], [], 0
    if held:
        yield blobs(np.concatenate(hs), np.concatenate(recs))


def _by_slot(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """All records of each slot of a task."""
    got: dict[int, list[bytes]] = {}
    for b in batches:
        for slot, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got.setdefault(slot, []).append(blob)
    for slot in list(got):
        yield np.frombuffer(b"".join(got.pop(slot)), np.uint64).reshape(-1, width)


def common_grams(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that most documents of a sample have, more than one at least (sorted), and by how many, up to 255."""
    parts = shuffle_parts(docs.sparkSession)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = (shingle_set(normal_bytes(x), n) for b in batches for x in b.column(0).to_pylist())
        return _to_slots(((g, g) for g in sets if len(g)), parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rec in _by_slot(batches, 1):
            g, k = np.unique(rec[:, 0], return_counts=True)
            g, k = g[k > 1], k[k > 1]
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.minimum(k, 255), pa.int32())], names=["g", "k"])

    part = docs.select("text").sample(False, SAMPLE, 7).mapInArrow(grams, "slot int, blob binary")
    counts = written(part.repartition(parts, "slot").mapInArrow(count, "g long, k int"), "common")
    least, held = 256, 0
    for k, rows in sorted(map(tuple, counts.groupBy("k").count().collect()), reverse=True):
        held += rows
        if held > COMMON:
            break
        least = k
    got = counts.filter(F.col("k") >= least).toArrow()
    drop(counts)
    g, k = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy().astype(np.uint8)
    o = np.argsort(g)
    return g[o], k[o]


def marks(docs: DataFrame, n: int, t: float, keys: bool = True) -> DataFrame:
    """A row for each document that has an id: the node of its set, its keys and its sketch; n is 0 and the rest null where
    there is no n-gram."""
    known = docs.sparkSession.sparkContext.broadcast(common_grams(docs, n)) if keys else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, count = known.value if known else (None, None)
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None:
                    continue
                g = shingle_set(normal_bytes(text), n)
                if not len(g):
                    rows.append((i, 0, None, None, None))
                elif not keys:
                    rows.append((i, len(g), node_of(g), None, None))
                else:
                    k, bits = sketch(g, size_band(len(g), t), t, common, count)
                    rows.append((i, len(g), node_of(g), k.tobytes(), bits))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in MARKS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, MARKS)


def _room(code: np.ndarray, other: np.ndarray, place: np.ndarray, t: float) -> np.ndarray:
    """Whether the overlap that t asks for, but SPARE, fits behind a set's place, with sizes and places rounded in favour
    of it."""
    ratio, spare = np.exp((other - code - 1) / STEPS), SPARE * np.exp((1 - code) / STEPS)
    return place / 255 * (1 - t) <= 1 - t / (1 + t) * (1 + ratio) + spare + 1e-6


def runs(m: DataFrame, t: float) -> DataFrame:
    """(run, a, b): pairs (run null) of contents that have enough keys of runs of up to RUN contents in common to reach t,
    and some of longer runs; of these also the contents a (b null), under a name that another key's run of the same
    contents has too."""
    few, spare, following, parts = RUN, SPARE, NEXT, shuffle_parts(m.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for b in batches:
                for node, n, keys in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    h = mix64(np.frombuffer(keys, np.uint64))
                    code = min(65535, round(math.log(n) * STEPS))
                    place = (np.arange(len(h)) / (n * (1 - t) + 1e-9) * 255).astype(np.uint64) if len(h) > 1 else np.zeros(1, np.uint64)
                    rec = np.empty((len(h), 2), np.uint64)
                    rec[:, 0] = h << np.uint64(24) | np.uint64(code << 8) | np.minimum(place, np.uint64(255))
                    rec[:, 1] = np.int64(node).view(np.uint64)
                    yield h, rec

        return _to_slots(records(), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for rec in _by_slot(batches, 2):
            rec = rec[np.argsort(rec[:, 0] >> np.uint64(24), kind="stable")]
            key = rec[:, 0] >> np.uint64(24)
            same = key[1:] == key[:-1]
            some = np.concatenate((same, [False])) | np.concatenate(([False], same))
            rec = rec[some]
            if not len(rec):
                continue
            node = rec[:, 1].view(np.int64)
            rec = rec[np.lexsort((node, rec[:, 0] >> np.uint64(24)))]
            key, node = rec[:, 0] >> np.uint64(24), rec[:, 1].view(np.int64)
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
            rec, key, node = rec[new], key[new], node[new]
            code, place = (rec[:, 0] >> np.uint64(8) & np.uint64(65535)).astype(np.int32), (rec[:, 0] & np.uint64(255)).astype(np.int32)
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(start, len(key)))
            of, at = np.repeat(size, size), np.arange(len(key)) - np.repeat(start, size)
            ids, nth = np.unique(node, return_inverse=True)
            asked = t / (1 + t) * np.rint(np.exp(code / STEPS))
            once, sure, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.arange(len(key))
            for back in range(1, max(few, following + 1)):
                j = j[(at[j] >= back) & ((of[j] <= few) | (back <= following))]
                if not len(j):
                    break
                i = j - back
                ok = np.abs(code[i] - code[j]) <= -math.log(t) * STEPS + 1
                x, y = i[ok], j[ok]
                ok = _room(code[x], code[y], place[x], t) & _room(code[y], code[x], place[y], t)
                x, y = x[ok], y[ok]
                few_asked = (of[x] > few) | (asked[x] + asked[y] <= spare + 1e-3)  # one key is enough
                pair = nth[x] * len(ids) + nth[y]
                once.append(pair[~few_asked]), sure.append(pair[few_asked])
            pair, keys = np.unique(np.concatenate(once), return_counts=True)
            more = np.unique(np.concatenate(sure))
            pair, keys = np.concatenate([pair, more]), np.concatenate([keys, np.full(len(more), 1 + spare)])
            for i in range(0, len(pair), 100_000):
                (a, b), k = np.divmod(pair[i : i + 100_000], len(ids)), keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(ids[a]), pa.array(ids[b]), pa.array(k)], names=["run", "a", "b", "keys"])
            for i, k in zip(start[size > few], size[size > few], strict=True):
                own = node[i : i + k]
                if (name := node_of(own.view(np.uint64))) not in done:
                    done.add(name)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, name)), pa.array(own), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=["run", "a", "b", "keys"])

    sent = m.select("node", "n", "keys").mapInArrow(send, "slot int, blob binary").repartition(parts, "slot")
    found = sent.mapInArrow(run, "run long, a long, b long, keys long").groupBy("run", "a", "b").agg(F.sum("keys").alias("keys"))
    return found.filter(F.col("run").isNotNull() | (F.col("keys") > SPARE)).drop("keys")


def _fold(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of sketches folded to so many 64-bit words."""
    while x.shape[1] > width:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def _may(h: np.ndarray, x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    """Whether sets of x and y n-grams may reach t if their sketches differ in h bits."""
    return (h <= (1 - t) / (1 + t) * (x + y) + 1e-9) & (np.minimum(x, y) >= t * np.maximum(x, y) - 1e-9)


def near_links(link: DataFrame, side: DataFrame, t: float) -> DataFrame:
    """The pairs whose sketches leave the threshold possible."""
    half = lambda x: side.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = link.join(half("a"), "a").join(half("b"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def flat(c: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64) // 8
        return np.frombuffer(c.buffers()[2], np.uint64, count=int(at[-1])), at[:-1], np.diff(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            (x, xa, xw), (y, ya, yw) = flat(b.column(4)), flat(b.column(5))
            ok = np.zeros(b.num_rows, bool)
            for u, v in np.unique(np.column_stack([xw, yw]), axis=0):
                i = np.flatnonzero((xw == u) & (yw == v))
                p, q = x[xa[i][:, None] + np.arange(u)], y[ya[i][:, None] + np.arange(v)]
                h = np.bitwise_count(_fold(p, min(u, v)) ^ _fold(q, min(u, v))).sum(axis=1, dtype=np.int64)
                ok[i] = _may(h, na[i], nb[i], t)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def near_in_runs(member: DataFrame, side: DataFrame, comp: DataFrame, t: float) -> DataFrame:
    """(a, b): of the pairs within a long run whose sketches leave the threshold possible, links that connect the same
    contents as all of them and those of comp do. Runs of which comp connects all contents are settled; others are held
    against themselves in pairs of blocks."""
    known = member.join(comp.select(F.col("doc_id").alias("a"), F.col("comp").alias("had")), "a", "left").withColumn("had", F.coalesce("had", "a"))
    open_ = known.groupBy("run").agg(F.ceil(F.count("*") / RUN_BLOCK).cast("int").alias("blocks"), F.min("had").alias("lo"), F.max("had").alias("hi")).filter("lo < hi")
    one = known.join(open_.select("run", "blocks"), "run").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    one = one.select("run", "block", "had", F.expr("explode(sequence(0, blocks - 1))").alias("o"), F.col("a").alias("node"))
    sent = one.join(side.select("node", "n", "sketch"), "node").withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.drop_duplicates("node")
        node, n = b.node.to_numpy(), b.n.to_numpy()
        width = np.array([len(x) // 8 for x in b.sketch])
        row, bits = np.zeros(len(b), np.int64), {}
        for w in np.unique(width):
            k = np.flatnonzero(width == w)
            row[k] = np.arange(len(k))
            bits[w] = np.stack([np.frombuffer(x, np.uint64) for x in b.sketch.iloc[k]])
        root = np.unique(b.had, return_inverse=True)[1]
        first = np.unique(root, return_index=True)[1]
        root = first[root]  # of each content, the place of one that it is connected with
        had = root.copy()
        p, q = np.flatnonzero(b.block == b.i), np.flatnonzero(b.block == b.j)
        most = np.bincount(root).argmax()

        def meet(p: np.ndarray, q: np.ndarray) -> None:
            for u in np.unique(width[p]):
                for v in np.unique(width[q]):
                    x, y, w = p[width[p] == u], q[width[q] == v], min(u, v)
                    right = np.ascontiguousarray(_fold(bits[v][row[y]], w).T)
                    step = max(1, (1 << 22) // len(y))
                    for k in range(0, len(x), step):
                        r = x[k : k + step]
                        left, h = _fold(bits[u][row[r]], w), np.zeros((len(r), len(y)), np.uint32)
                        for c in range(w):
                            h += np.bitwise_count(left[:, c][:, None] ^ right[c][None, :])
                        for z, ok in zip(r, _may(h, n[r][:, None], n[y][None, :], t), strict=True):
                            near = root[y[ok]]
                            near = near[near != root[z]]
                            if len(near):
                                old = np.unique(np.append(near, root[z]))
                                root[np.isin(root, old)] = old[0]

        meet(p[had[p] == most], q[had[q] != most])
        meet(p[had[p] != most], q)
        far = np.flatnonzero(root != had)
        u, v = node[far], node[root[far]]
        return pd.DataFrame({"a": np.minimum(u, v), "b": np.maximum(u, v)}).drop_duplicates()

    return sent.groupBy("run", "i", "j").applyInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, comp): each node and the least node it is connected with. Alternates linking larger neighbours and
    smaller ones to the least (Kiveris et al. 2014), with a written table after each round; no node's neighbours gather
    in one row."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        own = least.select("u", F.col("m").alias("v"))
        rest = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(own.unionByName(rest).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        drop(large)
        settled = new.exceptAll(e).isEmpty() and new.count() == e.count()
        drop(e)
        if settled:
            return new.select(F.col("u").alias("doc_id"), F.col("v").alias("comp")).unionByName(new.select(F.col("v").alias("doc_id"), F.col("v").alias("comp")).distinct())
        e = new


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], same: bool = False) -> np.ndarray:
    """Sizes of all intersections of the sets of a with those of b, from incidence matrices in pieces; if these are the same
    sets, of different ones only."""
    ga, gb = np.concatenate(a), np.concatenate(b)
    if same:
        flat, k = np.unique(ga, return_counts=True)
        flat = flat[k > 1]
    else:
        flat = np.intersect1d(ga, gb)  # an n-gram of one side only is in no intersection
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    ka, kb = np.isin(ga, flat), np.isin(gb, flat)
    ra, ca, rb, cb = ra[ka], np.searchsorted(flat, ga[ka]), rb[kb], np.searchsorted(flat, gb[kb])
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ra, ca, rb, cb = ra[oa], ca[oa], rb[ob], cb[ob]
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(flat), 4096):
        i, j = np.searchsorted(ca, [lo, lo + 4096]), np.searchsorted(cb, [lo, lo + 4096])
        if i[0] == i[1] or j[0] == j[1]:
            continue
        rows, cols = np.unique(ra[i[0] : i[1]]), np.unique(rb[j[0] : j[1]])
        x, y = np.zeros((len(rows), 4096), np.float32), np.zeros((len(cols), 4096), np.float32)
        x[np.searchsorted(rows, ra[i[0] : i[1]]), ca[i[0] : i[1]] - lo] = 1
        y[np.searchsorted(cols, rb[j[0] : j[1]]), cb[j[0] : j[1]] - lo] = 1
        out[np.ix_(rows, cols)] += x @ y.T
    return out


def _verified(docs: DataFrame, n: int, t: float, emit: Callable, kind: str) -> tuple[DataFrame, DataFrame]:
    """The marks, and what emit makes of each block of pairs: of the rows' nodes, copies and set sizes, the places of the
    block's rows and columns, the sizes of intersections and unions, and which pairs reach t."""
    m = written(marks(docs, n, t), "marks")
    some = m.filter("n > 0")
    found = written(runs(some, t), "runs")
    ends = written(found.select("a").union(found.filter("b is not null").select("b")).distinct().toDF("node"), "ends")
    side = written(some.select("node", "n", "sketch").join(small(ends), "node", "left_semi").dropDuplicates(["node"]), "side")
    near = written(near_links(found.filter("run is null").select("a", "b"), side, t), "near")
    comp = written(components(near), "components")
    long = found.filter("run is not null").select("run", "a")
    if not long.isEmpty():
        more = written(near_in_runs(long, side, comp, t), "near")
        if not more.isEmpty():
            comp = written(components(near.unionByName(more)), "components")
        drop(more)
    for x in (near, found, ends, side):
        drop(x)
    size = comp.groupBy("comp").agg(F.count("*").alias("members"))
    place = comp.join(size, "comp").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    place = place.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumnRenamed("doc_id", "node")
    same = some.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    place = written(place.join(same, "node").select("node", "doc_id", "copies", "comp", "blocks", "block"), "places")
    # texts move only of contents in components, once for each pair of blocks that needs them; beyond small()'s bound all
    # texts are shuffled once to find these
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(place), "doc_id")
    other = F.expr("explode(sequence(0, blocks - 1))")
    sent = text.select("doc_id", "node", "copies", "comp", "block", other.alias("o"), "text").select("doc_id", "node", "copies", "comp", "text", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        i, j = b.i.iloc[0], b.j.iloc[0]
        b = b.sort_values(["doc_id", "node"])
        if b.duplicated("node").any() or b.duplicated("doc_id").any():  # rows that repeat an id: of each node one that has its set
            own = [len(s := shingle_set(normal_bytes(x), n)) > 0 and node_of(s) == k for x, k in zip(b.text, b.node, strict=True)]
            b = b[own].drop_duplicates("node")
        sets = [shingle_set(normal_bytes(x), n) for x in b.text]
        blk, size = b.block.to_numpy(), np.array([len(s) for s in sets])
        p, q = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        inter = _overlaps([sets[k] for k in p], [sets[k] for k in q], i == j).astype(np.int64) if len(p) and len(q) else np.zeros((len(p), len(q)), np.int64)
        union = size[p][:, None] + size[q][None, :] - inter
        hit = inter >= t * union - 1e-9
        if i == j:
            hit &= p[:, None] < q[None, :]
        return emit(b.node.to_numpy(), b.copies.to_numpy(), p, q, inter, union, hit)

    return m, sent.groupBy("comp", "i", "j").applyInPandas(run, kind)


def _listed(node: np.ndarray, copies: np.ndarray, p: np.ndarray, q: np.ndarray, inter: np.ndarray, union: np.ndarray, hit: np.ndarray) -> pd.DataFrame:
    x, y = np.nonzero(hit)
    u, v = np.minimum(p[x], q[y]), np.maximum(p[x], q[y])  # rows are in order of (doc_id, node)
    return pd.DataFrame({"a": node[u], "b": node[v], "inter": inter[x, y], "uni": union[x, y]})


def _counted(node: np.ndarray, copies: np.ndarray, p: np.ndarray, q: np.ndarray, inter: np.ndarray, union: np.ndarray, hit: np.ndarray) -> pd.DataFrame:
    """(a, b, links): of each node its documents' links in this block, and a node that it is connected with in it."""
    links, root = np.zeros(len(node), np.int64), np.arange(len(node))
    np.add.at(links, p, hit @ copies[q])
    np.add.at(links, q, copies[p] @ hit)
    for x, row in zip(p, hit, strict=True):
        near = q[row]
        near = near[root[near] != root[x]]
        if len(near):
            old = np.unique(np.append(root[near], root[x]))
            root[np.isin(root, old)] = old[0]
    some = np.flatnonzero(links)
    return pd.DataFrame({"a": node[some], "b": node[root[some]], "links": links[some]})


def pairs(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard): all pairs of class representatives whose contents differ and reach t."""
    m, found = _verified(docs, n, t, _listed, "a long, b long, inter long, uni long")
    rep = lambda x: m.filter("n > 0").groupBy(F.col("node").alias(x)).agg(F.min("doc_id").alias(f"doc_id_{x}"))
    return found.join(rep("a"), "a").join(rep("b"), "b").select("doc_id_a", "doc_id_b", F.round(F.col("inter") / F.col("uni"), 6).alias("jaccard"))


def membership(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """(doc_id, rep): the representative of each document's content."""
    m = written(marks(docs, n, t, keys=False).select("doc_id", "node", "n"), "marks").filter("n > 0")
    return m.join(m.groupBy("node").agg(F.min("doc_id").alias("rep")), "node").select("doc_id", "rep")


def _classes(docs: DataFrame, n: int, t: float) -> DataFrame:
    """(doc_id, node, class_id, links, linked) of each row with an id."""
    m, found = _verified(docs, n, t, _counted, "a long, b long, links long")
    found = written(found, "links")
    comp = written(components(found.select("a", "b")), "groups").withColumnRenamed("doc_id", "node")
    same = m.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("near"))
    info = written(same.join(comp, "node", "left").join(links, "node", "left").filter("comp is not null or copies > 1"), "contents")
    least = info.filter("comp is not null").groupBy("comp").agg(F.min("rep").alias("least"))
    info = info.join(least, "comp", "left").select("node", F.coalesce("least", "rep").alias("c"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("l"))
    # a content of very many copies is one row of info: the side of the documents may be split
    return m.select("doc_id", "node").join(info, "node", "left").select("doc_id", "node", F.coalesce("c", "doc_id").alias("class_id"), F.coalesce("l", F.lit(0)).cast("long").alias("links"))


def classes(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links) of each document: the least doc_id it is connected with, and how many others reach t."""
    return _classes(docs, n, t).select("doc_id", "class_id", "links")


def keep_one(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """The documents without all but one of each group of copies: the least doc_id stays. Of rows that repeat an id those
    go whose own text has a copy of a lesser id."""
    gone = _classes(docs, n, t).filter("doc_id <> class_id").groupBy(F.col("doc_id").alias("i")).agg(F.collect_set("node").alias("nodes"))
    gone = written(gone.join(docs.groupBy(F.col("doc_id").alias("i")).agg(F.count("*").alias("rows")), "i"), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("i"))

    @F.pandas_udf("long")
    def node(texts: pd.Series) -> pd.Series:
        return pd.Series([node_of(s) if len(s := shingle_set(normal_bytes(x), n)) else None for x in texts], dtype="Int64")

    left = rows.join(small(gone.select("i")), "i", "left_anti").select("row.*")
    repeated = gone.filter("rows > 1")
    if repeated.isEmpty():
        return left
    again = rows.join(repeated, "i").withColumn("own", node("row.text"))
    return left.unionByName(again.filter("own is null or not array_contains(nodes, own)").select("row.*"))


def brute_force(ids: list[int], texts: list[str | None], n: int = N, t: float = THRESHOLD) -> set[tuple[int, int]]:
    """Pairs of ids whose sets reach t, by comparing all; for tests."""
    sets = [(i, set(shingle_set(normal_bytes(x), n).tolist())) for i, x in zip(ids, texts, strict=True)]
    return {(min(i, j), max(i, j)) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and b and len(a & b) >= t * len(a | b) - 1e-9}


__all__ = ["brute_force", "classes", "keep_one", "membership", "pairs", "sketch", "word_hashes"]
