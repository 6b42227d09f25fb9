"""Language identification by nearest centroid.

A text becomes an L2-normalised TF-IDF vector of hashed byte n-grams; every language owns several centroids
(spherical k-means of a labelled sample); the nearest centroid by cosine names the language, unless it is farther
than the language's rejection distance at the text's length (in distinct n-grams): any long text is nearer to any centroid than a short one.

Defined results: a null, empty or letterless text has no vector: lang null, distance 1, rejected. Whole texts are read.
Ties go to the centroid first in (language, cluster) order. An empty table gives an empty table, and fitting on no
labelled row gives a model that rejects everything. Extra columns pass through; output columns replace same-named ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMS = 4096
_LETTERS = np.arange(256).astype(np.uint8)
_LETTERS[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]
_LETTERS = _LETTERS.tobytes()
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))


def _grams(text: str | None) -> np.ndarray | None:
    """Hashed byte 2-, 3- and 4-grams of the lower-cased letters; None if there is no letter."""
    if not text:
        return None
    b = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    if not b:
        return None
    x = np.frombuffer(b" " + b + b" ", np.uint8).astype(np.uint32)
    out, h = [], (x + np.uint32(1)) * _MULT[0]
    for n in (2, 3, 4):
        if len(x) < n:
            break
        h = (h[: len(x) - n + 1] ^ (h[: len(x) - n + 1] >> np.uint32(15))) * _MULT[n - 1] + x[n - 1 :]
        out.append(((h * _MULT[0]) >> np.uint32(20)).astype(np.int64))
    return np.concatenate(out)


def counts_matrix(texts: list[str | None]) -> np.ndarray:
    """n-gram counts, a row for each text; a row of zeros where there is no letter."""
    m = np.zeros((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        if (g := _grams(t)) is not None:
            m[i] = np.bincount(g, minlength=DIMS)
    return m


@dataclass
class CentroidModel:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    radius: np.ndarray  # the largest rejection distance of each centroid's language
    limits: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by language: log2 of distinct n-grams, distance

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        return self._unit(counts_matrix(texts))

    def _unit(self, counts: np.ndarray) -> np.ndarray:
        m = np.sqrt(counts) * self.idf
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def nearest(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest centroid (-1: none) and the cosine distance."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """nearest(), and whether the text is rejected."""
        if not self.langs:
            return np.full(len(texts), -1), np.ones(len(texts)), np.ones(len(texts), bool)
        who, dist, size = np.empty(len(texts), np.int64), np.empty(len(texts)), np.empty(len(texts))
        for i in range(0, len(texts), 256):
            c = counts_matrix(texts[i : i + 256])
            v = self._unit(c)
            d = np.round((1 - v @ self.centroids.T).astype(np.float64), 6)
            k = d.argmin(axis=1)
            who[i : i + 256], dist[i : i + 256] = np.where(v.any(axis=1), k, -1), d[np.arange(len(d)), k]
            size[i : i + 256] = (c > 0).sum(axis=1)
        limit = np.array([-1.0 if k < 0 else np.interp(np.log2(max(1, n)), *self.limits[self.langs[k]]) for k, n in zip(who, size, strict=True)])
        dist = np.where(who < 0, 1.0, dist)
        return who, dist, dist > limit


def _kmeans(v: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means with farthest-point starts: deterministic for a seed."""
    rng = np.random.default_rng(seed)
    c = v[[rng.integers(len(v))]]
    while len(c) < min(k, len(v)):
        c = np.vstack([c, v[[(v @ c.T).max(axis=1).argmin()]]])
    for _ in range(20):
        who = (v @ c.T).argmax(axis=1)
        new = np.stack([v[who == j].mean(axis=0) if (who == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    return c


def _limits(model: CentroidModel, texts: list[str], v: np.ndarray, clusters: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(log2 of distinct n-grams, rejection distance) of a language. Each half's centroids are held against the beginnings, 5, 10,
    20... characters long, of the other half's texts and against the same with their characters shuffled. The limit lies
    midway between the 99 % quantile of the one and the median of the other; of fewer than 8 texts it is that median."""
    rng, at, limit, length = np.random.default_rng(seed), [], [], 5
    halves = [(v[0::2], texts[1::2]), (v[1::2], texts[0::2])] if len(texts) >= 8 else [(v, texts)]
    halves = [(_kmeans(x, clusters, seed), own) for x, own in halves]
    while True:
        size, true, noise = [], [], []
        for c, own in halves:
            part = [t[:length] for t in own if len(t) >= length or length == 5]
            n = counts_matrix(part)
            other = model.vectors(["".join(rng.permutation(list(t))) for t in part])
            ok = n.any(axis=1) & other.any(axis=1)
            if ok.any():
                size.append((n[ok] > 0).sum(axis=1)), true.append((1 - model._unit(n[ok]) @ c.T).min(axis=1)), noise.append((1 - other[ok] @ c.T).min(axis=1))
        if sum(map(len, size)) < (min(10, len(texts)) if at else 1):
            break
        far = float(np.median(np.concatenate(noise)))
        near = min(far, float(np.quantile(np.concatenate(true), 0.99))) if len(texts) >= 8 else far
        at.append(float(np.log2(np.median(np.concatenate(size))))), limit.append((near + far) / 2)
        length *= 2
    if not at:  # letters come late in all the texts
        return np.zeros(1), np.full(1, 0.985)
    return np.maximum.accumulate(np.array(at)), np.minimum(0.985, np.array(limit))


def fit_rows(texts: list[str], langs: list[str], clusters: int = 4, seed: int = 7) -> CentroidModel:
    """The model of labelled texts, with rejection distances from texts held out."""
    ok = [(t, la) for t, la in zip(texts, langs, strict=True) if la is not None and _grams(t) is not None]
    if not ok:
        return CentroidModel(np.ones(DIMS, np.float32), np.empty((0, DIMS), np.float32), [], np.empty(0))
    texts, labels = [t for t, _ in ok], np.array([la for _, la in ok])
    df = (counts_matrix(texts) > 0).sum(axis=0)
    model = CentroidModel((np.log((1 + len(texts)) / (1 + df)) + 1).astype(np.float32), np.empty((0, DIMS), np.float32), [], np.empty(0))
    v = model.vectors(texts)
    cents, names, limits = [], [], {}
    for la in sorted(set(labels)):
        mine = np.flatnonzero(labels == la)
        c = _kmeans(v[mine], clusters, seed)
        limits[str(la)] = _limits(model, [texts[i] for i in mine], v[mine], clusters, seed)
        cents.append(c)
        names += [str(la)] * len(c)
    return CentroidModel(model.idf, np.vstack(cents).astype(np.float32), names, np.array([limits[x][1].max() for x in names]), limits)


def labelled_sample(docs: DataFrame, per_lang: int, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """At most per_lang rows of each language, those of least hash: a count first, a hash threshold from it, then an
    exact cut of the few that pass; texts are read for those only."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    ids = rows.select("id", "lang").filter("lang is not null and id is not null").withColumn("h", F.xxhash64("id"))
    n = ids.groupBy("lang").agg(F.count("*").alias("n"))
    cut = F.lit(-(2.0**63)) + F.least(F.lit(1.0), F.lit(2.0 * per_lang + 100) / F.col("n")) * F.lit(2.0**64)
    few = ids.join(n, "lang").filter(F.col("h").cast("double") <= cut)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).filter(F.col("r") <= per_lang)
    return rows.join(F.broadcast(few.select("id").distinct()), "id", "left_semi")


def fit(docs: DataFrame, per_lang: int = 400, clusters: int = 4, seed: int = 7, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> CentroidModel:
    """Fits on a bounded sample of labelled rows: per_lang of each language (its broadcast grows with the number of
    languages only)."""
    rows = labelled_sample(docs, per_lang, text_col, lang_col, id_col).toPandas().sort_values(["lang", "id", "text"], kind="stable", na_position="first")
    return fit_rows(rows.text.tolist(), rows.lang.tolist(), clusters, seed=seed)


def identify(docs: DataFrame, model: CentroidModel, text_col: str = "text") -> DataFrame:
    """The rows with lang_id, lang_distance and lang_rejected; one narrow pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["lang_id", "lang_distance", "lang_rejected"]
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            who, dist, far = m.judge(b.column(text_col).to_pylist())
            new = [pa.array([None if k < 0 else m.langs[k] for k in who], pa.string()), pa.array(dist, pa.float64()), pa.array(far, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *names])

    new = [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *new]))


def keep_known(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """Rows whose language is recognised, with the columns they came with."""
    packed = docs.select(F.col("text").alias("text"), F.struct("*").alias("row"))
    return identify(packed, model).filter(~F.col("lang_rejected")).select("row.*")
