"""What keeps time and memory in proportion: grams by one pass, sizes without vectors, counts used again, bounded blocks."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphweave.config import TextConfig
from glyphweave.functions.normalize import PUNCTUATION, SPACE_CHARS
from glyphweave.functions.tokens import tokenized
from glyphweave.operators import linear
from glyphweave.operators import weighting as W
from glyphweave.plans.model import TextClassifier, TextModel

ODD = ["uno dos tres cuatro", "", "a", "ab", "x\u0001y zz\u0001", "\U0001f600a\U0001f601b c\U0001f602", "~~a~b", "a\nb\tc d\u0085e f", "eins\r\nzwei.drei-vier", "ñandú … ¿qué?", "ab $1 \\ cd"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def words(norm):
    return [w for w in re.split("[" + re.escape(PUNCTUATION + SPACE_CHARS) + "]", norm[1:-1]) if w]


def grams(x, q):
    return [x[i : i + q] for i in range(len(x) - q + 1)]


@pytest.mark.parametrize("raw", [False, True])
def test_grams_take_no_step_for_each_position(spark, raw):
    """Arrays of positions, an interpreted step for each, took three quarters of the time."""
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for q_grams_words in (False, True):
        cfg = TextConfig(token_list=(-1, -2, -3, -40, 1, 3, 5), q_grams_words=q_grams_words, disable_text_transformations=raw)
        got = tokenized(docs, cfg)
        assert "sequence(" not in plan(got)
        norm = dict(tokenized(docs, TextConfig(token_list=(1,), disable_text_transformations=raw)).select("doc_id", F.concat_ws("", F.transform("tokens", lambda t: F.substring(t, 3, 9)))).collect())
        for i, tokens in got.collect():
            n = ODD[i] if raw else norm[i]
            w = words(n)
            want = ["~".join(g) for k in (1, 2, 3, 40) for g in grams(w, k)]
            want += ["q:" + g for k in (1, 3, 5) for g in ([g for x in w for g in grams(f"~{x}~", k)] if q_grams_words else grams(n, k))]
            assert tokens == (want or ["~"]), (ODD[i], q_grams_words)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 9)), "ab"[i % 2], float(i)) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, klass string, value double").cache()


def test_sizes_make_no_vectors(docs):
    model, long = TextModel.fit_long(docs)
    sizes = W.as_vectors(long, docs).select("doc_id", "vecsize")
    assert "collect_list" not in plan(sizes)
    assert sorted(sizes.collect()) == sorted(W.as_vectors(long, docs).select("doc_id", F.size("vec")).collect())


def test_counts_and_vectors_are_used_again(docs):
    config = TextConfig()
    counts = TextModel.counts(docs, config)
    model = TextModel.fit(docs, config, counts=counts)
    vectors = model.transform(docs, counts=counts)
    assert "decompose" not in plan(vectors) and "decompose" in plan(model.transform(docs))
    assert sorted(vectors.collect()) == sorted(model.transform(docs).collect())
    assert "decompose" not in plan(model.long(docs, unit=True, counts=counts))
    c = TextClassifier.fit(docs, text_model=model, vectors=vectors)
    assert np.allclose(c.linear.weights, TextClassifier.fit(docs, config, counts=counts).linear.weights, atol=1e-3)
    some = docs.filter("doc_id > 7")
    got = c.predict(some, vectors=vectors)
    assert "decompose" not in plan(got) and {r.doc_id: r.predicted for r in got.collect()} == {r.doc_id: r.predicted for r in c.predict(some).collect()}


def test_blocks_are_bounded(docs, monkeypatch):
    monkeypatch.setattr(linear, "BLOCK_ENTRIES", 10)
    ids = pa.array([[1] * 4, None, [2] * 6, [], [3] * 25, [4]])
    assert list(linear.pieces(ids)) == [(0, 4), (4, 5), (5, 6)]
    assert list(linear.pieces(ids.slice(2, 3))) == [(0, 2), (2, 3)]
    x = linear.Rows.of(ids, pa.array([[1.0] * len(i or []) if i is not None else None for i in ids.to_pylist()]), np.arange(6.0), 5)
    w = np.arange(12.0).reshape(6, 2)
    b = linear.Block(x.dump())
    assert np.allclose(np.stack([b.times(w, k) for k in range(2)], 1), x.times(w))
    g = np.zeros_like(w)
    b.add_back(np.ones(6), 0, g)
    assert g[:, 0].tolist() == [0, 4, 6, 25, 1, 6] and not g[:, 1].any()
