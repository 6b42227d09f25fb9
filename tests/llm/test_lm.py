import tracemalloc

import numpy as np
import pyarrow as pa
from edges import clashing, edge_rows, edges, empty, table

from glyphweave.llm import lm


def model():
    return lm.LogBilinear.start(np.full(lm.V, 1 / lm.V), 3)


def brute(m, text):
    ids, want = list((text or "").encode()), 0.0
    for i, w in enumerate(ids):
        ctx = [ids[j] if j >= 0 else lm.START for j in range(i - lm.CONTEXT, i)]
        r = sum(m.p["E"][c].astype(float) @ m.p["C"][j] for j, c in enumerate(ctx))
        s = m.p["Q"] @ r + m.p["b"]
        want += s[w] - np.log(np.exp(s).sum())
    return len(ids), want


def test_scores_against_brute_force(monkeypatch):
    m = model()
    texts = ["abc fed", None, "", "zzz", "a", "中文 ñ", "a text that is longer than a block of bytes, and so is cut"]
    for block in (lm.BLOCK, 16, 5):
        monkeypatch.setattr(lm, "BLOCK", block)
        n, lp = m.score(pa.array(texts))
        for t, k, x in zip(texts, n, lp, strict=True):
            size, want = brute(m, t)
            assert k == size and abs(want - x) < 1e-3


def test_scripts_are_told_apart():
    _, lp = model().score(pa.array(["中文", "文中", "да"]))
    assert len(set(np.round(lp, 6))) == 3


def test_probabilities_are_normalised():
    assert np.allclose(np.exp(model().log_probs(np.arange(500))).sum(axis=1), 1, atol=1e-4)


def test_gram_counts_are_exact(spark, monkeypatch):
    texts = ["abab", "abab", "ba", None, "", "a longer text, in pieces"]
    want = {}
    for t in texts:
        ids = [lm.START] * lm.CONTEXT + list((t or "").encode())
        for i in range(lm.CONTEXT, len(ids)):
            code = 0
            for x in ids[i - lm.CONTEXT : i + 1]:
                code = code * lm.V + x
            want[code] = want.get(code, 0) + 1
    d = table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    assert {r.code: r.n for r in lm.gram_counts(d).collect()} == want
    monkeypatch.setattr(lm, "BLOCK", 7)
    got = {}
    for pieces in lm.blocks(pa.array(texts)):
        for c in lm.codes(pieces)[0].tolist():
            got[c] = got.get(c, 0) + 1
    assert got == want


def test_memory_of_many_long_texts():
    m, one = model(), "0123456789 some words of a long text " * 3300
    texts = pa.array([one] * 300)
    tracemalloc.start()
    n, _ = m.score(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(one) > 120_000 and set(n.tolist()) == {len(one)} and peak < 300e6


def test_beats_unigrams_on_held_out_text(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train, test = d.filter("doc_id % 5 <> 0"), d.filter("doc_id % 5 = 0")
    m = lm.fit(train)
    s = lm.score(test, m).agg({"log_prob": "sum", "n_tokens": "sum"}).first()
    per = s["sum(log_prob)"] / s["sum(n_tokens)"]
    p = np.bincount(np.frombuffer("".join(r.text for r in test.collect()).encode(), np.uint8), minlength=lm.V)
    p = p / p.sum()
    unigram = float((p[p > 0] * np.log(p[p > 0])).sum())
    assert per > unigram + 0.6


def test_partitions_are_averaged(spark, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(lm, "PART_TOKENS", 1 << 16)
    monkeypatch.setattr(lm, "LEAST_STEPS", 40)
    start, m = model(), lm.fit(d, rounds=2)
    a, b = (lm.score(d, x).agg({"log_prob": "sum"}).first()[0] for x in (start, m))
    assert b > 0.7 * a


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_STEPS", 20)
    d = clashing(edges(spark))
    m = lm.fit(d, rounds=1)
    got = lm.score(d, m).collect()
    assert len(got) == len(edge_rows())
    by = {r.doc_id: r for r in got}
    assert by[2].n_tokens == 0 and by[2].perplexity is None and by[3].log_prob == 0 and by[5].n_tokens > 200_000
    assert by[1].log_prob == by[7].log_prob
    e = lm.fit(empty(spark))
    assert lm.score(empty(spark), e).count() == 0
