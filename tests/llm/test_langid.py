import duckdb
import numpy as np
import pandas as pd
from edges import EN, FR, clashing, edges, empty, table

from glyphweave.llm import langid


def sample():
    rng = np.random.default_rng(0)
    e, f = EN.split(), FR.split()
    texts = [" ".join(rng.permutation(e)) for _ in range(20)] + [" ".join(rng.permutation(f)) for _ in range(20)]
    return texts, ["en"] * 20 + ["fr"] * 20


def test_nearest_centroid_and_rejection():
    m = langid.fit_rows(*sample(), clusters=2)
    who, dist = m.nearest([EN, FR, "zzzz qqqq xxxx kkkk", None, "", "123 !!"])
    assert [m.langs[k] if k >= 0 else None for k in who][:2] == ["en", "fr"]
    assert list(who[3:]) == [-1, -1, -1] and list(dist[3:]) == [1, 1, 1]
    assert dist[2] > m.radius[who[2]]


def test_agrees_with_brute_force():
    texts, langs = sample()
    m = langid.fit_rows(texts, langs, clusters=3)
    v = m.vectors(texts)
    sims = np.array([[float(np.dot(a, c)) for c in m.centroids] for a in v])
    who, dist = m.nearest(texts)
    assert np.allclose(dist, 1 - sims.max(axis=1), atol=1e-5)
    assert [m.langs[k] for k in who] == langs


def test_held_out_accuracy():
    d = duckdb.sql("select text, lang from '/root/testdata/sf0.001/documents.parquet' order by doc_id").df()
    m = langid.fit_rows(d.text[:100].tolist(), d.lang[:100].tolist())
    who, dist = m.nearest(d.text[100:].tolist())
    got = pd.Series([m.langs[k] for k in who])
    assert (got.values == d.lang[100:].values).mean() > 0.95
    assert np.mean([x > m.radius[k] for k, x in zip(who, dist)]) < 0.02


def test_edges(spark):
    d = edges(spark)
    m = langid.fit_rows(*sample(), clusters=2)
    got = langid.identify(clashing(d), m).collect()
    assert len(got) == 11
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].lang_rejected and by[3][0].lang_rejected and by[9][0].lang_id is None and by[8][0].lang_distance == 1
    assert len(by[7]) == 2 and by[None][0].lang_id == "fr" and by[1][0].lang_id == "en"
    assert langid.keep_known(d, m).columns == d.columns
    ids = [r.doc_id for r in langid.keep_known(d, m).collect()]
    assert {1, 6, 7, None} <= set(ids) and not {2, 3, 8, 9} & set(ids) and ids.count(7) == 2
    fitted = langid.fit(clashing(d), per_lang=2, clusters=2)
    assert set(fitted.langs) == {"en"} and langid.keep_known(clashing(d), fitted).columns == clashing(d).columns
    assert langid.identify(empty(spark), m).count() == 0
    none = langid.fit(empty(spark))
    assert langid.identify(table(spark, [(1, EN, "en", "a", 1)]), none).first().lang_rejected


def test_noise_scripts_and_unseen_languages_are_rejected_at_any_length():
    d = duckdb.sql("select text, lang from '/root/testdata/sf0.01/documents.parquet' where text is not null order by hash(doc_id)").df()
    m = langid.fit_rows(d.text[:700].tolist(), d.lang[:700].tolist())
    rng = np.random.default_rng(0)
    finnish = "Suomen kieli kuuluu uralilaisten kielten itämerensuomalaiseen ryhmään ja sitä puhutaan pääasiassa Suomessa Ruotsissa Norjassa sekä Virossa ja Venäjällä monin paikoin "
    for n in (200, 1000, 5000, 20000):
        texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), n)), (finnish * 200)[:n]]
        texts += ["".join(map(chr, rng.integers(*span, n))) for span in ((0x430, 0x450), (0x3B1, 0x3CA), (0x4E00, 0x9FA5), (0x621, 0x64B))]
        assert m.judge(texts)[2].all(), n
    for n in (20, 40, 80, 160, 1000):
        clean = [t[:n] for t in d.text[700:] if len(t) >= n]
        assert m.judge(clean)[2].mean() < 0.03, n
