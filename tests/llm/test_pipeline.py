import numpy as np
import pytest
from test_linededup import brute as dedup_brute
from test_mixing import brute as mix_brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from glyphweave.llm import langid, ngram_join, packing  # noqa: E402


def brute(spark, docs):
    """All stages with plain loops over collected rows."""
    m = langid.fit(docs)
    rows = [tuple(r) for r in docs.collect()]
    who, dist = m.nearest([r[1] for r in rows])
    rows = [r for r, k, x in zip(rows, who, dist) if k >= 0 and x <= m.radius[k]]
    texts = dict(dedup_brute(rows))
    rows = [(r[0], texts[r[0]], *r[2:4], len(texts[r[0]])) for r in rows if texts[r[0]]]
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in sorted(ngram_join.brute_force([r[0] for r in rows], [r[1] for r in rows])):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    rows = [r for r in rows if find(r[0]) == r[0]]
    copies = mix_brute(rows)
    items = sorted(((len(t.split()), i) for (i, t), k in copies.items() for _ in range(k)), key=lambda x: (-x[0], x[1]))
    return rows, copies, items


def test_run_against_brute_force(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    _, copies, items = brute(spark, d)
    longest = int(np.sqrt(0.75 * packing.CAPACITY**2))
    pieces = sorted((i, p, min(longest, n - p * longest)) for n, i in items for p in range(-(-n // longest)))
    assert sorted((r.doc_id, r.piece, r.tokens) for r in got) == pieces
    order = sorted(pieces, key=lambda x: (-x[2], x[0], x[1]))
    bins = packing.best_fit(np.array([x[2] for x in order]), packing.CAPACITY, packing.MAX_DOCS, 0.75 * packing.CAPACITY**2)
    assert sorted(f"0-{b}" for b in bins) == sorted(r.bin_id for r in got)


def test_stages_keep_columns_and_edges(spark):
    from edges import edges, empty

    for d in (edges(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, "")
            assert out.columns == d.columns and [t for _, t in out.dtypes] == [t for _, t in d.dtypes], name
            d = spark.createDataFrame(out.collect(), d.schema)
        corpus_pipeline.STAGES[-1][1](spark, d, "").collect()
