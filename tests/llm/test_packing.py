import numpy as np
import pytest
from edges import clashing, edge_rows, edges, empty, table

from glyphweave.llm import packing


def brute(tokens, capacity, max_docs, attention, rule, w):
    """Plain loops over all bins ever opened."""
    bins, out = [], []
    for t in tokens:
        d = np.array([t / capacity, 1 / max_docs, t * t / attention])
        best, where = None, None
        for i, r in enumerate(bins):
            if (r - d >= -1e-12).all():
                s = (((r - d) ** 2) * w).sum() if rule == "norm" else -(r * d * w).sum()
                if best is None or s < best - 1e-15:
                    best, where = s, i
        if where is None:
            bins.append(np.ones(3))
            where = len(bins) - 1
        bins[where] = bins[where] - d
        out.append(where)
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_against_brute_force(rule):
    rng = np.random.default_rng(2)
    t = np.sort(rng.integers(1, 83, 300))[::-1]
    got = packing.best_fit(t, 100, 7, 7000.0, rule)
    assert got.tolist() == brute(t.tolist(), 100, 7, 7000.0, rule, np.array(packing.WEIGHTS))
    for b in set(got.tolist()):
        own = t[got == b]
        assert own.sum() <= 100 and len(own) <= 7 and (own**2).sum() <= 7000


def test_whole_texts_and_constraints(spark):
    d = clashing(edges(spark))
    got = packing.pack(d, capacity=100, max_docs=4, group_items=1000).collect()
    assert len(got) > 300
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for rows in bins.values():
        assert sum(r.tokens for r in rows) <= 100 and len(rows) <= 4 and sum(r.tokens**2 for r in rows) <= 7500
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    total = sum(r.tokens for r in got)
    assert total == sum(len((r[1] or "").replace(" ", "x").split()) for r in edge_rows())
    long = sorted((r.piece, r.first_token, r.tokens) for r in got if r.doc_id == 5)
    assert [x[1] for x in long] == np.cumsum([0] + [x[2] for x in long[:-1]]).tolist()
    assert {r.doc_id for r in got} == {1, None, 5, 6, 7, 9, 10} and sum(r.doc_id == 7 for r in got) == 2


def test_groups_and_token_column(spark):
    d = spark.range(500).selectExpr("id as doc_id", "cast(null as string) text", "cast(id % 50 as int) n")
    got = packing.pack(d, capacity=64, group_items=100, tokens_col="n")
    assert got.select("doc_id").distinct().count() == 490
    assert got.selectExpr("split(bin_id, '-')[0] g").distinct().count() == 5


def test_empty(spark):
    assert packing.pack(empty(spark)).count() == 0
    assert packing.pack(table(spark, [(1, None, None, None, None), (2, "", None, None, None)])).count() == 0
    with pytest.raises(ValueError):
        packing.best_fit(np.array([11]), 10, 1, 1000.0)
