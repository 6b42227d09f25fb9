import numpy as np

from glyphweave.llm import topk


def brute(ids, x, k):
    out = {}
    s = np.round(x @ x.T, 6)
    for i, a in enumerate(ids):
        rest = sorted((-s[i, j], b) for j, b in enumerate(ids) if b != a)
        out[a] = [(b, -v) for v, b in rest[:k]]
    return out


def got(df, **kw):
    out = {}
    for r in topk.top_k(df, **({"every": 1} | kw)).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.neighbour_id, r.score))
    return {q: [(b, s) for _, b, s in sorted(v)] for q, v in out.items()}


def test_tree_against_brute_force():
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(60, 8)), 10, axis=0) + rng.normal(scale=0.05, size=(600, 8))
    ids = rng.permutation(10_000)[:600]
    t = topk.build(ids, x, leaf=16)
    s, w = topk.fresh(600, 5)
    done = topk.search(t, ids, x, s, w)
    want = brute(ids.tolist(), x, 5)
    assert done < 600 * 600 * 0.7  # the bounds cut most of it
    for i, a in enumerate(ids.tolist()):
        assert [b for b, _ in want[a]] == w[i].tolist()


def test_all_queries_over_shards(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)).round(2)
    x[50:90] = x[10]  # ties
    rows = [(int(i) * 3, [float(v) for v in x[i]], 0) for i in range(300)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    y = np.array([[np.float32(v) for v in r[1]] for r in rows]).astype(float)
    want = brute([r[0] for r in rows], y, 7)
    have = got(d, k=7, shard_rows=40)
    assert {q: [b for b, _ in v] for q, v in have.items()} == {q: [b for b, _ in v] for q, v in want.items()}


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [1.0]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0]), (7, [None, 1.0]), (8, [0.0, 0.0])]
    d = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], "vec_id long, embedding array<float>, id int, v int, shard int")
    assert got(d, k=5) == {1: [(2, 0.5), (8, 0.0)], 2: [(1, 0.5), (8, 0.0)], 8: [(1, 0.0), (2, 0.0)]}
    assert topk.top_k(d.limit(0)).count() == 0


def test_a_stated_query_set_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "SPAN", 2)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    d = spark.createDataFrame([(i, x[i].tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    want = brute(range(400), x, 4)
    have = got(d, k=4, every=20, shard_rows=30)
    assert {q: [b for b, _ in v] for q, v in have.items()} == {q: [b for b, _ in want[q]] for q in range(0, 400, 20)}
