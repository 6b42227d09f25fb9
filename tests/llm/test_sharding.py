import numpy as np
from edges import clashing, edge_rows, edges, empty, table

from glyphweave.llm import sharding


def brute(keys, weights, shards):
    o = np.argsort(keys, kind="stable")
    k, w = np.array(keys)[o], np.array(weights)[o]
    total, out = w.sum(), {}
    for x in np.unique(k):
        upto = w[k <= x].sum()
        out[int(x)] = sum(upto > total * j // shards for j in range(1, shards))
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    keys = rng.integers(-(10**12), 10**12, 300).tolist()
    keys += keys[:40]  # repeated keys
    rows = [(k, "x" * int(n), "en", "s", 1) for k, n in zip(keys, rng.integers(0, 200, len(keys)))]
    got = sharding.shard(table(spark, rows), shards=9)
    want = brute(keys, [len(r[1]) for r in rows], 9)
    rows_got = got.collect()
    assert len(rows_got) == len(rows) and all(want[r.doc_id] == r.shard for r in rows_got)
    parts = got.rdd.glom().collect()
    for i, p in enumerate(parts):
        assert all(r.shard == i for r in p) and [r.doc_id for r in p] == sorted(r.doc_id for r in p)


def test_tolerance(spark):
    rows = [(i, "x" * 10, "en", "s", 1) for i in range(1000)]
    d = table(spark, rows)
    sizes = [r["count"] for r in sharding.shard(d, shards=7, tolerance=0.1).groupBy("shard").count().collect()]
    assert len(sizes) == 7 and max(sizes) <= 1000 / 7 * 1.21 and min(sizes) >= 1000 / 7 * 0.79


def test_hot_key_and_nulls(spark):
    rows = [(5, "x" * 1000, "en", "s", 1), (6, "y", "en", "s", 1), (7, "z", "en", "s", 1), (None, "n", "en", "s", 1)]
    got = {r.doc_id: r.shard for r in sharding.shard(table(spark, rows), shards=3).collect()}
    assert got[None] == 0 and got[5] == got[6] == got[7] == 2


def test_edges(spark):
    d = clashing(edges(spark))
    got = sharding.shard(d, shards=4).collect()
    assert len(got) == len(edge_rows()) and {r.shard for r in got if r.doc_id == 7} == {3}
    assert sharding.shard(d).collect()[0].shard == 0
    assert sharding.shard(empty(spark), shards=3).count() == 0 and sharding.shard(empty(spark)).count() == 0


def test_many_splitters(spark):
    cuts = list(range(0, 60000, 100))
    d = spark.range(-50, 60100, 37).withColumn("s", sharding.shard_of(spark, sharding.F.col("id"), cuts))
    assert all(r.s == sum(c <= r.id for c in cuts) for r in d.collect())


def test_a_hundred_thousand_splitters_with_few_probes(monkeypatch):
    monkeypatch.setattr(sharding, "ALL_PROBES", 1 << 15)
    rng = np.random.default_rng(0)
    keys = np.unique(np.concatenate([rng.integers(-(2**63), 2**63 - 1, 400_000), [-(2**63), 2**63 - 1]]))
    upto = np.cumsum(rng.integers(1, 50, len(keys)))
    goal = upto[-1] * np.arange(1, 100_001) // 100_001
    calls = []

    def below(probes):
        calls.append(len(probes))
        return np.concatenate(([0], upto))[np.searchsorted(keys, probes, side="left")]

    got = sharding.refine(int(keys[0]), int(keys[-1]), goal, 0.0, below)
    assert (got == keys[np.searchsorted(upto, goal, side="right")]).all()
    assert max(calls) <= 100_000 and len(calls) < 80


def test_texts_without_bytes(spark):
    assert {r.shard for r in sharding.shard(table(spark, [(i, "", "en", "s", 0) for i in range(5)]), shards=3).collect()} == {0}
