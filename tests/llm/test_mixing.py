import hashlib
import math
from collections import Counter

from edges import clashing, edges, empty, table

from glyphweave.llm import mixing


def brute(rows, alpha=mixing.ALPHA, seed=mixing.SEED):
    words = lambda t: len(t.split()) if t and t.replace(" ", "x").strip() else 0
    tokens = Counter()
    for r in rows:
        tokens[r[3]] += len([w for w in (r[1] or "").replace(" ", "x").split()])
    w = {s: n**alpha for s, n in tokens.items()}
    least = min(w[s] / n for s, n in tokens.items() if n)
    out = Counter()
    for r in rows:
        n = tokens[r[3]]
        rate = round(w[r[3]] / n / least, 6) if n else 1.0
        u = int(hashlib.md5(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16) / 2**32
        k = math.floor(rate) + (u < rate - math.floor(rate))
        out[(r[0], r[1])] += k
    return out


def test_brute_force_and_edges(spark):
    from edges import edge_rows

    d = edges(spark)
    got = mixing.mix(d, mixing.source_rates(d))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter({k: v for k, v in brute(edge_rows()).items() if v})
    assert {r.copy for r in got.collect()} >= {0}
    # at the default budget nothing is lost
    assert got.select("doc_id").distinct().count() == d.select("doc_id").distinct().count()


def test_weights_and_budget(spark):
    rows = [(i, "a b c d", "en", "x" if i < 30 else "y", 7) for i in range(60)]
    d = table(spark, rows)
    r = {x.source: x.rate for x in mixing.source_rates(d, {"x": 3, "y": 1}, budget=480).collect()}
    assert r == {"x": 3.0, "y": 1.0}
    n = Counter(x.source for x in mixing.mix(d, mixing.source_rates(d, {"x": 2.5, "y": 0.5}, budget=360)).collect())
    assert n["x"] > 60 and n["y"] < 30
    assert {x.source: x.rate for x in mixing.source_rates(d, {"x": 1}).collect()}["y"] == 0


def test_clashes_and_empty(spark):
    d = clashing(edges(spark))
    got = mixing.mix(d, mixing.source_rates(d), copy_col=None)
    assert got.columns == d.columns
    e = empty(spark)
    assert mixing.mix(e, mixing.source_rates(e)).count() == 0


def test_a_source_without_tokens_keeps_its_documents(spark):
    rows = [(1, "a b", "en", "x", 3), (2, None, "en", "e", None), (3, "", "en", "e", 0), (4, " \n", "en", "e", 2)]
    d = table(spark, rows)
    assert sorted(r.doc_id for r in mixing.mix(d, mixing.source_rates(d)).collect()) == [1, 2, 3, 4]
    assert [r.doc_id for r in mixing.mix(d, mixing.source_rates(d, {"x": 1.0}, budget=2)).collect()] == [1]


def test_tokens_from_a_column(spark):
    d = table(spark, [(1, "a", "en", "x", 30), (2, "b", "en", "y", 10)])
    got = {r.source: (r.tokens, r.rate) for r in mixing.source_rates(d, {"x": 1.0, "y": 1.0}, budget=40, tokens_col="n_chars").collect()}
    assert got == {"x": (30, round(20 / 30, 6)), "y": (10, 2.0)}
