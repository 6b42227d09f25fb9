import numpy as np
import pytest
from edges import clashing, edge_rows, edges, empty, table
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphweave.llm import linededup as L


def brute(rows):
    """(id, text) after dedup, in order of (id, line)."""
    seen, first = set(), {}
    for i, t in sorted(((r[0], r[1]) for r in rows if r[1] is not None), key=lambda x: (x[0] is not None, x[0] or 0)):
        for n, line in enumerate(t.split("\n")):
            k = line.strip(L._TRIM)
            if k and k not in seen:
                seen.add(k)
                first[(i, n)] = k
    out = []
    for r in rows:
        i, t = r[0], r[1]
        if t is None:
            out.append((i, None))
            continue
        lines = t.split("\n")
        keep = [x for n, x in enumerate(lines) if not x.strip(L._TRIM) or (i, n) in first]
        some = any(x.strip(L._TRIM) for x in lines)
        out.append((i, "\n".join(keep) if any(x.strip(L._TRIM) for x in keep) or not some else ""))
    return sorted(out, key=repr)


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=3000))
def test_cuckoo_filter_has_no_false_negatives(keys):
    h = np.array(sorted(keys), np.uint64)
    c = L.CuckooFilter.load(L.CuckooFilter.of(h).dump())
    assert c.contains(h).all()
    c.remove(h[: len(h) // 2])
    assert c.contains(h[len(h) // 2 :]).all()


def test_cuckoo_filter_false_positives_and_removal():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 200_000, dtype=np.uint64)
    c = L.CuckooFilter.of(h[:100_000])
    assert c.contains(h[:100_000]).all() and c.contains(h[100_000:]).mean() < 0.001
    c.remove(h[:100_000])
    assert not c.table.any()


def test_dedup_against_brute_force_and_edges(spark):
    rows = edge_rows() + [(20, "one\ntwo\none\n\nthree ", "en", "a", 1), (21, "two\nthree\nfour", "en", "a", 1), (22, " two", "en", "a", 1)]
    d = clashing(table(spark, rows))
    got = L.dedup(d)[1]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == brute(rows)
    by = {r.doc_id: r for r in got.collect()}
    assert by[22].text == "" and by[22].lines_kept == 0 and by[22].lines_in == 1
    assert by[20].text == "one\ntwo\n\nthree " and by[21].text == "four"


def test_redelivery_against_brute_force(spark):
    """Every tenth document comes first, is taken out and comes again as the last."""
    rows = [(i, "\n".join(f"line {(i * k) % 29}" for k in range(1, 7)), "en", "s", 1) for i in range(1, 60)] + [(60, None, "en", "s", 1), (61, "", "en", "s", 0)]
    got = L.redelivered(table(spark, rows), L.F.col("doc_id") % 10 == 0)
    order = sorted(rows, key=lambda r: (r[0] % 10 == 0, r[0]))
    want = brute([(k, r[1]) for k, r in enumerate(order)])
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.text is not None) == sorted((order[k][0], t) for k, t in want if t is not None)
    assert got.count() == len(rows) and L.redelivered(empty(spark), L.F.lit(True)).count() == 0


def test_empty_table(spark):
    index, got = L.dedup(empty(spark))
    assert got.count() == 0
    index, kept = index.insert(table(spark, [(1, "a\nb\na", "en", "s", 1)]))
    assert sorted(map(tuple, kept.collect())) == [(1, 0), (1, 1)]


def test_insert_and_delete_are_reversible(spark):
    one = [(i, "\n".join(f"line {(i * k) % 17}" for k in range(1, 6)), "en", "s", 1) for i in range(1, 15)]
    two = [(i, "\n".join(f"line {(i * k) % 23}" for k in range(1, 6)), "en", "s", 1) for i in range(15, 30)]
    state, kept = L.new_index(table(spark, one + two)).insert(table(spark, one))
    state, more = state.insert(table(spark, two))
    places = set(map(tuple, kept.collect())) | set(map(tuple, more.collect()))
    whole = {tuple(r) for r in L.new_index(table(spark, one + two)).insert(table(spark, one + two))[1].collect()}
    assert places == whole
    gone = spark.createDataFrame([(i,) for i in range(1, 12)], "doc_id long")
    state, new = state.delete(gone)
    left = {p for p in places if p[0] > 11} | set(map(tuple, new.collect()))
    rest = [r for r in one + two if r[0] > 11]
    fresh, want = L.new_index(table(spark, rest)).insert(table(spark, rest))
    assert left == set(map(tuple, want.collect()))
    refs = lambda s: {(r.h1, r.h2, r.refs, r.first.doc_id, r.first.line_no) for r in spark.read.parquet(s.refs).collect()}
    assert refs(state) == refs(fresh)
    # the filters hold all lines that are left, and a deletion of everything empties them
    state, _ = state.delete(spark.createDataFrame([(i,) for i in range(1, 30)], "doc_id long"))
    assert spark.read.parquet(state.refs).count() == 0
    assert not any(L.CuckooFilter.load(r.blob).table.any() for r in spark.read.parquet(state.filters).collect())


@pytest.mark.parametrize("rows", [[(1, "", "en", "s", 0)], [(1, None, None, None, None)]])
def test_no_lines(spark, rows):
    assert [r.text for r in L.dedup(table(spark, rows))[1].collect()] == [rows[0][1]]


def test_edges_keep_columns(spark):
    d = edges(spark)
    assert L.dedup(d)[1].columns == [*d.columns, "lines_in", "lines_kept"]


def test_a_filter_refuses_what_can_not_fit():
    c = L.CuckooFilter.sized(1000)
    before = c.dump()
    assert not c.add(np.arange(100_000, dtype=np.uint64)) and c.dump() == before
    h = L.mix64(np.arange(3_000, dtype=np.uint64))
    assert L.CuckooFilter.of(h).contains(h).all()
