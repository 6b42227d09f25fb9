import numpy as np
from edges import EN, clashing, edges, empty, table

from glyphweave.llm import ngram_join as J
from glyphweave.llm.common import mix64, normal_bytes, shingle_set


def corpus(seed=0, docs=120):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    while i < docs:
        base = rng.choice(vocab, rng.integers(5, 400)).tolist()
        for _ in range(rng.integers(1, 5)):
            t = list(base)
            for p in rng.integers(0, len(t), rng.integers(0, max(1, len(t) // 20) + 1)):
                t[p] = str(rng.choice(vocab))
            rows.append((i, " ".join(t), "en", "s", 1))
            i += 1
    return rows


def pairs(docs):
    """All pairs of documents, from the pairs of representatives and the membership."""
    of = {}
    for r in J.membership(docs).collect():
        of.setdefault(r.rep, []).append(r.doc_id)
    near = [(r.doc_id_a, r.doc_id_b) for r in J.pairs(docs).collect()] + [(r, r) for r in of]
    return {(min(a, b), max(a, b)) for x, y in near for a in of[x] for b in of[y] if a != b}


def expected_classes(ids, want):
    """(class_id, links) of each id from the pairs of a brute-force version."""
    root, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        links[a], links[b] = links[a] + 1, links[b] + 1
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in ids}


def test_recall_and_precision_against_brute_force(spark):
    rows = corpus()
    got, want = pairs(table(spark, rows)), J.brute_force([r[0] for r in rows], [r[1] for r in rows])
    assert len(want) > 60 and got <= want
    assert len(got & want) >= 0.97 * len(want)


def test_hamming_bounds_symmetric_difference():
    rng = np.random.default_rng(1)
    for n in (4, 30, 90, 700):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: n - n // 10], rng.integers(0, 2**63, n // 10, dtype=np.uint64)])
        band = J.size_band(n, J.THRESHOLD)
        (_, x), (_, y) = J.sketch(np.unique(a), band, J.THRESHOLD), J.sketch(np.unique(b), band, J.THRESHOLD)
        h = int(np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum())
        assert h <= len(np.setxor1d(a, b))


def test_classes_and_keep_one_against_brute_force(spark):
    rows = corpus(3)
    rows += [(1000 + k, rows[5][1].upper(), "en", "s", 1) for k in range(30)]  # a content of many copies
    d = table(spark, rows)
    want = expected_classes([r[0] for r in rows], J.brute_force([r[0] for r in rows], [r[1] for r in rows]))
    got = {r.doc_id: (r.class_id, r.links) for r in J.classes(d).collect()}
    assert got == want and want[1000][1] >= 30
    assert sorted(r.doc_id for r in J.keep_one(d).collect()) == sorted({c for c, _ in want.values()})


def test_blocks_find_the_same_pairs(spark, monkeypatch):
    rows = corpus(5, 60)
    whole = pairs(table(spark, rows))
    classes = sorted(map(tuple, J.classes(table(spark, rows)).collect()))
    monkeypatch.setattr(J, "BLOCK", 2)
    assert pairs(table(spark, rows)) == whole
    assert sorted(map(tuple, J.classes(table(spark, rows)).collect())) == classes


def test_edges(spark):
    d = clashing(edges(spark))
    got = sorted(map(tuple, J.classes(d).collect()))
    assert got == [(1, 1, 2), (2, 2, 0), (3, 3, 0), (5, 5, 0), (6, 6, 0), (7, 1, 2), (7, 1, 2), (8, 8, 0), (9, 9, 0), (10, 10, 0)]
    assert J.pairs(d).count() == 0 and sorted(map(tuple, J.membership(d).collect())) == [(1, 1), (5, 5), (6, 6), (7, 1), (7, 1), (10, 10)]
    kept = J.keep_one(d)
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 7 not in ids and 1 in ids and None in ids and len(ids) == 9
    assert J.classes(empty(spark)).count() == J.pairs(empty(spark)).count() == J.membership(empty(spark)).count() == 0 and J.keep_one(empty(spark)).count() == 0


def test_short_texts_are_one_gram(spark):
    rows = [(1, "Two words", "en", "s", 1), (2, "two, WORDS!", "en", "s", 1), (3, "two", "en", "s", 1), (4, EN, "en", "s", 1)]
    assert pairs(table(spark, rows)) == {(1, 2)}
    assert len(shingle_set(normal_bytes("two"), 3)) == 1


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.doc_id: r.comp for r in J.components(e).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_recall_per_size_class_at_the_threshold():
    rng, t = np.random.default_rng(2), J.THRESHOLD
    for n in (8, 16, 22, 24, 25, 34, 40, 58, 66, 98, 110, 163, 184, 300, 455, 760, 1270):
        found = 0
        shared = -(-int(2 * n * t * 1000) // int((1 + t) * 1000))
        for _ in range(400):
            g = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
            keys = []
            for x in (g[:n], g[n - shared :]):
                low = J.size_band(n, t)
                keys.append(set(J.sketch(np.sort(x), low, t)[0].tolist()) | set(J.sketch(np.sort(x), low + 1, t)[0].tolist()))
            found += bool(keys[0] & keys[1])
        assert found >= (0.995 if n <= J.STRICT else 0.96) * 400, (n, found)


def test_pairs_within_a_passage_that_thousands_share(spark):
    rng = np.random.default_rng(4)
    passage, rows, i = [f"p{k}" for k in range(64)], [], 0
    fresh = lambda k: [f"x{v}" for v in rng.integers(0, 2**60, k)]
    planted = set()
    for k in range(2400):
        own = fresh(35)
        rows.append((i, " ".join(passage + own), "en", "s", 1))
        if k % 12 == 0:  # shares the passage and a part of what is its own
            rows.append((i + 5000, " ".join(passage + own[:14] + fresh(21)), "en", "s", 1))
            planted.add((i, i + 5000))
        i += 1
    got = pairs(table(spark, rows))
    want = {(min(a, b), max(a, b)) for a, b in planted}
    assert got <= want and len(got) >= 0.96 * len(want)


def test_long_runs_in_blocks(spark, monkeypatch):
    rows = corpus(6, 80)
    whole = pairs(table(spark, rows))
    monkeypatch.setattr(J, "RUN", 1)
    monkeypatch.setattr(J, "RUN_BLOCK", 2)
    assert pairs(table(spark, rows)) == whole


def test_a_repeated_id_with_another_text(spark):
    other = " ".join(f"y{k}" for k in range(40))
    rows = [(1, EN, "en", "s", 1), (2, other, "en", "s", 1), (7, EN + " too", "en", "s", 1), (7, other + " too", "en", "s", 1), (7, "a text of its own here", "en", "s", 1)]
    assert pairs(table(spark, rows)) == {(1, 7), (2, 7)}
    kept = sorted((r.doc_id, r.text) for r in J.keep_one(table(spark, rows)).collect())
    assert kept == [(1, EN), (2, other), (7, "a text of its own here")]


def at_threshold(rng, n, k, first):
    """k pairs of texts of n words, of which as many 3-grams are shared as the threshold asks for, and no more."""
    rows, t, grams = [], J.THRESHOLD, n - 2
    for i in range(first, first + 2 * k, 2):
        shared = -(-int(2 * grams * t * 1000) // int((1 + t) * 1000))
        w = [f"{x:x}" for x in rng.integers(0, 2**60, 2 * n)]
        rows.append((i, " ".join(w[:n]), "en", "s", 1))
        rows.append((i + 1, " ".join(w[: shared + 2] + w[n : 2 * n - shared - 2]), "en", "s", 1))
    return rows


def test_every_pair_at_the_threshold_is_found(spark):
    rng, rows = np.random.default_rng(8), []
    for n in (12, 42, 68, 113, 187):
        rows += at_threshold(rng, n, 100, len(rows))
    want = {(i, i + 1) for i in range(0, len(rows), 2)}
    sets = [set(shingle_set(normal_bytes(r[1]), 3).tolist()) for r in rows]
    assert all(len(sets[i] & sets[j]) >= J.THRESHOLD * len(sets[i] | sets[j]) for i, j in want)
    assert pairs(table(spark, rows)) == want


def test_a_difference_within_one_part_of_the_hash_values(spark):
    """A sketch of a hash sample would see the whole difference of this pair and a fifth of what it shares."""
    rng, n, shared = np.random.default_rng(9), 1270, 953

    def grow(words, k):
        while len(words) < k:
            new = f"{rng.integers(0, 2**60):x}"
            g = shingle_set(normal_bytes(" ".join([*words[-2:], new])), 3)
            if mix64(g ^ np.uint64(0x9E3779B97F4A7C15))[0] >> np.uint64(40) < np.uint64(0.15 * (1 << 24)):
                words = [*words, new]
        return words

    base = [f"{x:x}" for x in rng.integers(0, 2**60, shared + 2)]
    rows = [(i, " ".join(grow(base, n + 2)), "en", "s", 1) for i in (1, 2)]
    assert pairs(table(spark, rows)) == {(1, 2)} == J.brute_force([1, 2], [r[1] for r in rows])


def test_sketches_of_unequal_bands_fold(spark):
    rng = np.random.default_rng(10)
    g = rng.integers(0, 2**63, 900, dtype=np.uint64)
    (_, x), (_, y) = (J.sketch(np.sort(g), b, J.THRESHOLD) for b in (J.size_band(100, J.THRESHOLD), J.size_band(900, J.THRESHOLD)))
    x, y = np.frombuffer(x, np.uint64)[None, :], np.frombuffer(y, np.uint64)[None, :]
    assert x.shape[1] < y.shape[1] and (J._fold(y, x.shape[1]) == x).all()


def test_contents_of_a_long_run_that_no_link_connects(spark, monkeypatch):
    rng = np.random.default_rng(11)
    fresh = lambda k: [f"x{v}" for v in rng.integers(0, 2**60, k)]
    passage, rows = [f"p{k}" for k in range(30)], []
    for i in range(0, 160, 2):
        own = fresh(20)
        rows += [(i, " ".join(passage + own), "en", "s", 1), (i + 1, " ".join(passage + own[:15] + fresh(5)), "en", "s", 1)]
    want = J.brute_force([r[0] for r in rows], [r[1] for r in rows])
    assert len(want) >= 80
    monkeypatch.setattr(J, "common_grams", lambda docs, n: (np.empty(0, np.uint64), np.empty(0, np.uint8)))  # no order but by hash
    for few, nxt, block in ((64, 4, 4000), (2, 0, 4000), (2, 0, 30), (16, 1, 50)):
        monkeypatch.setattr(J, "RUN", few), monkeypatch.setattr(J, "NEXT", nxt), monkeypatch.setattr(J, "RUN_BLOCK", block)
        assert pairs(table(spark, rows)) == want, (few, nxt, block)


def test_phrases_that_many_share_stay_out_of_the_keys(spark):
    """Runs must not grow with the table: each text is half its own, half phrases of a common stock."""
    rng = np.random.default_rng(12)
    stock = [" ".join(f"s{v}" for v in rng.integers(0, 2**60, 10)) for _ in range(20)]
    texts = [" ".join([*rng.choice(stock, 5, replace=False), *(f"x{v}" for v in rng.integers(0, 2**60, 50))]) for _ in range(3000)]
    m = J.marks(table(spark, [(i, x, "en", "s", 1) for i, x in enumerate(texts)]), 3, J.THRESHOLD)
    assert J.runs(m, J.THRESHOLD).count() < 1000
