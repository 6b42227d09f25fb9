from pathlib import Path

import numpy as np
import pytest
import tiktoken
from edges import clashing, edge_rows, edges, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphweave.llm import tokencount as C


@pytest.fixture(scope="module")
def counter():
    return C.PrefixCounter(C.read_ranks(Path(C.VOCABULARY).read_bytes()))


def brute(counter, text):
    enc = tiktoken.Encoding("own", pat_str=C.PATTERN, mergeable_ranks=counter.ranks, special_tokens={})
    return [len(enc.encode_ordinary(text[: i + 1])) for i in range(len(text))]


def check(counter, text):
    blob, counts = counter.pack(text)
    want = brute(counter, text)
    assert counts.tolist() == want
    assert C.unpack(blob).tolist() == want
    for b in (1, 3, 7, 1000):
        fit = max([i + 1 for i, n in enumerate(want) if n <= b], default=0)
        assert C.fitting(counts, b) == fit


TEXTS = ["Hello world", "we'll they've 're 's it'd 'v", "a  b   c\n\n d \n\te", "  lead", "trail   ", "x  y", "ñandú éè", "\U0001f600\U0001f600 ok", "==== ----====", "1234567 89", "thouerlyea onblehe " * 5, "'", "'l", "a" * 300, " " * 40, "supercalifragilistic" * 30, ".'s", "'still", "don't'll"]


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix(counter, text):
    check(counter, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abe' \n\t1.=é lvrst", max_size=40))
def test_random_prefixes(counter, text):
    if text:
        check(counter, text)


def test_edges(spark):
    got = C.count_prefixes(clashing(edges(spark)), budgets=(16, 1000)).collect()
    assert len(got) == 11
    texts = {(r[0], r[1]) for r in edge_rows()}
    enc = C.PrefixCounter(C.read_ranks(Path(C.VOCABULARY).read_bytes()))
    by = {i: t for i, t in texts}
    for r in got:
        t = by[r.doc_id]
        if t is None:
            assert r.n_tokens is None and r.prefix_counts is None and r.fits_16 is None
        elif not t:
            assert r.n_tokens == 0 and len(r.prefix_counts) == 1 and r.fits_16 == 0
        else:
            counts = C.unpack(bytes(r.prefix_counts))
            assert len(counts) == len(t) and counts[-1] == r.n_tokens == enc.pack(t)[1][-1]
            assert r.fits_1000 == C.fitting(counts, 1000)
    assert C.count_prefixes(empty(spark)).count() == 0


def test_wide_differences():
    blob = b"\4" + np.array([1, 300, -299], "<i4").tobytes()
    assert C.unpack(blob).tolist() == [1, 301, 2]
