"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

The byte-pair encoding of a prefix ends in one token whose predecessor encodes the shorter prefix: the only vocabulary
item at its end that, next to that predecessor's last token, encodes to itself and it. So count[i] = count[i - len] + 1,
found for all prefixes in one pass over a pretoken, and remembered by pretoken. Counts across pretokens add up; a prefix
that ends inside a run of white space or a contraction is cut as the pattern would cut it.

Stored for each text: the differences of the counts between successive characters (one signed byte each behind a width
byte 1, or four behind a width byte 4), from which any truncation or budget question is answered without encoding again.

Defined results: a null text gives nulls, an empty one 0 tokens and no differences. Texts are never cut. Extra columns
are ignored unless named in keep; clashing names are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pattern of the 50k byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUDGETS = (512, 2048, 8192)
CACHE = 1_000_000
LONG = 400
_BYTE = [bytes([i]) for i in range(256)]
#: Counters of this process by vocabulary and pattern: a worker keeps what it has learnt from task to task.
_HELD: dict[tuple[str, str], PrefixCounter] = {}


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


class PrefixCounter:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.core = tiktoken.Encoding("prefix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.prefixes: dict[bytes, tuple[int, bytes, bytes]] = {b"": (0, b"", b"")}  # count, last token, differences
        self.pieces: dict[str, bytes | None] = {}

    def _fits(self, a: bytes, b: bytes) -> bool:
        """Whether a, b is how their concatenation encodes."""
        if (k := self.pairs.get((a, b))) is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            k = self.pairs[a, b] = self.core._core_bpe.encode_single_piece(a + b) == [self.ranks[a], self.ranks[b]]
        return k

    def byte_differences(self, b: bytes) -> bytes:
        """Changes of the token count, modulo 256, with each byte of a pretoken of up to 64: the longest prefix that
        another pretoken has had is the start."""
        memo, ranks = self.prefixes, self.ranks
        e = len(b)
        while (got := memo.get(b[:e])) is None:
            e -= 1
        if e == len(b):
            return got[2]
        if len(memo) > CACHE:
            memo.clear()
            memo[b""] = got = (0, b"", b"")
            e = 0
        diffs, count = got[2], got[0]
        for e in range(e + 1, len(b) + 1):
            for n in range(min(e, self.longest), 0, -1):
                t = b[e - n : e]
                if t in ranks:
                    before = memo.get(b[: e - n])
                    if before is None:  # forgotten
                        self.byte_differences(b[: e - n])
                        before = memo[b[: e - n]]
                    if n == e or self._fits(before[1], t):
                        diffs += _BYTE[before[0] + 1 - count & 255]
                        count = before[0] + 1
                        memo[b[:e]] = (count, t, diffs)
                        break
        return diffs

    def byte_counts(self, b: bytes) -> list[int]:
        """Token count of each prefix of one pretoken, in bytes from 1 on."""
        if len(b) <= 64:
            return np.cumsum(np.frombuffer(self.byte_differences(b), np.int8), dtype=np.int64).tolist()
        ranks, counts, lasts = self.ranks, [0], [b""]
        for e in range(1, len(b) + 1):
            for n in range(min(e, self.longest), 0, -1):
                t = b[e - n : e]
                if t in ranks and (n == e or self._fits(lasts[e - n], t)):
                    counts.append(counts[e - n] + 1), lasts.append(t)
                    break
        return counts[1:]

    def _char_counts(self, piece: str) -> list[int]:
        b = piece.encode("utf-8", "surrogatepass")
        c = self.byte_counts(b)
        if len(b) != len(piece):
            c = [c[i] for i in range(len(b)) if i + 1 == len(b) or b[i + 1] & 0xC0 != 0x80]
        if len(piece) == 3 and piece[0] == "'" and piece[1:] in ("ll", "ve", "re"):  # cut after two: no contraction
            c[1] = c[0] + self.byte_counts(piece[1].encode())[0]
        return c

    def _piece(self, piece: str) -> bytes | None:
        """Differences of the counts of a pretoken that follows no white space; None if a byte can't hold them."""
        if len(piece) <= 64 and piece.isascii() and piece[0] != "'":
            return self.byte_differences(piece.encode())
        c = self._char_counts(piece)
        d = np.diff(np.array([0, *c]))
        return d.astype(np.int8).tobytes() if np.abs(d).max() < 128 else None

    def differences(self, text: str) -> np.ndarray:
        """Change of the token count with each character."""
        pieces = self.pattern.findall(text)
        cache = self.pieces
        if len(cache) > CACHE:
            cache.clear()
        for p in set(pieces):
            if p not in cache:
                cache[p] = self._piece(p) if len(p) <= LONG else None
        got = [cache[p] for p in pieces]
        if None not in got and not regex.search(r"\s\s", text):
            return np.frombuffer(b"".join(got), np.int8)
        out, base, before = np.empty(len(text), np.int32), 0, ""
        at = 0
        for p in pieces:  # with runs of white space: the first character of a piece may belong to the run before it
            c = self._char_counts(p)
            counts = np.array(c) + base
            if before.isspace() and p[0].isspace():
                counts[0] = base - self._char_counts(before)[-1] + self._char_counts(before + p[0])[-1]
            out[at : at + len(p)] = counts
            base, before, at = base + c[-1], p, at + len(p)
        return np.diff(out, prepend=0)

    def pack(self, text: str) -> tuple[bytes, np.ndarray]:
        d = self.differences(text)
        narrow = d.dtype == np.int8 or not len(d) or np.abs(d).max() < 128
        return (b"\1" + d.astype(np.int8).tobytes() if narrow else b"\4" + d.astype("<i4").tobytes()), np.cumsum(d, dtype=np.int64)


def counter_for(vocabulary: bytes, pattern: str) -> PrefixCounter:
    key = hashlib.sha256(vocabulary).hexdigest(), pattern
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = PrefixCounter(read_ranks(vocabulary), pattern)
    return _HELD[key]


def unpack(blob: bytes) -> np.ndarray:
    """Token counts of the prefixes of 1, 2, ... characters."""
    return np.cumsum(np.frombuffer(blob, np.int8 if blob[0] == 1 else "<i4", offset=1), dtype=np.int64)


def fitting(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens."""
    ok = np.flatnonzero(counts <= budget)
    return int(ok[-1]) + 1 if len(ok) else 0


def count_prefixes(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, budgets: tuple[int, ...] = BUDGETS, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., n_tokens, prefix_counts, fits_<budget>...). The vocabulary file is read here and broadcast (its size is
    fixed); one narrow pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    names = ["n_tokens", "prefix_counts", *(f"fits_{b}" for b in budgets)]
    kept = [c for c in keep if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(shared.value, pattern)
        for big in batches:
            for i in range(0, big.num_rows, 500):
                b = big.slice(i, 500)
                n, blobs, fits = [], [], [[] for _ in budgets]
                for text in b.column(b.num_columns - 1).to_pylist():
                    if text is None:
                        n.append(None), blobs.append(None), [f.append(None) for f in fits]
                        continue
                    blob, counts = counter.pack(text)
                    n.append(int(counts[-1]) if len(counts) else 0), blobs.append(blob)
                    for f, limit in zip(fits, budgets, strict=True):
                        f.append(len(counts) if len(counts) <= limit // 4 else fitting(counts, limit))
                new = [pa.array(n, pa.int64()), pa.array(blobs, pa.binary()), *(pa.array(f, pa.int64()) for f in fits)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*kept, *names])

    d = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias("_text"))
    kinds = [T.LongType(), T.BinaryType(), *(T.LongType() for _ in budgets)]
    return d.mapInArrow(run, T.StructType([*d.schema.fields[:-1], *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))]))
