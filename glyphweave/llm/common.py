"""What the operators share: working folders, checked broadcasts, hashing of texts in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few narrow columns may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000

_SPACE = np.zeros(256, np.uint8)
_SPACE[:] = np.arange(256)
for _c in b"\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\x00":
    _SPACE[_c] = 32
PUNCT_TO_SPACE = _SPACE.tobytes()


def work_dir(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names.

    Where the setting is absent (tests, local mode) a temporary folder stands in; a real cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(spark, "_glyphweave_dir", None)
        if base is None:
            base = spark._glyphweave_dir = "file://" + tempfile.mkdtemp(prefix="glyphweave-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The table, written to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = work_dir(spark, what)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Deletes a table of written() that nothing will read again."""
    drop_path(df.sparkSession, df._written_to)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if a count (of a written table: of its footers) allows it, else the table as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def word_count(text: Column) -> Column:
    """Whitespace-separated words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f\\x0B]++")), F.lit(0)).cast("long")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length() if n > 1 else 1)
    if size not in _POW:
        if len(_POW) > 3:
            _POW.clear()
        both = []
        for r in (_R, _RINV):
            p = np.empty(size, np.uint64)
            p[0], done, step = 1, 1, r
            while done < size:  # doubling: p[i + done] = p[i] * r ** done
                p[done : 2 * done] = p[:done] * np.uint64(step)
                done, step = 2 * done, step * step % (1 << 64)
            both.append(p)
        _POW[size] = (both[0], both[1])
    return _POW[size]


def normal_bytes(text: str | None) -> bytes:
    """Lower case, ASCII punctuation and white space as single spaces."""
    if text is None:
        return b""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(PUNCT_TO_SPACE).split())


def word_hashes(norm: bytes) -> np.ndarray:
    """64-bit hash of each word of normal_bytes(); by prefix sums of a polynomial, no loop over words."""
    if not norm:
        return np.empty(0, np.uint64)
    b = np.frombuffer(norm, np.uint8)
    n = len(b)
    pw, inv = _powers(n + 1)
    acc = np.empty(n + 1, np.uint64)
    acc[0] = 0
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * pw[:n], out=acc[1:])
    gaps = np.flatnonzero(b == 32)
    start = np.concatenate(([0], gaps + 1))
    end = np.concatenate((gaps, [n]))
    return mix64((acc[end] - acc[start]) * inv[start] + (end - start).astype(np.uint64))


def shingle_set(norm: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a text of fewer words is one gram, an empty one none."""
    w = word_hashes(norm)
    if len(w) == 0:
        return w
    n = min(n, len(w))
    g = w[: len(w) - n + 1].copy()
    for i in range(1, n):
        g = mix64(g * np.uint64(0x9FB21C651E98DF25) + w[i : len(w) - n + 1 + i])
    g.sort()
    return g[np.concatenate(([True], g[1:] != g[:-1]))]


def pandas_batches(batches: Iterator, columns: list[str]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            yield b[columns]
