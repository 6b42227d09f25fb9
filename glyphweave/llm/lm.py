"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are the bytes of a text's UTF-8 form, so no script shares an id with another and none is left out; one more id
stands before the start of a text. The model predicts the next token's vector as the sum of position matrices times the
vectors of the CONTEXT tokens before it; a token's score is its inner product with that prediction plus a bias.

Training sees the whole table through exact counts of all (CONTEXT + 1)-grams, gathered by one aggregation. The counts
are dealt to partitions in number proportional to the tokens; each partition runs minibatch NCE in numpy on examples drawn
from its counts, one for every TOKENS_AN_EXAMPLE tokens and round, and after each round the parameters are averaged by
weight, in Spark first, so that the driver adds up about the square root of the number of partitions.

Scoring computes the logits of the distinct contexts of a block as one matrix product with the whole vocabulary and
normalises them, so that every token's log-probability is exact under the model. Blocks are cut by bytes, BLOCK of them
at most: a longer text is taken in pieces that know the tokens before them.

Defined results: a null or empty text has 0 tokens, log_prob 0 and a null perplexity. Whole texts are scored. Repeated
rows are scored alike, each on its own. An empty table gives an empty table. Other columns are ignored unless named in
keep; clashes with the added names replace the input's.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

V, CONTEXT, DIM = 257, 4, 32
START = 256
NOISE, BATCH, ROUNDS, RATE, LEAST_STEPS = 25, 2048, 4, 0.3, 150
TOKENS_AN_EXAMPLE, PART_TOKENS = 64, 1 << 26
BLOCK, STEP = 1 << 21, 1 << 14

Piece = tuple[int, bytes, bytes]  # row, the bytes before, the bytes


def blocks(texts: pa.Array) -> Iterator[list[Piece]]:
    """The rows' bytes in blocks of at most BLOCK."""
    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    held, n = [], 0
    for i in np.flatnonzero(size):
        b = texts[int(i)].as_buffer().to_pybytes()
        for at in range(0, len(b), BLOCK):
            piece = b[at : at + BLOCK]
            if n + len(piece) > BLOCK:
                yield held
                held, n = [], 0
            held.append((int(i), b[max(0, at - CONTEXT) : at], piece))
            n += len(piece)
    if held:
        yield held


def codes(pieces: list[Piece]) -> tuple[np.ndarray, np.ndarray]:
    """(context, token) in one number for every token of the pieces in a row, and the lengths of the pieces."""
    n = np.array([len(p) for _, _, p in pieces], np.int64)
    tok = np.frombuffer(b"".join(bytes(CONTEXT - len(h)) + h + p for _, h, p in pieces), np.uint8).astype(np.int64)
    begin = np.cumsum(n + CONTEXT) - n - CONTEXT
    real = np.ones(len(tok), bool)
    for j in range(CONTEXT):
        lack = np.array([j < CONTEXT - len(h) for _, h, _ in pieces], bool)
        tok[begin[lack] + j] = START
        real[begin + j] = False
    code = np.zeros(len(tok) - CONTEXT if len(tok) else 0, np.int64)
    for j in range(CONTEXT + 1):
        code = code * V + tok[j : len(code) + j]
    return code[real[CONTEXT:]], n


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): exact counts of all n-grams of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_n, waiting = [], [], 0

        def merge() -> None:
            nonlocal held, held_n, waiting
            k, inv = np.unique(np.concatenate(held), return_inverse=True)
            held, held_n, waiting = [k], [np.bincount(inv, np.concatenate(held_n)).astype(np.int64)], len(k)

        for b in batches:
            for pieces in blocks(b.column(0)):
                k, c = np.unique(codes(pieces)[0], return_counts=True)
                held.append(k), held_n.append(c)
                waiting += len(k)
                if waiting > 4_000_000:
                    merge()
                if waiting > 3_000_000:  # so many differ that counts are sent on and summed beyond
                    yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held_n[0])], names=["code", "n"])
                    held, held_n, waiting = [], [], 0
        if held:
            merge()
            for i in range(0, waiting, 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(held[0][i : i + 100_000]), pa.array(held_n[0][i : i + 100_000])], names=["code", "n"])

    return docs.select(text_col).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class LogBilinear:
    p: dict[str, np.ndarray]  # E (V, DIM), C (CONTEXT, DIM, DIM), Q (V, DIM), b (V)

    @classmethod
    def start(cls, unigram: np.ndarray, seed: int = 5) -> LogBilinear:
        rng = np.random.default_rng(seed)
        small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        eye = np.stack([np.eye(DIM, dtype=np.float32) * (0.5 + 0.5 * i / CONTEXT) for i in range(CONTEXT)])
        return cls({"E": small(V, DIM), "C": eye + small(CONTEXT, DIM, DIM) * 0.1, "Q": small(V, DIM), "b": np.log(unigram).astype(np.float32)})

    def predict(self, ctx: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Predicted vectors of contexts, and the ids by position."""
        ids = [(ctx // V ** (CONTEXT - 1 - j)) % V for j in range(CONTEXT)]
        return sum((self.p["E"] @ self.p["C"][j])[i] for j, i in enumerate(ids)), ids

    def log_probs(self, ctx: np.ndarray) -> np.ndarray:
        """Normalised log-probabilities of all tokens after each context."""
        s = self.predict(ctx)[0] @ self.p["Q"].T + self.p["b"]
        s -= s.max(axis=1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and summed log-probability of each text."""
        count, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for pieces in blocks(texts):
            code, n = codes(pieces)
            grams, inv = np.unique(code, return_inverse=True)
            ctx, lp = grams // V, np.empty(len(grams))
            own = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
            for i in range(0, len(own), STEP):  # the n-grams of these contexts lie side by side
                lo, hi = own[i], own[i + STEP] if i + STEP < len(own) else len(grams)
                row = np.searchsorted(own[i : i + STEP], np.arange(lo, hi), side="right") - 1
                lp[lo:hi] = self.log_probs(ctx[own[i : i + STEP]])[row, grams[lo:hi] % V]
            sums = np.add.reduceat(lp[inv], np.cumsum(n) - n)
            at = np.array([i for i, _, _ in pieces])
            np.add.at(count, at, n), np.add.at(total, at, sums)
        return count, total


def train_part(model: LogBilinear, code: np.ndarray, count: np.ndarray, unigram: np.ndarray, rate: float, seed: int) -> LogBilinear:
    """Minibatch NCE on examples drawn by count, one for every TOKENS_AN_EXAMPLE tokens but LEAST_STEPS minibatches at
    least."""
    rng = np.random.default_rng(seed)
    p = {k: v.copy() for k, v in model.p.items()}
    m = LogBilinear(p)
    g2 = {k: np.full_like(v, 1e-2) for k, v in p.items()}
    cum = np.cumsum(count.astype(np.float64))
    log_noise = (np.log(NOISE) + np.log(unigram)).astype(np.float32)
    steps = max(LEAST_STEPS, int(cum[-1] / TOKENS_AN_EXAMPLE / BATCH))
    at = np.arange(BATCH)
    for t in range(steps):
        pick = code[np.searchsorted(cum, rng.random(BATCH) * cum[-1], side="right").clip(0, len(code) - 1)]
        w = pick % V
        r, ids = m.predict(pick // V)
        noise = rng.multinomial(NOISE * BATCH, unigram).astype(np.float32) / BATCH  # shared by the minibatch
        delta = r @ p["Q"].T + p["b"] - log_noise
        s = 1 / (1 + np.exp(-delta.clip(-30, 30)))
        g = s * noise
        g[at, w] += s[at, w] - 1
        g /= BATCH
        dr = g @ p["Q"]
        grad = {"Q": g.T @ r, "b": g.sum(axis=0), "E": np.zeros_like(p["E"]), "C": np.zeros_like(p["C"])}
        for j, i in enumerate(ids):
            one = np.zeros((BATCH, V), np.float32)
            one[at, i] = 1
            per = one.T @ dr  # by token, what reaches its vector through this position
            grad["C"][j] = p["E"].T @ per
            grad["E"] += per @ p["C"][j].T
        now = rate * (1 - 0.9 * t / steps)
        for k, d in grad.items():
            g2[k] += d * d
            p[k] -= (now * d / np.sqrt(g2[k])).astype(np.float32)
    return m


def fit(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, seed: int = 5) -> LogBilinear:
    """What reaches the driver: counts of V tokens, and in each round about as many parameter sets, of fixed size, as the
    square root of the number of partitions."""
    grams = written(gram_counts(docs, text_col), "grams")
    uni = np.full(V, 1e-9)
    for r in grams.groupBy((F.col("code") % V).cast("int").alias("w")).agg(F.sum("n").alias("n")).collect():
        uni[r.w] += r.n
    tokens = round(uni.sum())
    uni = (uni + 1e-4 * uni.sum() / V) / (uni + 1e-4 * uni.sum() / V).sum()
    model = LogBilinear.start(uni, seed)
    if not tokens:
        return model
    parts = max(1, round(tokens / PART_TOKENS))
    groups = max(1, round(parts**0.5))
    dealt = written(grams.repartition(parts, "code"), "grams-dealt") if parts > 1 else grams.coalesce(1)
    spark = docs.sparkSession
    for rnd in range(rounds):
        shared = spark.sparkContext.broadcast(pickle.dumps(model.p))
        rate = RATE / (1 + rnd)

        def run(batches: Iterator[pd.DataFrame], shared=shared, rate=rate, rnd=rnd) -> Iterator[pd.DataFrame]:
            got = [b for b in batches if len(b)]
            if got:
                b = pd.concat(got).sort_values("code")
                m = train_part(LogBilinear(pickle.loads(shared.value)), b.code.to_numpy(), b.n.to_numpy(), uni, rate, seed * 1000 + rnd)
                w = float(b.n.sum())
                yield pd.DataFrame({"g": [int(b.code.iloc[0]) % groups], "weight": [w], "p": [pickle.dumps({k: v * w for k, v in m.p.items()})]})

        def add(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            p: dict[str, np.ndarray] = {}
            for blob in b.p:
                p = {k: p.get(k, 0) + v for k, v in pickle.loads(blob).items()}
            return pd.DataFrame({"weight": [b.weight.sum()], "p": [pickle.dumps(p)]})

        sums = dealt.mapInPandas(run, "g int, weight double, p binary").groupBy("g").applyInPandas(add, "weight double, p binary")
        total, p = 0.0, {}
        for x in sums.toLocalIterator():
            total, p = total + x.weight, {k: p.get(k, 0) + v for k, v in pickle.loads(bytes(x.p)).items()}
        model = LogBilinear({k: (v / total).astype(np.float32) for k, v in p.items()})
    return model


def score(docs: DataFrame, model: LogBilinear, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., n_tokens, log_prob, perplexity); one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model.p))
    names = ["n_tokens", "log_prob", "perplexity"]
    kept = [c for c in keep if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LogBilinear(pickle.loads(shared.value))
        for b in batches:
            n, lp = m.score(b.column(b.num_columns - 1))
            ppl = [float(np.exp(-x / k)) if k else None for x, k in zip(lp, n, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n), pa.array(lp), pa.array(ppl, pa.float64())], names=[*kept, *names])

    d = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias("_text"))
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("perplexity", T.DoubleType())]
    return d.mapInArrow(run, T.StructType([*d.schema.fields[:-1], *new]))
