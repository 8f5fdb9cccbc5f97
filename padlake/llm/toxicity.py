"""Toxicity: a factorisation machine over hashed terms.

A linear score adds up single terms; the machine also has a vector for each term, and the product of two terms' vectors
is the weight of the pair, so that two harmless words can be harmful together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padlake.llm.labelled import training_rows
from padlake.llm.memory import trim

#: Label rows that the machine is fitted on, at most.
SAMPLE = 8192
#: Buckets of the hash; of these the TERMS that tell the labels apart best take part.
BUCKETS, TERMS = 1 << 20, 2048
FACTORS, STEPS, RATE, DECAY = 8, 250, 0.05, 2e-4
#: Beginnings of words that are terms of their own, for words that are put together.
STEMS = (4, 5, 6, 7)
REMEMBERED = 200_000

WORDS = re.compile(r"[^\W\d_]+")


def buckets(word: str) -> list[int]:
    """Of the word itself and of its beginnings."""
    return [crc32(word.encode()) % BUCKETS, *(crc32(f"{word[:k]}~".encode()) % BUCKETS for k in STEMS if len(word) >= k)]


def terms(text: str) -> np.ndarray:
    """The distinct buckets of a whole text."""
    return np.unique(np.fromiter(chain.from_iterable(map(buckets, set(WORDS.findall(text.lower())))), np.int32))


@dataclass(frozen=True)
class Machine:
    """``index``: bucket to row of ``weight`` and ``factors``."""

    bias: float
    index: dict[int, int]
    weight: np.ndarray
    factors: np.ndarray

    def score(self, rows: list[list[int]]) -> np.ndarray:
        """For each list of the weights' rows."""
        out = np.empty(len(rows))
        for k, row in enumerate(rows):
            v = self.factors[row]
            out[k] = self.bias + self.weight[row].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def chosen(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The buckets whose presence tells the labels apart best, by the statistic of two shares."""
    df1, df0 = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row, label in zip(rows, y):
        (df1 if label > 0 else df0)[row] += 1
    n, n1 = len(rows), y.sum()
    ids = np.flatnonzero(df0 + df1).astype(np.int32)
    df, df1 = (df0 + df1)[ids], df1[ids]
    share = df / max(n, 1)
    z = np.abs(df1 - n1 * share) / np.sqrt(np.maximum(n1 * share * (1 - share), 1e-9) + 0.5)
    z[df < 3] = 0
    best = np.lexsort((ids, -z))[:TERMS]
    return ids[best[z[best] > 2.5]]


def fit(rows: list[np.ndarray], y: np.ndarray) -> Machine:
    """Adam on the logistic loss, all rows at each step; rows: the distinct buckets of each text."""
    share = min(max((y.sum() + 0.5) / (len(y) + 1), 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    ids = chosen(rows, y)
    if len(y) == 0 or y.min() == y.max() or len(ids) == 0:
        return Machine(bias, {}, np.zeros(0), np.zeros((0, FACTORS)))
    order = np.argsort(ids)
    x = np.zeros((len(rows), len(ids)), np.float32)
    for k, row in enumerate(rows):
        at = np.searchsorted(ids[order], row)
        x[k, order[at[(at < len(ids)) & (ids[order[np.minimum(at, len(ids) - 1)]] == row)]]] = 1
    rng = np.random.default_rng(7)
    params = [np.array([bias], np.float32), np.zeros(len(ids), np.float32), rng.normal(0, 0.05, (len(ids), FACTORS)).astype(np.float32)]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) ** 0.5
    for step in range(1, STEPS + 1):
        b, w, v = params
        q = x @ v
        z = b + x @ w + 0.5 * ((q**2).sum(1) - x @ (v**2).sum(1))
        e = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        e = e.astype(np.float32)
        grads = [e.sum(keepdims=True), x.T @ e + DECAY * w, x.T @ (e[:, None] * q) - (x.T @ e)[:, None] * v + DECAY * v]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            params[k] = params[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    b, w, v = params
    q = x @ v
    b = b - _cut(b + x @ w + 0.5 * ((q**2).sum(1) - x @ (v**2).sum(1)), y)
    return Machine(float(b[0]), {int(t): k for k, t in enumerate(ids)}, w.astype(float), v.astype(float))


def _cut(z: np.ndarray, y: np.ndarray) -> float:
    """Where between scores the fewest labels are wrong; of several such places a quarter up the widest gap, for clean texts are the more alike."""
    order = np.argsort(z, kind="stable")
    z, y = z[order].astype(float), y[order] > 0
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[0], np.cumsum(~y)])[-1] - np.concatenate([[0], np.cumsum(~y)])
    edge = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    gap = np.where(wrong == wrong.min(), edge[1:] - edge[:-1], -1)
    k = int(gap.argmax())
    return float(edge[k] + (edge[k + 1] - edge[k]) / 4)


def _terms():
    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([terms(x or "") for x in texts.to_pylist()], pa.list_(pa.int32()))

    return found


def train(docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "toxic", key: str = "doc_id", text: str = "text", bound: int = SAMPLE) -> Machine:
    """The machine fitted on at most ``bound`` rows of ``labels`` that are ``learnable``; without rows of both labels, the share alone decides."""
    rows = training_rows(docs, labels, label, learnable, bound, key, text).select(F.col("key").cast("long").alias("key"), "label", _terms()("text").alias("x")).toArrow()
    y, x = rows["label"].to_numpy(), rows["x"].combine_chunks()
    ends, values = x.offsets.to_numpy(), x.values.to_numpy()
    order = np.lexsort((np.diff(ends), y, rows["key"].to_numpy()))
    machine = fit([values[ends[k] : ends[k + 1]] for k in order.tolist()], y[order])
    trim()
    return machine


class _Rows(dict):
    """Word to the machine's rows of its terms, remembered up to a bound."""

    def __init__(self, index: dict[int, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = rows = tuple(self.index[b] for b in buckets(word) if b in self.index)
        return rows


def score(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: how likely the whole text has label 1, in [0, 1]; null texts count as empty, every row stays."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Rows(machine.index)
        for texts in batches:
            found = [sorted(set(chain.from_iterable(map(known.__getitem__, set(WORDS.findall((t or "").lower())))))) for t in texts.to_pylist()]
            yield pa.array(machine.score(found), pa.float64())
            trim()

    return docs.withColumn(out, scored(F.col(f"`{text}`")))
