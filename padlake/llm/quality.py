"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The trees are fitted on the driver, on a bounded sample, and flattened into arrays: a row of four arrays for each
tree, walked level by level for all documents of a batch at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padlake.llm.labelled import training_rows
from padlake.llm.memory import trim

#: Label rows that the trees are fitted on, at most.
SAMPLE = 8192
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 80, 4, 48, 0.15, 1.0, 12
FEATURES = (
    "chars_log", "words_log", "word_length", "letters", "upper", "digits", "spaces", "lines_per_word", "not_ascii",
    "stops", "commas", "marks", "bars", "noise", "other_signs", "distinct_words", "repeated_next", "top_word",
    "distinct_lines", "short_lines", "words_without_letters", "words_with_noise",
)


def statistics(text: str) -> list[float]:
    """The numbers of FEATURES for one text; an empty text has all zeros."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    k, m = max(len(words), 1), max(len(lines), 1)
    counts = Counter(words)
    upper, lower, digits = int(h[65:91].sum()), int(h[97:123].sum()), int(h[48:58].sum())
    high = int(h[128:].sum())
    at = lambda s: int(h[list(s)].sum())
    spaces, stops, commas, marks, bars, noise = at(b" \t\r\n"), at(b"."), at(b",;:"), at(b"!?"), at(b"|"), at(b"#$%&*@^~")
    odd = [w for w in counts if not w.isalpha()]
    return [
        np.log1p(n), np.log1p(k), (n - spaces) / k, (upper + lower + high) / n, upper / max(upper + lower, 1), digits / n, spaces / n, len(lines) / k, high / n,
        stops / k, commas / k, marks / k, bars / k, noise / k, (n - upper - lower - digits - high - spaces - stops - commas - marks - bars - noise) / n,
        len(counts) / k, sum(map(eq, words, words[1:])) / k, max(counts.values(), default=0) / k,
        len(set(lines)) / m, sum(len(x) < 40 for x in lines) / m,
        sum(counts[w] for w in odd if not any(map(str.isalpha, w))) / k, sum(counts[w] for w in odd if w[-1] in "#$%&*@!|") / k,
    ]


@dataclass(frozen=True)
class Forest:
    """Arrays [trees, nodes]: a node's children are 2k + 1 and 2k + 2; a leaf sends everything to its left child of the same value."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosting with the logistic loss; splits are looked for between the bins of each feature's quantiles."""
    n, d = x.shape if x.size else (0, len(FEATURES))
    nodes = 2 ** (DEPTH + 1) - 1
    share = min(max((y.sum() + 0.5) / (n + 1), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    feature, cut, value = np.zeros((TREES, nodes), np.int64), np.full((TREES, nodes), np.inf), np.zeros((TREES, nodes))
    if n == 0 or y.min() == y.max():
        return Forest(start, feature[:0], cut[:0], value[:0])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    total = np.full(n, start)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        open_nodes = {0}
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best_gain, split = np.full(width, 1e-6), {}
            for j in range(d):
                cell = (at - first) * BINS + binned[j]
                sums = [np.bincount(cell, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h, None)]
                (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(nl < LEAST) | (nt - nl < LEAST)] = 0
                b = gain[:, : len(edges[j])].argmax(1) if len(edges[j]) else np.zeros(width, np.int64)
                for k in range(width):
                    if len(edges[j]) and first + k in open_nodes and gain[k, b[k]] > best_gain[k]:
                        best_gain[k], split[k] = gain[k, b[k]], (j, b[k])
            for k, (j, b) in split.items():
                feature[t, first + k], cut[t, first + k] = j, edges[j][b]
            open_nodes = {2 * (first + k) + s for k in split for s in (1, 2)}
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > cut[t, at])
        leaf = 2**DEPTH - 1
        gs, hs = np.bincount(at - leaf, g, 2**DEPTH), np.bincount(at - leaf, h, 2**DEPTH)
        value[t, leaf:] = -RATE * gs / (hs + RIDGE)
        total += value[t, at]
    return Forest(start, feature, cut, value)


def _statistics():
    @F.arrow_udf("array<double>")
    def numbers(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(x or "") for x in texts.to_pylist()], pa.list_(pa.float64()))

    return numbers


def train(docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "quality", key: str = "doc_id", text: str = "text", bound: int = SAMPLE) -> Forest:
    """The forest fitted on at most ``bound`` rows of ``labels`` that are ``learnable``; without rows of both labels, the share alone decides."""
    rows = training_rows(docs, labels, label, learnable, bound, key, text).select("label", _statistics()("text").alias("x")).toPandas()
    rows = rows.assign(order=[tuple(v) for v in rows.x]).sort_values(["order", "label"]) if len(rows) else rows
    forest = fit(np.array(rows.x.tolist(), dtype=float), rows.label.to_numpy(float))
    trim()
    return forest


def score(docs: DataFrame, forest: Forest, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: how likely the whole text has label 1, in [0, 1]; null texts count as empty, every row stays."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.array([statistics(t or "") for t in texts.to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.array(forest.score(x), pa.float64())
            trim()

    return docs.withColumn(out, scored(F.col(f"`{text}`")))
