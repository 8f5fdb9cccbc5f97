"""Benchmark decontamination: passages of documents within an edit distance of a benchmark item.

Words are the symbols. A CGK random walk copies a window symbol by symbol and moves on, or not, by a random bit that
depends on the step and the symbol; windows at a small edit distance have walks at a small Hamming distance. Sampling a
few steps of the walk gives a hash; as many hashes are used as reach the target recall. What collides is verified by
the exact edit distance. Where MOST_HASHES don't reach it, as for long items, every window that can match is verified.

Of all item-sized windows only those are walked that can match at all: an item of n words with at most k edits has one
of k + 1 pieces in the text unchanged, wherever the edits are.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padlake.llm.memory import trim

WORDS = re.compile(r"[^\W_]+")
#: 1 - distance / words of the item.
SIMILARITY = 0.8
RECALL = 0.98
#: Steps that a hash samples; hashes at most.
SAMPLED, MOST_HASHES = 2, 48
#: Characters of the benchmark that are sent to the workers at a time.
BLOCK_CHARS = 16 << 20
_BITMAP = 22
_STRUCT = "array<struct<item_id:bigint,start_word:int,n_words:int,distance:int,similarity:double>>"


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def most_edits(n: int, similarity: float) -> int:
    return int(math.floor(n * (1 - similarity) + 1e-9))


def embed(windows: np.ndarray, bits: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """CGK: the symbols at ``steps`` of the walk over each row of ``windows``; -1 after a window's end. bits: [step, symbol & 255]."""
    rows, n = windows.shape
    out = np.full((rows, len(steps)), -1, np.int64)
    at, every = np.zeros(rows, np.int64), np.arange(rows)
    for j in range(int(steps.max()) + 1):
        symbol = np.where(at < n, windows[every, np.minimum(at, n - 1)], -1)
        out[:, steps == j] = symbol[:, None]
        at += bits[j, symbol & 255]
    return out


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the part of text nearest to item by edit distance; of several, the first to end, then the one nearest in length."""

    def last_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        places = np.arange(len(b) + 1)
        row = np.zeros_like(places) if free else places.copy()
        for i, symbol in enumerate(a, 1):
            new = np.minimum(row[1:] + 1, row[:-1] + (b != symbol))
            row = np.minimum.accumulate(np.concatenate([[i], new]) - places) + places
        return row

    row = last_row(item, text, True)
    end = int(row.argmin())
    back = last_row(item[::-1], text[:end][::-1], False)
    lengths = np.flatnonzero(back == row[end])
    return int(row[end]), end - int(lengths[np.abs(lengths - len(item)).argmin()]), end


def _piece_hash(ids: np.ndarray, size: int) -> np.ndarray:
    """Of each run of ``size`` ids, at its start."""
    n = max(len(ids) - size + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = (h ^ ids[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Index:
    """The items, the pieces that a text must share with one, and the hash tables of the items' walks."""

    items: list[tuple[int, list[str]]]
    similarity: float = SIMILARITY
    recall: float = RECALL
    vocabulary: dict[str, int] = field(init=False)
    ids: list[np.ndarray] = field(init=False)

    def __post_init__(self):
        self.items = [(k, w) for k, w in self.items if w]
        self.vocabulary = {w: 1 + k for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        self.ids = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in self.items]
        self.pieces: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, ids in enumerate(self.ids):
            edits = most_edits(len(ids), self.similarity)
            size = len(ids) // (edits + 1)
            hashes = _piece_hash(ids, size)
            for piece in range(edits + 1):
                self.pieces[size][int(hashes[piece * size])].append((k, piece * size))
        self.pieces = {size: dict(found) for size, found in self.pieces.items()}
        self.bitmaps = {}
        for size, found in self.pieces.items():
            self.bitmaps[size] = np.zeros(1 << _BITMAP, bool)
            self.bitmaps[size][np.fromiter(found, np.uint64) >> np.uint64(64 - _BITMAP)] = True
        longest = max(map(len, self.ids), default=1)
        self.bits = np.random.default_rng(11).integers(0, 2, (MOST_HASHES, 2 * longest + 1, 256), dtype=np.int8)
        self.steps: dict[int, np.ndarray] = {}
        self.tables: dict[int, list[dict[tuple, list[int]]]] = {}
        #: Lengths whose windows are all verified.
        self.exact: set[int] = set()
        for n in sorted({len(x) for x in self.ids}):
            rng = np.random.default_rng(n)
            steps = rng.integers(0, max(1, 3 * n // 2), (MOST_HASHES, SAMPLED))
            own = [k for k, x in enumerate(self.ids) if len(x) == n]
            hashes = self._hashes_for_recall(n, own, steps, rng)
            if hashes is None:
                self.exact.add(n)
                continue
            self.steps[n] = steps[:hashes]
            self.tables[n] = []
            for t in range(hashes):
                table: dict[tuple, list[int]] = defaultdict(list)
                for k, row in zip(own, embed(np.stack([self.ids[k] for k in own]), self.bits[t], steps[t]).tolist()):
                    table[tuple(row)].append(k)
                self.tables[n].append(dict(table))

    def _hashes_for_recall(self, n: int, own: list[int], steps: np.ndarray, rng: np.random.Generator) -> int | None:
        """So many hashes that copies with all the edits allowed collide in one of them as often as asked; None if MOST_HASHES are too few."""
        edits = most_edits(n, self.similarity)
        if not edits:
            return 1
        originals, copies = [], []
        for k in (own * (200 // len(own) + 1))[:200]:
            copy = self.ids[k].tolist()
            for kind in rng.integers(0, 3, edits):
                place = int(rng.integers(0, max(len(copy), 1)))
                if kind == 0:
                    copy.insert(place, 0)
                elif copy and kind == 1:
                    copy.pop(place)
                elif copy:
                    copy[place] = 0
            originals.append(self.ids[k])
            copies.append((copy + [0] * n)[:n])
        met = np.zeros(len(copies), bool)
        for t in range(MOST_HASHES):
            met |= (embed(np.stack(originals), self.bits[t], steps[t]) == embed(np.array(copies), self.bits[t], steps[t])).all(1)
            if met.mean() >= self.recall:
                return t + 1
        return None

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int, float]]]:
        """For each text (item, first word, words, distance, similarity) of what is found, the best place for each item."""
        found: list[list[tuple[int, int, int, int, float]]] = [[] for _ in texts]
        if not self.items:
            return found
        known = self.vocabulary.get
        parts = [np.fromiter(map(known, ws, repeat(0)), np.int64, len(ws)) for ws in map(words, texts)]
        gap = np.zeros(max(self.pieces), np.int64)
        ids = np.concatenate([x for p in parts for x in (p, gap)]) if parts else gap
        starts = np.cumsum([0, *(len(p) + len(gap) for p in parts)])
        windows: dict[tuple[int, int], set[int]] = defaultdict(set)
        met: dict[tuple[int, int], set[int]] = defaultdict(set)
        for size, pieces in self.pieces.items():
            hashes = _piece_hash(ids, size)
            for place in np.flatnonzero(self.bitmaps[size][hashes >> np.uint64(64 - _BITMAP)]).tolist():
                for k, offset in pieces.get(int(hashes[place]), ()):
                    doc = int(np.searchsorted(starts, place, "right")) - 1
                    n = len(self.ids[k])
                    edits = most_edits(n, self.similarity)
                    first = place - offset - starts[doc]
                    near = range(max(0, first - edits), max(0, min(first + edits, len(parts[doc]) - 1)) + 1)
                    (met[doc, k] if n in self.exact else windows[doc, n]).update(near)
        for (doc, n), places in windows.items():
            text = parts[doc]
            at = np.array(sorted(places))
            padded = np.concatenate([text, np.zeros(n, np.int64)])
            rows = np.lib.stride_tricks.sliding_window_view(padded, n)[at]
            for t, table in enumerate(self.tables[n]):
                for p, row in zip(at.tolist(), map(tuple, embed(rows, self.bits[t], self.steps[n][t]).tolist())):
                    for k in table.get(row, ()):
                        met[doc, k].add(p)
        for (doc, k), where in met.items():
            text, n = parts[doc], len(self.ids[k])
            edits, best = most_edits(n, self.similarity), None
            for low, high in _runs(sorted(where), n):
                a = max(0, low - edits)
                distance, start, end = best_match(self.ids[k], text[a : high + n + edits])
                if distance <= edits and (best is None or distance < best[0]):
                    best = (distance, a + start, end - start)
            if best:
                found[doc].append((self.items[k][0], best[1], best[2], best[0], 1 - best[0] / n))
        return [sorted(x) for x in found]


def _runs(places: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """(first, last) of places that follow each other by less than ``gap``."""
    first = last = places[0]
    for p in places[1:]:
        if p - last >= gap:
            yield first, last
            first = p
        last = p
    yield first, last


def _finder(index: Index):
    @F.arrow_udf(_STRUCT)
    def find(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int32()), ("n_words", pa.int32()), ("distance", pa.int32()), ("similarity", pa.float64())]))
        names = [f.name for f in kind.value_type]
        found = pa.array([[dict(zip(names, m)) for m in found] for found in index.find(texts.to_pylist())], kind)
        trim()
        return found

    return find


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "leaks", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``docs`` with ``out``: what each whole text has of the benchmark, an array that is empty where there is nothing.

    An item of n words is found where a part of the text has an edit distance of at most (1 - similarity) * n to it,
    in lower-case words; of several places the best, of equal ones the first. Items without words, null ones
    included, are found nowhere; null and empty texts have nothing. Every row stays. The benchmark is sent to the
    workers in blocks of BLOCK_CHARS characters or so, each with a pass over the texts, so no size of it is too large.
    """
    items = benchmark.select(F.col(f"`{item}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("t"))).first()[0] or 0) / BLOCK_CHARS))
    result = docs.withColumn(out, F.array().cast(_STRUCT))
    for k in range(blocks):
        some = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == k).distinct().collect()
        index = Index(sorted((r.id, words(r.t)) for r in some), similarity, recall)
        result = result.withColumn(out, F.concat(out, _finder(index)(F.col(f"`{text}`"))) if k else _finder(index)(F.col(f"`{text}`")))
    return result
