"""HTML extraction by a recurrent block labeller.

A page is read into its leaf blocks in order. A bidirectional LSTM, in numpy, reads for each block a vector of its tag
path, one of its hashed words and a few numbers, and says how likely the block is main text, in view of the whole page
before and after it. Its weights lie beside this module; ``html_train`` makes them, from made-up pages of whose blocks the
kind is known.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padlake.llm.memory import trim

#: Sizes of a block's vectors: its element, what that stands in, its words, its numbers; cells of the LSTM each way.
OWN, AROUND, HASHED, NUMBERS, CELLS = 64, 160, 48, 11, 20
INPUTS = OWN + AROUND + HASHED + NUMBERS
#: Elements around a block that its path has, itself included; what stands farther out weighs less than a float can tell.
DEPTH = 100
#: Blocks that go through the network, and whose vectors are made, at a time.
ROOM, AT_ONCE = 20_000, 4096
REMEMBERED = 200_000
#: How likely a block of the main text is at least: where made-up pages that training hadn't seen are told best.
LEAST = 0.3
WEIGHTS = Path(__file__).with_name("html_weights.npz")

#: Fixed values of HTML: elements within a line, those that hold nothing, those whose content is no text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template iframe svg textarea select title object".split())
ENDS_ITSELF = frozenset("p li dt dd tr td th option".split())

TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z))""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")
WORD = re.compile(r"[^\W\d_]+")


def blocks(html: str) -> list[tuple[tuple, str, int]]:
    """(path, text, characters in links) of each leaf block that has text, in page order.

    A path has the elements that a block stands in, the nearest first and DEPTH at most; of each the tag and the parts
    of its class, id and role. A page of any depth takes time and memory in proportion to its length.
    """
    found, parts, linked, in_link, at, n = [], [], 0, False, 0, len(html)
    stack: list[tuple] = []
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal parts, linked
        if parts and (text := " ".join(unescape("".join(parts)).split())):
            found.append((tuple(stack[: -DEPTH - 1 : -1]), text, min(linked, len(text))))
        parts, linked = [], 0

    def leave() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    while at < n:
        m = TAG.search(html, at)
        text = html[at : m.start() if m else n]
        if text:
            parts.append(text)
            linked += len(text.strip()) if in_link else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not m[1]
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in SKIPPED:
            parts.append(" ")
            if not m[1] and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                at = end.end() if end else n
            continue
        flush()
        in_link = False
        if m[1]:
            # The end of what isn't open means nothing.
            while opened[tag] > 0 and leave() != tag:
                pass
            continue
        if stack and (stack[-1][0] == "p" or (stack[-1][0] == tag and tag in ENDS_ITSELF)):
            leave()
        if tag not in VOID:
            names = tuple(dict.fromkeys(PART.findall(" ".join("".join(x) for x in NAMES.findall(m[3])).lower()))) if m[3] else ()
            stack.append((tag, *names))
            opened[tag] += 1
    flush()
    return found


class _Vectors:
    """The vectors of blocks, with what recurs remembered up to a bound."""

    def __init__(self):
        self.paths: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Of the element itself, and of all around it, the nearer the heavier."""
        if (got := self.paths.get(path)) is None:
            own, around = np.zeros(OWN, np.float32), np.zeros(AROUND, np.float32)
            for k, names in enumerate(path):
                weight = np.float32(0.8**k)
                for j, t in enumerate(names):
                    h = crc32(f"{'.' * (j > 0)}{t}".encode())
                    for v, w in ((own, 1), (around, weight)) if not k else ((around, weight),):
                        v[h % len(v)] += w * (1 - 2 * (h >> 20 & 1))
                        v[(h >> 10) % len(v)] += w * (1 - 2 * (h >> 21 & 1))
            if len(self.paths) >= REMEMBERED // 20:
                self.paths.clear()
            got = self.paths[path] = own, around
        return got

    def hashed(self, text: str) -> np.ndarray:
        known, ids = self.words, []
        for w in WORD.findall(text.lower()):
            if (h := known.get(w)) is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[w] = h = crc32(w.encode()) % HASHED
            ids.append(h)
        counts = np.bincount(ids, minlength=HASHED).astype(np.float32) if ids else np.zeros(HASHED, np.float32)
        return counts / np.sqrt(1 + (counts**2).sum())

    def of(self, page: list[tuple[tuple, str, int]], first: int = 0, last: int | None = None) -> np.ndarray:
        """Vectors of blocks first..last of a page."""
        some = page[first:last]
        out = np.zeros((len(some), INPUTS), np.float32)
        for k, (path, text, linked) in enumerate(some):
            own, around = self.path(path)
            n = len(text)
            words = text.count(" ") + 1
            out[k] = np.concatenate([own, around, self.hashed(text), [
                np.log1p(n) / 3, np.log1p(words) / 2, linked / n, text[-1] in ".!?…。", min(text.count(","), 20) / words,
                (first + k) / len(page), np.log1p(len(page)) / 4, text[0].isupper(),
                "©" in text, min(sum(c.isdigit() for c in text[:40]), 8) / 8, ":" in text[:40],
            ]])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _reversed(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row of x[pages, blocks, ...] back to front within its length."""
    t = np.arange(x.shape[1])
    at = np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)
    return x[np.arange(len(x))[:, None], at]


@dataclass
class Network:
    """Weights by name: for each way ``wx``, ``wh``, ``b`` of the gates (in, forget, out, cell), then ``out`` and ``bias``."""

    weights: dict[str, np.ndarray]

    def projected(self, x: np.ndarray, way: str) -> np.ndarray:
        return x @ self.weights[f"wx{way}"] + self.weights[f"b{way}"]

    def _way(self, pre: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        w, pages, steps = self.weights, *pre.shape[:2]
        h, c, hs, kept = np.zeros((pages, CELLS), np.float32), np.zeros((pages, CELLS), np.float32), np.zeros((pages, steps, CELLS), np.float32), []
        for t in range(steps):
            z = pre[:, t] + h @ w[f"wh{way}"]
            gates, cell = _sigmoid(z[:, : 3 * CELLS]), np.tanh(z[:, 3 * CELLS :])
            i, f, o = gates[:, :CELLS], gates[:, CELLS : 2 * CELLS], gates[:, 2 * CELLS :]
            if keep:
                kept.append((h, c, i, f, o, cell))
            c = f * c + i * cell
            h = o * np.tanh(c)
            hs[:, t] = h
        return hs, kept

    def forward(self, pre1: np.ndarray, pre2: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """From the projected vectors [pages, blocks, ...] of the blocks, as they stand, for each way."""
        ahead, kept1 = self._way(pre1, "1", keep)
        back, kept2 = self._way(_reversed(pre2, lengths), "2", keep)
        both = np.concatenate([ahead, _reversed(back, lengths)], 2)
        return _sigmoid(both @ self.weights["out"] + self.weights["bias"]), (both, ahead, back, kept1, kept2)

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, (both, ahead, back, kept1, kept2) = self.forward(self.projected(x, "1"), self.projected(x, "2"), lengths, True)
        e = np.where(np.arange(x.shape[1]) < lengths[:, None], p - y, 0).astype(np.float32) / lengths.sum()
        g = {"out": np.einsum("pt,pth->h", e, both), "bias": e.sum(keepdims=True).reshape(1)}
        d = e[:, :, None] * self.weights["out"]
        for way, xs, hs, kept, dh in (("1", x, ahead, kept1, d[:, :, :CELLS]), ("2", _reversed(x, lengths), back, kept2, _reversed(d[:, :, CELLS:], lengths))):
            dz = np.zeros((*x.shape[:2], 4 * CELLS), np.float32)
            h_next, c_next, wh = 0, 0, self.weights[f"wh{way}"]
            g[f"wh{way}"] = np.zeros_like(wh)
            for t in reversed(range(x.shape[1])):
                h, c, i, f, o, cell = kept[t]
                now = np.tanh(f * c + i * cell)
                dh_t = dh[:, t] + h_next
                dc = dh_t * o * (1 - now**2) + c_next
                dz[:, t] = np.concatenate([dc * cell * i * (1 - i), dc * c * f * (1 - f), dh_t * now * o * (1 - o), dc * i * (1 - cell**2)], 1)
                h_next, c_next = dz[:, t] @ wh.T, dc * f
                g[f"wh{way}"] += h.T @ dz[:, t]
            g[f"wx{way}"] = np.einsum("ptd,ptz->dz", xs, dz, optimize=True)
            g[f"b{way}"] = dz.sum((0, 1))
        return g

    def likely(self, pages: list[list], vectors: _Vectors) -> list[np.ndarray]:
        """How likely each block of each page (lists of blocks) is main text; pages of like length go together.

        Of a page only what the gates make of its vectors is held, not the vectors.
        """
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k, x in enumerate(pages) if len(x)), key=lambda k: -len(pages[k]))
        while order:
            longest = len(pages[order[0]])
            some, order = order[: max(1, ROOM // longest)], order[max(1, ROOM // longest) :]
            lengths = np.array([len(pages[k]) for k in some])
            pre = np.zeros((2, len(some), longest, 4 * CELLS), np.float32)
            for row, k in enumerate(some):
                for a in range(0, len(pages[k]), AT_ONCE):
                    x = vectors.of(pages[k], a, a + AT_ONCE)
                    pre[0, row, a : a + len(x)], pre[1, row, a : a + len(x)] = self.projected(x, "1"), self.projected(x, "2")
            p, _ = self.forward(pre[0], pre[1], lengths)
            for k, row in zip(some, p):
                out[k] = row[: len(pages[k])]
        return out


@lru_cache(maxsize=1)
def trained() -> Network:
    """The network whose weights lie in the package."""
    with np.load(WEIGHTS) as stored:
        return Network({name: stored[name].astype(np.float32) for name in stored.files})


def main_text(pages: list[str], net: Network, vectors: _Vectors) -> list[str]:
    read = [blocks(p) for p in pages]
    kept = net.likely(read, vectors)
    return ["\n".join(text for (_, text, _), p in zip(b, ps) if p >= LEAST) for b, ps in zip(read, kept)]


def _extractor(net: Network):
    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors = _Vectors()
        for pages in batches:
            out = []
            for k in range(0, len(pages), 200):
                out += main_text([p or "" for p in pages[k : k + 200].to_pylist()], net, vectors)
            yield pa.array(out, pa.string())
            trim()

    return extract


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` with ``out``: the main text of each whole page, blocks in page order joined by newlines.

    Character references are decoded, white space inside a block is one space. Null and empty pages, and those
    without main text, give an empty text. Pages of any length and depth of nesting take time in proportion. Every row stays; a column named as ``out`` is replaced, others pass.
    """
    return df.withColumn(out, _extractor(trained())(F.col(f"`{html}`")))
