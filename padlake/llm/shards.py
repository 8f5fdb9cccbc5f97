"""What shards of documents tell each other: hashes and counts in blobs, dealt by ranges of the hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Shards whose hashes share a range, so that a shard sends few rows and a range fits a task.
RANGE_SHARDS = 8
#: Parts of a range that are looked at one after another.
SLICES = 8
_SYMBOLS = np.random.default_rng(29).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ROOM = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.multiply.accumulate(x)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of parts of some bytes: of all grams of a size, rolling, modulo 2**64; of any parts, word by word."""

    _up, _down = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        self._words = np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), 0, (1,))

    def grams(self, size: int) -> np.ndarray:
        """Polynomials, which may be equal by construction for unlike grams of many bytes: only to deal by, and to choose."""
        n = len(self.raw)
        if n + 1 > len(Hashes._up):
            Hashes._up, Hashes._down = _powers(_BASE, max(n + 1, _ROOM)), _powers(_INVERSE, max(n + 1, _ROOM))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_SYMBOLS[self.raw] * Hashes._up[:n], out=sums[1:])
        return mixed((sums[size:] - sums[: n + 1 - size]) * Hashes._down[: n + 1 - size])

    def parts(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each part, eight bytes at a time, every step a bijection of what it had so far."""
        size = end - start
        h = mixed(size.astype(np.uint64) + np.uint64(_BASE))
        for k in range(0, int(size.max(initial=0)), 8):
            live = np.flatnonzero(size > k)
            left = np.minimum(size[live] - k, 8).astype(np.uint64)
            word = self._words[start[live] + k] & (~np.uint64(0) >> (np.uint64(64) - left * np.uint64(8)))
            h[live] = mixed((h[live] + np.uint64(_BASE)) ^ mixed(word + np.uint64(k)))
        return h


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def pack(hashes: np.ndarray) -> bytes:
    """Hashes below 2**48, in six bytes each."""
    return blob(hashes.view(np.uint8).reshape(-1, 8)[:, :6])


def unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Of hashes below 2**48, the one of ``ranges`` equal ranges."""
    return ((hashes >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


SENT = "shard int, range int, grams binary, counts binary"
HEARD = "shard int, grams binary, counts binary"


def ranges_for(shards: int) -> int:
    return -(-shards // RANGE_SHARDS)


def sent(shard: int, hashes: np.ndarray, ranges: int) -> pa.Table:
    """A row for each range that some of the hashes are in: the distinct ones, ascending, and how often each is there."""
    grams, counts = np.unique(hashes, return_counts=True)
    edge = np.searchsorted(range_of(grams, ranges), np.arange(ranges + 1))
    rows = np.flatnonzero(np.diff(edge)).tolist()
    return pa.table({
        "shard": pa.array([shard] * len(rows), pa.int32()),
        "range": pa.array(rows, pa.int32()),
        "grams": pa.array([pack(grams[edge[k] : edge[k + 1]]) for k in rows], pa.binary()),
        "counts": pa.array([blob(np.minimum(counts[edge[k] : edge[k + 1]], 255).astype(np.uint8)) for k in rows], pa.binary()),
    })


def find_repeated(key: tuple, table: pa.Table) -> pa.Table:
    """To each shard of a range, those of its hashes that occur more than once in all, and how often; the range is gone through slice by slice."""
    shards, parts = table["shard"].to_pylist(), [unpack(b) for b in table["grams"].to_pylist()]
    counts = [np.frombuffer(b, np.uint8) for b in table["counts"].to_pylist()]
    low, high = int(min(p[0] for p in parts)), int(max(p[-1] for p in parts)) + 1
    kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in parts]
    for k in range(SLICES):
        a, b = (np.uint64(low + (high - low) * x // SLICES) for x in (k, k + 1))
        cuts = [np.searchsorted(p, [a, b]) for p in parts]
        _, where = np.unique(np.concatenate([p[i:j] for p, (i, j) in zip(parts, cuts)]), return_inverse=True)
        total = np.bincount(where, np.concatenate([c[i:j] for c, (i, j) in zip(counts, cuts)]))[where].astype(np.uint32)
        ends = np.cumsum([0, *(j - i for i, j in cuts)])
        for own, p, (i, j), x, y in zip(kept, parts, cuts, ends, ends[1:]):
            often = total[x:y] > 1
            if often.any():
                own.append((p[i:j][often], total[x:y][often]))
    found = [(s, own) for s, own in zip(shards, kept) if own]
    return pa.table({
        "shard": pa.array([s for s, _ in found], pa.int32()),
        "grams": pa.array([b"".join(pack(g) for g, _ in own) for _, own in found], pa.binary()),
        "counts": pa.array([b"".join(blob(n) for _, n in own) for _, own in found], pa.binary()),
    })
