"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse as a byte-to-text state machine.

A merge list has a finite *sufficient lookahead*: once that many symbols have been read beyond a token's end, nothing
that follows can change the token. The encoder therefore reads a piece through a window, emits the tokens that are
stable, and drops what they cover, so that its memory doesn't depend on the length of the text. Pieces that are no longer
than a word need no window: the new ones of some texts are merged side by side, and remembered.
"""

from __future__ import annotations

import codecs
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padlake.llm.memory import trim

#: Fixed values of the byte-level format: the pattern that cuts text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Symbols of a piece that are looked at together beyond the lookahead; shorter pieces are merged at once.
WINDOW = 1024
#: Characters that are cut into pieces at a time.
SEGMENT = 1 << 16
#: Pieces whose tokens are remembered by a worker, about: those met while the last half of them, or the half before, was filled.
REMEMBERED = 150_000
#: Characters of a piece that is remembered, at most.
SHORT = 64
#: Pieces that are looked up together. Where FEW or more of them are new, those are merged side by side in arrays of so many CELLS at most.
TOGETHER, FEW, CELLS = 1 << 16, 64, 1 << 18
#: Stand for no symbol and no merge; ids are less than 2**20.
NO_ID, NO_RANK = (1 << 20) - 1, (1 << 31) - 1
#: Ids that the decoder takes at a time.
BLOCK = 1 << 14


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible Latin-1, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in seen)}
    return [chr(rest.get(b, b)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols after a boundary that decide about it, for any text.

    Let two texts agree up to some place. Going through the merges in order, the leftmost place at which the two
    differ moves only if a merge (u, v) applies in one text with u left of it and v right of it, and then by len(u).
    For the next such merge, u has to be on the left spine of its right side. The longest chain of that kind, by
    rising rank, bounds how far a difference ever travels.
    """
    far: dict[str, int] = {}
    first: dict[str, str] = {}
    longest = 0
    for u, v in merges:
        x, t = 0, v
        while t is not None:
            x, t = max(x, far.get(t, 0)), first.get(t)
        far[u] = max(far.get(u, 0), len(u) + x)
        longest = max(longest, far[u])
        first.setdefault(u + v, u)
    return longest


class Transducer(dict):
    """Text to ids and back, for one vocabulary file. As a dict: the remembered ids of pieces, as int32 bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.base = [vocab[c] for c in symbols]
        self.rank = {vocab[u] << 20 | vocab[v]: (k, vocab[u + v]) for k, (u, v) in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of: dict[int, bytes] = {k: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, k in (vocab | self.special).items()}
        self.width = {k: len(b) for k, b in self.bytes_of.items()}
        self.widths = np.array([self.width.get(k, -1) for k in range(max(self.width) + 1)], np.int64)  # -1: an id of nothing, which is an error
        self.starts = np.cumsum(self.widths.clip(0)) - self.widths.clip(0)
        self.pool = np.frombuffer(b"".join(self.bytes_of[k] for k in sorted(self.bytes_of)), np.uint8)
        self.before: dict[str, bytes] = {}  # remembered longer ago
        self._arrays(merges, vocab)
        self.cut = regex.compile(PIECES).findall
        self.added = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))

    def _arrays(self, merges: list[tuple[str, str]], vocab: dict[str, int]) -> None:
        """What many pieces are merged by: the rank of each pair of bytes, and a hash table of all pairs."""
        self.bases = np.array(self.base, np.int32)
        self.made = np.array([vocab[u + v] for u, v in merges], np.int32)
        self.bits = max(4, (4 * len(merges)).bit_length())
        keys, places = [-1] * (1 << self.bits), [NO_RANK] * (1 << self.bits)
        for key, (k, _) in self.rank.items():
            at = key * 0x9E3779B97F4A7C15 % (1 << 64) >> 64 - self.bits
            while keys[at] >= 0:
                at = at + 1 & (1 << self.bits) - 1
            keys[at], places[at] = key, k
        self.keys, self.places = np.array(keys, np.int64), np.array(places, np.int32)
        self.pairs = self.ranks(np.repeat(self.bases, 256), np.tile(self.bases, 256))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each two symbols, NO_RANK where there is none."""
        key = left.astype(np.int64) << 20 | right
        at = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)
        met = self.keys[at]
        out = np.where(met == key, self.places[at], np.int32(NO_RANK))
        open_ = np.flatnonzero((met != key) & (met >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & (1 << self.bits) - 1
            met = self.keys[at[open_]]
            hit = met == key[open_]
            out[open_[hit]] = self.places[at[open_[hit]]]
            open_ = open_[~hit & (met >= 0)]
        return out

    def learn(self, wanted: set[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't remembered; the short ones are from now on."""
        found = {p: self.before[p] for p in wanted.intersection(self.before)}
        new = sorted((p for p in wanted if p not in found and len(p) <= SHORT), key=len, reverse=True)
        if len(new) < FEW:
            found.update((p, self.alone(p)) for p in new)
            new = []
        at = 0
        while at < len(new):
            some = new[at : at + CELLS // (4 * len(new[at]) + 2)]
            found.update(zip(some, self.merged_together([p.encode() for p in some])))
            at += len(some)
        if len(self) + len(found) > REMEMBERED // 2:
            self.before = dict(self)
            self.clear()
        self.update(found)
        found.update((p, self.alone(p)) for p in wanted if len(p) > SHORT)
        return found

    def alone(self, piece: str) -> bytes:
        return array("i", self.tokens(piece.encode())).tobytes()

    def merged_together(self, pieces: list[bytes]) -> list[bytes]:
        """The merge list applied to each piece, as int32 bytes: in every round each piece gets its best merge, the leftmost of equal ones."""
        n, width = len(pieces), max(map(len, pieces)) + 2  # a column of no symbol on either side
        read = np.frombuffer(b"".join(p.ljust(width - 2, b"\0") for p in pieces), np.uint8).reshape(n, width - 2)
        sizes = np.fromiter(map(len, pieces), np.int64, n)[:, None]
        column = np.arange(width - 2)
        ids, rank = np.full((n, width), NO_ID, np.int32), np.full((n, width), NO_RANK, np.int32)
        ids[:, 1:-1] = np.where(column < sizes, self.bases[read], np.int32(NO_ID))
        both = read[:, :-1].astype(np.int32) << 8 | read[:, 1:]
        rank[:, 1:-2] = np.where(column[1:] < sizes, self.pairs[both], np.int32(NO_RANK))
        flat, place = ids.reshape(-1), rank.reshape(-1)
        after, before = np.arange(1, n * width + 1), np.arange(-1, n * width - 1)
        rows = np.arange(n)
        while len(rows):
            here = rank[rows]
            k = here.argmin(axis=1)
            best = here[np.arange(len(rows)), k]
            some = best < NO_RANK
            rows, at, best = rows[some], (rows * width + k)[some], best[some]
            gone, new, last = after[at], self.made[best], before[at]
            end = after[gone]
            flat[at], flat[gone], place[gone] = new, NO_ID, NO_RANK
            after[at], before[end] = end, at
            place[at], place[last] = self.ranks(new, flat[end]), self.ranks(flat[last], new)
        left = ids != NO_ID
        ends, kept = np.cumsum(left.sum(axis=1)) * 4, ids[left].tobytes()
        return [kept[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def tokens(self, piece: bytes) -> Iterator[int]:
        """The ids of one piece, each as soon as it is stable."""
        at, held = 0, []
        while True:
            take = WINDOW + self.lookahead - sum(map(self.width.__getitem__, held))
            more = piece[at : at + max(take, 1)]
            at += len(more)
            # What was read but not emitted is merged anew from its bytes: an unstable token may not survive.
            read = b"".join(map(self.bytes_of.__getitem__, held)) + more
            ids = self.merged([self.base[b] for b in read])
            if at >= len(piece):
                yield from ids
                return
            room, k = len(read) - self.lookahead, 0
            for k, t in enumerate(ids):
                room -= self.width[t]
                if room < 0:
                    break
                yield t
            held = ids[k:]

    def merged(self, ids: list[int]) -> list[int]:
        """The merge list applied to all of ids."""
        rank = self.rank.get
        if len(ids) > 48:
            return self._merged_by_heap(ids)
        none = (1 << 30, 0)
        pairs = [rank(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            k = pairs.index(best)
            ids[k : k + 2] = [best[1]]
            del pairs[k]
            if k:
                pairs[k - 1] = rank(ids[k - 1] << 20 | ids[k], none)
            if k < len(pairs):
                pairs[k] = rank(ids[k] << 20 | ids[k + 1], none)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        rank = self.rank.get
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := rank(ids[k] << 20 | ids[k + 1]))]
        heapq.heapify(heap)
        while heap:
            _, new, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = new, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
                if r := rank(new << 20 | ids[after[j]]):
                    heapq.heappush(heap, (*r, k, new, ids[after[j]]))
            if (i := before[k]) >= 0 and (r := rank(ids[i] << 20 | new)):
                heapq.heappush(heap, (*r, i, ids[i], new))
        return [t for t in ids if t >= 0]

    def segments(self, text: str) -> Iterator[str]:
        """The text, cut where white space follows something else: pieces end there in any text."""
        at, n = 0, len(text)
        while n - at > SEGMENT:
            end = at + SEGMENT
            while end < n and not (text[end].isspace() and not text[end - 1].isspace()):
                end += 1
            yield text[at:end]
            at = end
        yield text[at:] if at else text

    def runs(self, text: str) -> Iterator[tuple[list[str], bytes]]:
        """The pieces of a text, segment by segment, each with the id of the added token after it, as int32 bytes, if there is one."""
        if not self.special or not any(s in text for s in self.special):
            yield from ((self.cut(s), b"") for s in self.segments(text))
            return
        found = [*self.added.findall(text), None]
        for part, s in zip(self.added.splititer(text), found):
            yield from ((self.cut(x), b"") for x in self.segments(part))
            if s:
                yield [], np.int32(self.special[s]).tobytes()

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as int32 bytes; the strings of added tokens are those tokens."""
        done: list[list[bytes]] = []
        held: list[tuple[int, list[bytes | None], list[str], bytes]] = []
        n, wanted = 0, set()

        def release() -> None:
            found = self.learn(wanted)
            for k, ids, new, token in held:
                rest = map(found.__getitem__, new)
                done[k] += [b"".join([next(rest) if x is None else x for x in ids] if new else ids), token]
            held.clear()
            wanted.clear()

        for k, text in enumerate(texts):
            done.append([])
            for pieces, token in self.runs(text):
                ids = list(map(self.get, pieces))
                new = [p for p, x in zip(pieces, ids) if x is None] if None in ids else []
                wanted.update(new)
                held.append((k, ids, new, token))
                n += len(pieces) + 1
                if n >= TOGETHER:
                    release()
                    n = 0
        release()
        return [b"".join(x) for x in done]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def spelled(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens, one after another."""
        if ids.min() < 0:
            raise IndexError("an id below 0")
        widths = self.widths[ids]
        ends = widths.cumsum()
        return self.pool[np.repeat(self.starts[ids] - ends + widths, widths) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: Sequence[int] | np.ndarray) -> str:
        """The text of ids: the bytes of a block of tokens go through a UTF-8 state machine, which holds at most an unfinished character."""
        machine, ids = codecs.getincrementaldecoder("utf-8")("replace"), np.asarray(ids)
        blocks = [machine.decode(self.spelled(ids[k : k + BLOCK])) for k in range(0, len(ids), BLOCK)]
        return "".join([*blocks, machine.decode(b"", True)])


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _encode(path: str):
    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = transducer(path)
        for texts in batches:
            ids = t.encode_all(x.as_py() or "" for x in texts)
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            trim()

    return encode


def _decode(path: str):
    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = transducer(path)
        for lists in batches:
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            yield pa.array([t.decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.string())
            trim()

    return decode


def _both(path: str):
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("text", pa.string())])

    @F.arrow_udf("struct<ids:array<int>,text:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = transducer(path)
        for texts in batches:
            ids = t.encode_all(x.as_py() or "" for x in texts)
            decoded = pa.array([t.decode(np.frombuffer(x, np.int32)) for x in ids], pa.string())
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32))), decoded], fields=list(kind))
            trim()

    return both


def encode(df: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``df`` with ``out``: the ids of the whole text, an array that is empty for a null or empty text.

    No row is dropped or merged; repeated rows get equal ids. Other columns pass unseen, whatever their names; one
    that is named as ``out`` is replaced.
    """
    return df.withColumn(out, _encode(path)(F.col(f"`{text}`")))


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the text of ``ids``; null and empty arrays give an empty text. Special tokens are written out."""
    return df.withColumn(out, _decode(path)(F.col(f"`{ids}`")))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``ids`` and ``out``: encode and then decode, in one pass of one worker."""
    own = max(df.columns, key=len) + "_"  # a name that no column has
    whole = df.select("*", _both(path)(F.col(f"`{text}`")).alias(own))
    return whole.withColumns({ids: F.col(f"`{own}`")["ids"], out: F.col(f"`{own}`")["text"]}).drop(own)


def ids_digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids, joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)
