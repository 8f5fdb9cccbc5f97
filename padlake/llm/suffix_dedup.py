"""Removal of repeated byte strings by suffix arrays.

Every string of ``length`` bytes picks an *anchor* in itself, the least of its ``GRAM``-byte grams by a hash. Equal
strings pick the same one, so that strings are only compared with those of the same anchor gram:

1. Documents are dealt to shards of a bounded number of bytes; each sends the hashes of its anchors, and hears which
   of them other documents have too.
2. For those, shards send *contexts*, the bytes under the strings that picked an anchor, equal ones once. Contexts are
   dealt by gram; each such shard sorts the suffixes of its contexts by Larsson and Sadakane's refinement, takes common
   prefixes by Kasai's rule, and so finds the smallest document that has each string.
3. The answers go back to the documents' shards, which find their strings in them by binary search.

Everything that is sent grows with the documents and is dealt by hash; a shard sends what all its documents share once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padlake.llm.memory import trimmed
from padlake.llm.shards import HEARD, SENT, Hashes, blob, find_repeated, mixed, pack, range_of, ranges_for, sent, unpack

LENGTH, GRAM = 50, 20
#: Bytes of text in a shard, or one document; strings that are looked at together.
SHARD_BYTES, PIECE = 6 << 20, 1 << 19
#: An anchor that more documents have is hot: its strings are dealt one by one.
HOT = 1 << 16
_PLACE = np.uint64((1 << 24) - 1)
def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Of each run of ``width`` values."""
    done = 1
    while done * 2 <= width:
        v = np.minimum(v[:-done], v[done:])
        done *= 2
    rest = width - done
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


@dataclass
class _Piece:
    """Texts laid end to end, and the runs of strings that picked one anchor: ``owner`` is the text, strings begin at
    low..high, counted in the piece; ``gram`` is the anchor's hash, ``base`` where the piece's texts begin in themselves."""

    raw: np.ndarray
    hashes: Hashes
    owner: np.ndarray
    low: np.ndarray
    high: np.ndarray
    gram: np.ndarray
    starts: np.ndarray
    texts: np.ndarray
    base: np.ndarray


def _pieces(texts: list[bytes], length: int) -> Iterator[_Piece]:
    """All strings of all texts, each in one piece; a long text is cut into pieces that overlap by ``length`` - 1 bytes."""
    held, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), PIECE):
            part = t[at : at + PIECE + length - 1]
            if held and size + len(part) > PIECE + length:
                yield _piece(held, length)
                held, size = [], 0
            held.append((k, at, part))
            size += len(part)
    if held:
        yield _piece(held, length)


def _piece(parts: list[tuple[int, int, bytes]], length: int) -> _Piece:
    raw = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    sizes = np.array([len(p) for _, _, p in parts])
    ends = np.cumsum(sizes)
    hashes = Hashes(raw)
    gram = min(GRAM, length)
    grams = hashes.grams(gram)
    keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    picked = (_least(keys, length - gram + 1) & _PLACE).astype(np.int64)
    inside = np.ones(len(picked), bool)
    for e in ends[:-1]:
        inside[max(0, e - length + 1) : e] = False
    edge = np.flatnonzero((picked[1:] != picked[:-1]) | (inside[1:] != inside[:-1])) + 1
    low, high = np.concatenate([[0], edge]), np.concatenate([edge - 1, [len(picked) - 1]])
    low, high = low[inside[low]], high[inside[low]]
    owner = np.searchsorted(ends, low, "right")
    return _Piece(raw, hashes, owner, low, high, mixed(grams[picked[low]] ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16), ends - sizes, np.array([k for k, _, _ in parts]), np.array([a for _, a, _ in parts]))


def _runs(p: _Piece, only: np.ndarray | None, hot: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, owner, gram, hash) of the runs ``only``, or all; a run of a hot anchor is taken apart into its strings.

    Each string of a hot anchor has a gram of its own, so that the strings of a passage that many documents share,
    and those across its ends, are dealt to many shards.
    """
    low, high, owner, gram = (x if only is None else x[only] for x in (p.low, p.high, p.owner, p.gram))
    is_hot = _found(gram, hot)
    if is_hot.any():
        n = np.where(is_hot, high - low + 1, 1)
        at = np.repeat(np.arange(len(low)), n)
        step = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        low, high = low[at] + step, np.where(is_hot[at], low[at] + step, high[at])
        owner, gram, is_hot = owner[at], gram[at], is_hot[at]
    h = p.hashes.parts(low, high + length)
    if is_hot.any():
        gram = np.where(is_hot, mixed(h ^ gram) >> np.uint64(16), gram)
    return low, high, owner, gram, h


def _found(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in an ascending array."""
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values if len(among) else np.zeros(len(values), bool)


# Larsson and Sadakane's order, Kasai's common prefixes


def suffix_order(raw: np.ndarray) -> np.ndarray:
    """The suffix array of raw; the end is smaller than any byte.

    Groups that agree in their first h bytes are refined by the group of what follows these h bytes; only groups of
    more than one are looked at again, and h doubles.
    """
    n = len(raw)
    padded = np.concatenate([raw.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(7):  # nine bits for each byte and the end
        key = key << np.uint64(9) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    group = np.empty(n + 1, np.int64)  # a group's number is the place of its first member, plus one
    group[n] = 0
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    group[order] = first + 1
    alone = new & np.concatenate([new[1:], [True]])
    open_places, h = np.flatnonzero(~alone), 7
    while len(open_places):
        members = order[open_places]
        own, after = group[members], group[np.minimum(members + h, n)]
        by = np.lexsort((after, own))
        members, own, after = members[by], own[by], after[by]
        order[open_places] = members
        new = np.ones(len(members), bool)
        new[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
        group[members] = np.maximum.accumulate(np.where(new, open_places, 0)) + 1
        open_places = open_places[~(new & np.concatenate([new[1:], [True]]))]
        h *= 2
    return order


def common_prefixes(raw: np.ndarray, order: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """For each place of ``order`` the bytes that its suffix has in common with the one before, ``most`` at most.

    By Kasai's rule, a suffix has at least one byte less in common with its predecessor than the suffix one byte
    longer had with its own. The parts that begin at ``starts`` go through the rule side by side, a word at a time.
    """
    n = len(raw)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    before = np.where(rank > 0, order[rank - 1], -1)
    padded = np.concatenate([raw, np.zeros(most + 16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    word = np.ascontiguousarray(words[: n + most + 1]).view("<u8").ravel()
    sizes = np.diff(np.concatenate([starts, [n]]))
    common, h = np.zeros(n, np.int64), np.zeros(len(starts), np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by_size], sizes[by_size]
    for t in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -t, "left"))
        at = starts[:live] + t
        got, prior = np.maximum(h[:live] - 1, 0), before[at]
        got[prior < 0] = 0
        todo = np.flatnonzero((prior >= 0) & (got < most))
        while len(todo):
            a, b = at[todo] + got[todo], prior[todo] + got[todo]
            x = word[a] ^ word[b]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 8, (np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64))
            same = np.minimum(same, n - np.maximum(a, b))
            got[todo] += same
            todo = todo[(same == 8) & (got[todo] < most)]
        h[:live] = np.minimum(got, most)
        common[at] = h[:live]
    return common[order]


def smallest_owner(contexts: list[bytes], owner: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context and each string of ``length`` bytes in it, the smallest owner of a context that has the string."""
    if not contexts:
        return []
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    starts = np.cumsum(sizes) - sizes
    order = suffix_order(raw)
    prefix = common_prefixes(raw, order, starts, length)
    part = np.repeat(np.arange(len(contexts)), sizes)
    whole = np.arange(len(raw)) + length <= (starts + sizes)[part]
    # Common prefixes of neighbours that are whole strings: the least of those in between.
    cut = np.cumsum(prefix < length)
    places = np.flatnonzero(whole[order])
    members, group = order[places], cut[places]
    new = np.ones(len(places), bool)
    new[1:] = group[1:] != group[:-1]
    least = np.minimum.reduceat(owner[part[members]], np.flatnonzero(new)) if len(places) else np.zeros(0, np.int64)
    found = np.full(len(raw), np.iinfo(np.int64).max)
    found[members] = least[np.cumsum(new) - 1]
    return [found[s : s + n - length + 1] for s, n in zip(starts.tolist(), sizes.tolist())]


# The steps between shards


def _texts(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts, documents and whether the document has a number; rows in an order that doesn't depend on how they came."""
    rows = sorted(((x is None, x or 0, (t or "").encode("utf-8", "replace")) for x, t in zip(table["doc"].to_pylist(), table["text"].to_pylist())))
    return [r[2] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([not r[0] for r in rows], bool)


def _send_anchors(length: int, ranges: int):
    def send(key: tuple, table: pa.Table) -> pa.Table:
        texts, doc, numbered = _texts(table)
        texts = [t if ok else b"" for t, ok in zip(texts, numbered)]
        found = [np.zeros(0, np.uint64)]
        for p in _pieces(texts, length):
            order = np.lexsort((p.gram, p.texts[p.owner]))
            g, o = p.gram[order], p.texts[p.owner][order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (doc[o[1:]] != doc[o[:-1]])
            found.append(g[new])
        return sent(key[0].as_py(), np.concatenate(found), ranges)

    return send


def _distinct(hashes: np.ndarray, grams: np.ndarray, sizes: np.ndarray, body) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): the first context of each of the distinct ones, and for each context which of those it is; equal hashes are looked into."""
    order = np.lexsort((sizes, hashes, grams))
    new = np.ones(len(order), bool)
    for column in (hashes, grams, sizes):
        if column is hashes:
            new[1:] = column[order][1:] != column[order][:-1]
        else:
            new[1:] |= column[order][1:] != column[order][:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new].tolist()
    others: dict[tuple[int, bytes], int] = {}
    for i in order[~new].tolist():
        if (b := body(i)) != body(first[which[i]]):
            k = others.setdefault((int(which[i]), b), len(first))
            if k == len(first):
                first.append(i)
            which[i] = k
    return np.array(first, np.int64), which


_CONTEXTS = "shard int, range int, hot binary, bodies binary, sizes binary, grams binary, hashes binary, least binary, most binary"


def _send_contexts(length: int, ranges: int):
    def send(key: tuple, table: pa.Table, repeated: pa.Table) -> pa.Table:
        often = np.concatenate([np.zeros(0, np.uint64), *(unpack(b) for b in repeated["grams"].to_pylist())])
        counts = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(b, np.uint32) for b in repeated["counts"].to_pylist())])
        hot = np.sort(often[counts > HOT])
        often = np.sort(often)
        texts, doc, numbered = _texts(table) if len(often) else ([], np.zeros(0, np.int64), np.zeros(0, bool))
        texts = [t if ok else b"" for t, ok in zip(texts, numbered)]
        hashes, grams, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        known: dict[int, bytes] = {}
        for p in _pieces(texts, length):
            low, high, owner, gram, h = _runs(p, np.flatnonzero(_found(p.gram, often)), hot, length)
            end = high + length
            hashes.append(h)
            grams.append(gram)
            owners.append(doc[p.texts[owner]])
            raw = p.raw.tobytes()
            for x, a, b in zip(h.tolist(), low.tolist(), end.tolist()):
                if known.setdefault(x, body := raw[a:b]) != body:
                    raise RuntimeError("two contexts of a shard have one hash")
        h, g, o = np.concatenate(hashes), np.concatenate(grams), np.concatenate(owners)
        order = np.lexsort((o, h))
        h, g, o = h[order], g[order], o[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        least, most, h, g = o[first], o[np.concatenate([first[1:], [len(o)]]) - 1] if len(first) else o[first], h[first], g[first]
        bodies = [known[x] for x in h.tolist()]
        order = np.lexsort((h, g))
        r = range_of(g[order], ranges)
        edge = np.searchsorted(r, np.arange(ranges + 1))
        rows = np.flatnonzero(np.diff(edge)).tolist()
        some = [order[edge[k] : edge[k + 1]] for k in rows]
        return pa.table({
            "shard": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "range": pa.array(rows, pa.int32()),
            "hot": pa.array([pack(hot) if not k and len(hot) else b"" for k in range(len(rows))], pa.binary()),
            "bodies": pa.array([pa.compress(b"".join(bodies[i] for i in x.tolist()), "zstd", asbytes=True) for x in some], pa.binary()),
            "sizes": pa.array([blob(np.array([len(bodies[i]) for i in x.tolist()], np.uint16)) for x in some], pa.binary()),
            **{name: pa.array([blob(v[x]) for x in some], pa.binary()) for name, v in (("grams", g), ("hashes", h), ("least", least), ("most", most))},
        })

    return send


def _answer(length: int):
    def answer(key: tuple, table: pa.Table) -> pa.Table:
        joined = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        counts = np.array([len(b) // 8 for b in table["hashes"].to_pylist()])
        shard = np.repeat(np.array(table["shard"].to_pylist(), np.int64), counts)
        sizes, grams, hashes, least, most = joined("sizes", np.uint16).astype(np.int64), joined("grams", np.uint64), joined("hashes", np.uint64), joined("least", np.int64), joined("most", np.int64)
        packed = zip(table["bodies"].to_pylist(), table["sizes"].to_pylist())
        bodies = b"".join(pa.decompress(b, int(np.frombuffer(n, np.uint16).sum()), "zstd", asbytes=True) for b, n in packed)
        ends = np.cumsum(sizes)
        # Contexts that several shards have, byte for byte, are one, of their smallest document.
        first, which = _distinct(hashes, grams, sizes, lambda i: bodies[ends[i] - sizes[i] : ends[i]])
        owner = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(owner, which, least)
        _, at, per_gram = np.unique(grams[first], return_inverse=True, return_counts=True)
        several = np.flatnonzero(per_gram[at] > 1)
        found = smallest_owner([bodies[ends[i] - sizes[i] : ends[i]] for i in first[several].tolist()], owner[several], length)
        # Runs of strings of one context with the same smallest owner; a context whose gram no other has is one run.
        run_of, run_low, run_high, run_least = [np.setdiff1d(np.arange(len(first)), several)], [], [], []
        alone = run_of[0]
        run_low.append(np.zeros(len(alone), np.int64))
        run_high.append(sizes[first[alone]] - length)
        run_least.append(owner[alone])
        if len(several):
            n = np.array([len(x) for x in found])
            flat, part = np.concatenate(found), np.repeat(several, n)
            begin = np.repeat(np.cumsum(n) - n, n)
            new = np.ones(len(flat), bool)
            new[1:] = (flat[1:] != flat[:-1]) | (part[1:] != part[:-1])
            edge = np.flatnonzero(new)
            run_of.append(part[edge])
            run_low.append(edge - begin[edge])
            run_high.append(np.concatenate([edge[1:], [len(flat)]]) - 1 - begin[edge])
            run_least.append(flat[edge])
        run_of, run_low, run_high, run_least = map(np.concatenate, (run_of, run_low, run_high, run_least))
        order = np.argsort(run_of, kind="stable")
        run_of, run_low, run_high, run_least = run_of[order], run_low[order], run_high[order], run_least[order]
        a, b = np.searchsorted(run_of, which, "left"), np.searchsorted(run_of, which, "right")
        rows = np.repeat(np.arange(len(which)), b - a)
        runs = np.arange(len(rows)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
        told = run_least[runs] < most[rows]
        rows, runs = rows[told], runs[told]
        hot = {s: b for s, b in zip(table["shard"].to_pylist(), table["hot"].to_pylist()) if b}
        to = np.unique(np.concatenate([shard[rows], np.array([*hot], np.int64)]))
        mine = [np.flatnonzero(shard[rows] == s) for s in to.tolist()]
        return pa.table({
            "shard": pa.array(to, pa.int32()),
            "hot": pa.array([hot.get(s, b"") for s in to.tolist()], pa.binary()),
            "hashes": pa.array([blob(hashes[rows[m]]) for m in mine], pa.binary()),
            "low": pa.array([blob(run_low[runs[m]].astype(np.uint16)) for m in mine], pa.binary()),
            "high": pa.array([blob(run_high[runs[m]].astype(np.uint16)) for m in mine], pa.binary()),
            "least": pa.array([blob(run_least[runs[m]]) for m in mine], pa.binary()),
        })

    return answer


def _remove(length: int):
    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        texts, doc, numbered = _texts(table)
        joined = lambda name, kind: np.frombuffer(b"".join(answers[name].to_pylist()), kind)
        hashes, low, high, least = joined("hashes", np.uint64), joined("low", np.uint16).astype(np.int64), joined("high", np.uint16).astype(np.int64), joined("least", np.int64)
        order = np.argsort(hashes, kind="stable")
        hashes, low, high, least = hashes[order], low[order], high[order], least[order]
        hot = np.sort(np.concatenate([np.zeros(0, np.uint64), *map(unpack, answers["hot"].to_pylist())]))
        spans: dict[int, list[np.ndarray]] = {}
        for p in _pieces([t if ok else b"" for t, ok in zip(texts, numbered)], length) if len(hashes) else ():
            first, _, owner, _, h = _runs(p, None, hot, length)
            a, b = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            row = np.repeat(np.arange(len(h)), b - a)
            run = np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
            part = owner[row]
            text = p.texts[part]
            gone = least[run] < doc[text]
            row, run, part, text = row[gone], run[gone], part[gone], text[gone]
            shift = p.base[part] - p.starts[part]
            begin, end = first[row] + low[run] + shift, first[row] + high[run] + length + shift
            edge = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(text)]):
                spans.setdefault(int(text[i]), []).append(np.stack([begin[i:j], end[i:j]]))
        out = []
        for k, t in enumerate(texts):
            merged, kept, at = [], [], 0
            if k in spans:
                begin, end = np.concatenate(spans[k], 1)
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
                merged = list(zip(begin[new].tolist(), end[np.concatenate([new[1:], [len(end)]]) - 1].tolist()))
            for a, b in merged:
                kept.append(t[at:a])
                at = b
            out.append((int(doc[k]) if numbered[k] else None, len(t), merged, b"".join([*kept, t[at:]])))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({
            "doc": pa.array([x[0] for x in out], pa.int64()),
            "n_bytes": pa.array([x[1] for x in out], pa.int64()),
            "spans": pa.array([[{"start": a, "end": b} for a, b in x[2]] for x in out], span),
            "kept": pa.array([x[3] for x in out], pa.binary()),
        })

    return remove


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, n_bytes, spans, kept) for each row: the maximal runs of bytes that are removed, as [start, end), and the bytes that stay.

    A byte goes if a string of ``length`` bytes over it also begins in a document of a smaller key; strings are those
    of the input, never across documents. Null and empty texts, and texts shorter than ``length``, lose nothing. Rows
    of one key are documents of that key; none of them takes from another. Rows without a key neither lose nor take.
    """
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    docs = docs.withColumn("shard", F.pmod(F.xxhash64("doc", "text"), F.lit(shards)).cast("int"))
    dealt = docs.groupBy("shard")
    anchors = dealt.applyInArrow(trimmed(_send_anchors(length, ranges_for(shards))), SENT)
    repeated = anchors.groupBy("range").applyInArrow(trimmed(find_repeated), HEARD)
    contexts = dealt.cogroup(repeated.groupBy("shard")).applyInArrow(trimmed(_send_contexts(length, shards)), _CONTEXTS)
    answers = contexts.groupBy("range").applyInArrow(trimmed(_answer(length)), "shard int, hot binary, hashes binary, low binary, high binary, least binary")
    done = dealt.cogroup(answers.groupBy("shard")).applyInArrow(trimmed(_remove(length)), "doc long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return done.withColumnRenamed("doc", key)


def oracle(table: str = "documents", length: int = LENGTH) -> str:
    """DuckDB SQL for doc_id, n_bytes, n_removed, n_spans, kept_sha256 of a table of unique ids; it groups all strings."""
    return f"""
    WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM {table}),
    strings AS (
        SELECT doc_id, i, substr(hx, 2 * i + 1, {2 * length}) AS w
        FROM (SELECT doc_id, hx, unnest(range(greatest(length(hx) // 2 - {length - 1}, 0))) AS i FROM docs)),
    first AS (SELECT w, min(doc_id) AS d FROM strings GROUP BY w),
    again AS (SELECT s.doc_id, s.i FROM strings s JOIN first f ON s.w = f.w WHERE f.d < s.doc_id),
    marked AS (SELECT doc_id, i, (coalesce(i - lag(i) OVER w, {length + 1}) > {length})::INT AS new FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
    spans AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS b FROM numbered GROUP BY doc_id, run),
    around AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
    parts AS (
        SELECT s.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(hx, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last
        FROM around s JOIN docs d ON d.doc_id = s.doc_id GROUP BY s.doc_id)
    SELECT d.doc_id, (length(hx) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
           sha256(unhex(coalesce(head, '') || substr(hx, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM docs d LEFT JOIN parts p ON p.doc_id = d.doc_id"""
