"""N-gram Jaccard join, size-aware: fixed-size subsets for small sets, inverted lists for large ones.

Two small sets are alike if they share a subset of a size that follows from theirs; all such subsets are enumerated and
equal ones found. For large sets that would be too many. Their elements are hashed into blocks, the entries of inverted
lists: sets that differ in k elements share all but k of m blocks, so that of each set's blocks, the rarest first, one
of the first k + 1 is shared. The boundary between small and large lies where a set's subsets would cost more than its
lists.

What shares an entry is joined exactly, family by family (sets connected by entries), in blocks of bounded size, and
never as rows of pairs: a task returns a forest of the links it finds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padlake.llm.graph import components, saved
from padlake.llm.memory import trimmed
from padlake.llm.shards import HEARD, SENT, blob, find_repeated, mixed, ranges_for, sent, unpack

#: Bytes of text in a shard; of a text that are cut into words at a time.
SHARD_BYTES, PIECE = 6 << 20, 1 << 19
#: A scheme of blocks serves sets whose sizes differ by this factor; it has so many more blocks than differences.
SPREAD, SPARE = 1.5, 0.34
#: What an entry of a list costs against a subset, for it has to be verified.
LIST_COST = 8
#: Sets, and their elements, that one side of a block of a family has at most or so; elements of the families that share a task.
FAMILY_ROWS, FAMILY_ELEMENTS, BIN_ELEMENTS = 512, 1 << 18, 1 << 17
#: Copies of a row, on average, beyond which a family is first looked at element by element; elements of a shard of that.
REFINED, SHARD_ELEMENTS = 6, 1 << 19
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Long words whose hashes a worker remembers, and how long they may be.
REMEMBERED, LONG = 200_000, 40
WHITE = re.compile(rb"[\x09-\x0d ]")


# Sets


class _Words(dict):
    """Hashes of long words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of its words, in order: runs of anything but white space (bytes 9 to 13 and 32), A-Z lower-cased.

    Words of up to seven bytes are told apart by those bytes, longer ones by 64 bits of BLAKE2b.
    """
    text = text.lower()
    raw = np.frombuffer(text + b"\n" * 8, np.uint8)
    white = _WHITE[raw]
    change = np.flatnonzero(white[1:] != white[:-1]) + 1
    bounds = change if white[0] else np.concatenate([[0], change])
    first, last = bounds[0::2], bounds[1::2]
    first = first[: len(last)]
    size = last - first
    short = np.minimum(size, 7).astype(np.uint64) * np.uint64(8)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    found = mixed(eight[first] & ((np.uint64(1) << short) - np.uint64(1)) | short << np.uint64(53))
    long = np.flatnonzero(size > 7)
    if len(long):
        found[long] = np.fromiter(map(_words.__getitem__, [text[x:y] for x, y in zip(first[long].tolist(), last[long].tolist())]), np.uint64, len(long))
    return found, first


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the ascending distinct hashes of its n-word shingles; of all its words if it has fewer; none without words."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        if len(texts[at]) > PIECE:
            out.append(_set_of(np.concatenate([word_hashes(part)[0] for part in _parts(texts[at])]), n))
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE):
            size += len(texts[end]) + 1
            end += 1
        words, places = word_hashes(b"\n".join(texts[at:end]))
        edges = np.searchsorted(places, np.cumsum([0, *(len(t) + 1 for t in texts[at:end])])).tolist()
        out += [_set_of(words[a:b], n) for a, b in zip(edges, edges[1:])]
        at = end
    return out


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text, cut at white space."""
    at = 0
    while at < len(text):
        end = WHITE.search(text, at + PIECE)
        yield text[at : end.start() if end else len(text)]
        at = end.end() if end else len(text)


def _set_of(words: np.ndarray, n: int) -> np.ndarray:
    c = len(words)
    if not c:
        return words
    h = np.zeros(max(c - n + 1, 1), np.uint64)
    for j in range(min(n, c)):
        h = mixed(h + words[j : j + len(h)] * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(h) if c >= n else mixed(h + np.uint64(c))


def prints(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from others."""
    with np.errstate(over="ignore"):
        a, b = mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mixed(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int((b + np.uint64(len(s))).astype(np.int64))


# What is shared by alike sets: subsets and blocks


@lru_cache(maxsize=None)
def schemes(percent: int, largest: int) -> tuple[tuple[int, int, int], ...]:
    """(least, most, differences) for sizes up to ``largest``: of alike sets the smaller has a size in least..most, and they differ in so many elements at most."""
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * SPREAD))
        out.append((low, high, (100 - percent) * high // percent))
        low = high + 1
    return tuple(out)


def blocks_of(differences: int) -> int:
    return differences + 1 + math.ceil(SPARE * (differences + 1))


def _partners(size: int, percent: int) -> range:
    return range(-(-percent * size // 100), 100 * size // percent + 1)


@lru_cache(maxsize=None)
def subsets(size: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(smaller, larger, elements left out) for each size that a set of ``size`` may be alike to; equal sets aside."""
    out = []
    for other in _partners(size, percent):
        a, b = min(size, other), max(size, other)
        shared = -(-percent * (a + b) // (100 + percent))
        if a != b or shared < a:
            out.append((a, b, size - shared))
    return tuple(x for x in out if 0 <= x[2] <= min(x[0], size))


@lru_cache(maxsize=None)
def boundary(percent: int) -> int:
    """The least size whose subsets cost more than its lists."""
    size = 1
    while True:
        fixed = sum(math.comb(size, out) for _, _, out in subsets(size, percent))
        lists = sum(blocks_of(k) for low, high, k in schemes(percent, size) if -(-percent * size // 100) <= high and k)
        if fixed > LIST_COST * max(lists, 1):
            return size
        size += 1


@lru_cache(maxsize=64)
def _left_out(size: int, out: int) -> np.ndarray:
    return np.array(list(combinations(range(size), out)), np.int64).reshape(math.comb(size, out), out)


def entries(s: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """(spare, entries) of a set, for each way that it may share one: hashes below 2**48, ``spare`` of which may be left out."""
    size, edge, out = len(s), boundary(percent), []
    own = mixed(s ^ np.uint64(0x2545F4914F6CDD1D))
    if size < edge:
        total = own.sum(dtype=np.uint64)
        for a, b, left in subsets(size, percent):
            if b < edge:
                h = total - own[_left_out(size, left)].sum(1, dtype=np.uint64)
                out.append((0, _entry(h, (a << 24) + (b << 4) + 1)))
    for low, high, differences in schemes(percent, size):
        if differences and -(-percent * size // 100) <= high and 100 * size // percent >= edge:
            m = blocks_of(differences)
            sums = np.zeros(m, np.uint64)
            np.add.at(sums, ((own >> np.uint64(33)) % np.uint64(m)).astype(np.int64), mixed(own))
            out.append((m - differences - 1, _entry(sums + np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (high << 4) + 2)))
    return out


def _entry(h: np.ndarray, kind: int) -> np.ndarray:
    return mixed(mixed(h) + np.uint64(kind)) >> np.uint64(16)


# The steps between shards


def _rows(table: pa.Table) -> list[tuple[int, bytes]]:
    """(document, text), in an order that doesn't depend on how they came; equal rows once."""
    return sorted({(d, (t or "").encode("utf-8", "replace")) for d, t in zip(table["doc"].to_pylist(), table["text"].to_pylist())})


def _prints(n: int):
    def find(key: tuple, table: pa.Table) -> pa.Table:
        rows = _rows(table)
        sets = shingle_sets([t for _, t in rows], n)
        both = [prints(s) for s in sets]
        return pa.table({
            "doc": pa.array([d for d, _ in rows], pa.int64()),
            "shard": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "size": pa.array([len(s) for s in sets], pa.int64()),
            "a": pa.array([x for x, _ in both], pa.int64()),
            "b": pa.array([x for _, x in both], pa.int64()),
        })

    return find


def _chosen(table: pa.Table, firsts: set[tuple[int, int, int]], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(document, set) of the documents that stand for their set."""
    rows = _rows(table)
    for (doc, _), s in zip(rows, shingle_sets([t for _, t in rows], n)):
        if len(s) and (doc, *prints(s)) in firsts:
            yield doc, s


def _firsts(table: pa.Table) -> set[tuple[int, int, int]]:
    return set(zip(table["doc"].to_pylist(), table["a"].to_pylist(), table["b"].to_pylist()))


def _send_entries(n: int, percent: int, ranges: int):
    def send(key: tuple, table: pa.Table, firsts: pa.Table) -> pa.Table:
        found = [e for _, s in _chosen(table, _firsts(firsts), n) for _, e in entries(s, percent)]
        return sent(key[0].as_py(), np.concatenate([np.zeros(0, np.uint64), *found]), ranges)

    return send


_MEMBERS = "node long, elements binary, entries array<long>"


def _members(n: int, percent: int):
    """The sets that share enough entries to be alike to another, with the entries under which they are listed."""

    def find(key: tuple, table: pa.Table, news: pa.Table) -> pa.Table:
        is_first = np.array(news["doc"].is_valid().to_pylist(), bool)
        firsts, heard = news.filter(pa.array(is_first)), news.filter(pa.array(~is_first))
        grams = np.concatenate([np.zeros(0, np.uint64), *map(unpack, heard["grams"].to_pylist())])
        counts = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(b, np.uint32) for b in heard["counts"].to_pylist())])
        order = np.argsort(grams, kind="stable")
        grams, counts = grams[order], counts[order]
        nodes, sets, listed = [], [], []
        for doc, s in _chosen(table, _firsts(firsts), n) if len(grams) else ():
            kept = []
            for spare, e in entries(s, percent):
                e = np.unique(e)
                at = np.minimum(np.searchsorted(grams, e), len(grams) - 1)
                there = grams[at] == e
                e, often = e[there], counts[at[there]]
                kept.append(e[np.lexsort((e, often))][: max(len(e) - spare, 0)])
            kept = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
            if len(kept):
                nodes.append(doc)
                sets.append(blob(s))
                listed.append(kept.astype(np.int64))
        return pa.table({"node": pa.array(nodes, pa.int64()), "elements": pa.array(sets, pa.binary()), "entries": pa.array(listed, pa.list_(pa.int64()))})

    return find


# Exact joins


def _alike(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """100 * intersection >= percent * union, in whole numbers."""
    return 100 * shared >= percent * (a + b - shared)


def _links(nodes: np.ndarray, sets: list[np.ndarray], group: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest of the links between a set of ``left`` and one of ``right`` (indexes) of different ``group``."""
    sizes = np.array([len(s) for s in sets], np.int64)
    parent = {g: g for g in np.unique(group).tolist()}

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    used = np.unique(np.concatenate([left, right]))
    flat, row = np.concatenate([sets[i] for i in used.tolist()]), np.repeat(used, sizes[used])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    row, column = row[keep], (np.cumsum(often) - 1)[column[keep]]
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    shared = np.zeros((len(left), len(right)), np.float32)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 2049, 2048))
    for a, b in zip(edges, edges[1:]):
        if b > a:
            r, c = row[a:b], column[a:b] % 2048
            x, y = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
            on = place_l[r] >= 0
            x[place_l[r[on]], c[on]] = 1
            on = place_r[r] >= 0
            y[place_r[r[on]], c[on]] = 1
            shared += x @ y.T
    hit = _alike(shared.astype(np.int64), sizes[left][:, None], sizes[right][None], percent)
    hit &= group[left][:, None] != group[right][None]
    found = []
    for i in np.flatnonzero(hit.any(1)).tolist():
        for j in np.flatnonzero(hit[i]).tolist():
            x, y = root(int(group[left[i]])), root(int(group[right[j]]))
            if x != y:
                parent[x] = y
                found.append((int(nodes[left[i]]), int(nodes[right[j]])))
    return found


def _join(percent: int):
    """Of rows (family, p, q, side, node, component, elements): links between side 0 and side 1 of each block (family, p, q); where p = q, all are on side 0."""

    def join(key: tuple, table: pa.Table) -> pa.Table:
        family, p, q, side, node, group = (np.array(table[c].to_pylist(), np.int64) for c in ("family", "p", "q", "side", "node", "component"))
        sets = [np.frombuffer(b, np.uint64) for b in table["elements"].to_pylist()]
        order = np.lexsort((node, side, q, p, family))
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(family[order]) != 0) | (np.diff(p[order]) != 0) | (np.diff(q[order]) != 0)])) if len(order) else []
        found = []
        for a, b in zip(edge, [*edge[1:], len(order)]):
            rows = order[a:b]
            own = [sets[i] for i in rows.tolist()]
            left, right = np.flatnonzero(side[rows] == 0), np.flatnonzero(side[rows] == 1)
            if p[rows[0]] == q[rows[0]]:
                right = left
            if len(left) and len(right):
                found += _links(node[rows], own, group[rows], left, right, percent)
        return pa.table({"x": pa.array([x for x, _ in found], pa.int64()), "y": pa.array([y for _, y in found], pa.int64())})

    return join


def _verify(percent: int):
    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(x) + len(y) - len(np.union1d(x, y))
            out.append(bool(_alike(np.int64(shared), np.int64(len(x)), np.int64(len(y)), percent)))
        return pa.array(out, pa.bool_())

    return alike


def _linked(members: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the members (node, elements, entries) that are linked with another."""
    listed = members.select("node", F.explode("entries").alias("entry"))
    # One key more than that of the aggregation, so that the join deals both sides itself and can split an entry that is everywhere.
    part = F.xxhash64("entry").alias("part")
    first = listed.groupBy("entry").agg(F.min("node").alias("first"), F.max("node").alias("last")).where(F.col("first") != F.col("last")).select("entry", part, "first")
    stars = saved(listed.select("*", part).join(first, ["entry", "part"]).where(F.col("node") != F.col("first")).select(F.col("node").alias("x"), F.col("first").alias("y")).distinct())
    families = saved(components(stars).withColumnRenamed("component", "family"))
    # Each set against the smallest of each of its lists: most of a family is one component from then on.
    sets = members.select("node", "elements")
    tried = stars.join(sets.toDF("x", "ex"), "x").join(sets.toDF("y", "ey"), "y").where(_verify(percent)("ex", "ey")).select("x", "y")
    known = components(tried)
    rows = families.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = rows.join(members.select("node", "elements", (F.octet_length("elements") / 8).alias("size")), "node")
    core = _cores(rows)
    # How often a row would be copied: a block of the rest meets every block, one of the core those of the rest.
    rest, cored = F.col("total") - F.col("cored"), F.col("cored")
    copies = (rest * (F.col("rest_blocks") + F.col("core_blocks")) + cored * F.col("rest_blocks")) / F.col("total")
    large = core.where(copies > REFINED).select("family")
    if not large.isEmpty():
        rows = rows.join(large, "family", "left_anti").unionByName(_refined(rows.join(large, "family"), percent))
        core = _cores(rows)
    rows = rows.join(core.select("family", "core", "rest_blocks", "core_blocks"), "family")
    in_core = F.col("component") == F.col("core")
    own = F.pmod(F.xxhash64("node"), F.when(in_core, F.col("core_blocks")).otherwise(F.col("rest_blocks")))
    rows = rows.withColumn("own", F.when(in_core, F.col("rest_blocks") + own).otherwise(own))
    # A block of the rest meets itself, the later ones of the rest and all of the core.
    last = F.col("rest_blocks") + F.col("core_blocks") - 1
    as_left = F.transform(F.sequence(F.col("own"), last), lambda q: F.struct(F.col("own").alias("p"), q.alias("q"), F.lit(0).alias("side")))
    before = F.when(in_core, F.col("rest_blocks")).otherwise(F.col("own"))
    as_right = F.when(before > 0, F.transform(F.sequence(F.lit(0).cast("long"), before - 1), lambda p: F.struct(p.alias("p"), F.col("own").alias("q"), F.lit(1).alias("side")))).otherwise(F.array().cast("array<struct<p:bigint,q:bigint,side:int>>"))
    meets = F.when(in_core, as_right).otherwise(F.concat(as_left, as_right))
    dealt = rows.select("family", "node", "component", "elements", F.explode(meets).alias("m")).select("family", "m.p", "m.q", "m.side", "node", "component", "elements")
    # Small families share a task; a block of a large one is on its own or nearly so.
    bins = F.lit(max(1, math.ceil((core.agg(F.sum("size")).first()[0] or 0) / BIN_ELEMENTS)))
    dealt = dealt.withColumn("bin", F.when((F.col("p") == 0) & (F.col("q") <= 1), F.pmod(F.xxhash64("family"), bins)).otherwise(F.xxhash64("family", "p", "q")))
    more = dealt.groupBy("bin").applyInArrow(trimmed(_join(percent)), "x long, y long")
    return components(known.select(F.col("node").alias("x"), F.col("component").alias("y")).union(more))


def _cores(rows: DataFrame) -> DataFrame:
    """(family, core, rest_blocks, core_blocks, size) of families (family, component, size, ...) with several components: what isn't in the largest one is joined with all of the family."""
    parts = rows.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    core = parts.groupBy("family").agg(F.max(F.struct("n", F.col("component"))).alias("c"), F.sum("n").alias("total"), F.sum("size").alias("size"), F.count("*").alias("parts"))
    core = saved(core.where("parts > 1")).select("family", F.col("c.component").alias("core"), F.col("c.n").alias("cored"), "total", "size")
    each = F.greatest(F.lit(1), F.least(F.lit(FAMILY_ROWS), F.floor(F.lit(FAMILY_ELEMENTS) * F.col("total") / F.col("size"))))
    return core.withColumn("rest_blocks", F.ceil((F.col("total") - F.col("cored")) / each).cast("long")).withColumn("core_blocks", F.ceil(F.col("cored") / each).cast("long"))


def _family_keys(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """(node, component, keys) of rows, in an order that doesn't depend on how they came; a key is that of an element in its family, below 2**48."""
    for i in np.argsort(table["node"].to_numpy()).tolist():
        family = mixed(np.array([table["family"][i].as_py()], np.int64).view(np.uint64))
        elements = np.frombuffer(table["elements"][i].as_py(), np.uint64)
        yield table["node"][i].as_py(), table["component"][i].as_py(), mixed(mixed(elements) ^ family) >> np.uint64(16)


def _send_keys(ranges: int):
    def send(key: tuple, table: pa.Table) -> pa.Table:
        return sent(key[0].as_py(), np.concatenate([k for _, _, k in _family_keys(table)]), ranges)

    return send


_LISTED = "node long, component long, entry long, smaller boolean"


def _list_keys(percent: int):
    """Of each set the keys under which it is listed, and whether that is so where it is the smaller of a pair."""

    def find(key: tuple, table: pa.Table, heard: pa.Table) -> pa.Table:
        known = np.concatenate([np.zeros(0, np.uint64), *map(unpack, heard["grams"].to_pylist())])
        counts = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(b, np.uint32) for b in heard["counts"].to_pylist())])
        order = np.argsort(known, kind="stable")
        known, counts = known[order], counts[order]
        out = [[], [], [], []]
        for node, component, keys in _family_keys(table) if len(known) else ():
            size = len(keys)
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            there = known[at] == keys
            shared, often = keys[there], counts[at[there]]
            # What no other set has comes before all else.
            alone = size - len(shared)
            as_smaller, as_larger = size + 1 - -(-2 * percent * size // (100 + percent)), size + 1 - -(-percent * size // 100)
            listed = shared[np.lexsort((shared, often))][: max(as_larger - alone, 0)]
            for column, values in zip(out, ([node] * len(listed), [component] * len(listed), listed.astype(np.int64).tolist(), (np.arange(len(listed)) < as_smaller - alone).tolist())):
                column += values
        return pa.table({name: pa.array(column, kind) for name, column, kind in zip(("node", "component", "entry", "smaller"), out, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))})

    return find


def _refined(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (family, node, component, elements, size) of large families, in smaller ones that no possible link leaves; what can have none goes.

    Lists of single elements, ordered by how many sets of the family have them: of an alike pair, the smaller set's
    first size - c + 1 elements and the larger set's have one in common, where c is what they must share at least. A
    text that many others are made of, each with enough of its own, makes no list. Shards of sets tell each other
    their elements' hashes, each once.
    """
    rows = saved(rows)
    shards = math.ceil((rows.agg(F.sum("size")).first()[0] or 1) / SHARD_ELEMENTS)
    dealt = rows.select("family", "node", "component", "elements", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard")).groupBy("shard")
    heard = dealt.applyInArrow(trimmed(_send_keys(ranges_for(shards))), SENT).groupBy("range").applyInArrow(trimmed(find_repeated), HEARD)
    listed = saved(dealt.cogroup(heard.groupBy("shard")).applyInArrow(trimmed(_list_keys(percent)), _LISTED))
    part = F.xxhash64("entry").alias("part")
    lists = listed.groupBy("entry").agg(F.min(F.when(F.col("smaller"), F.col("node"))).alias("first"), F.min("component").alias("low"), F.max("component").alias("high"))
    lists = lists.where("first IS NOT NULL AND low != high").select("entry", part, "first")
    stars = listed.select("node", "entry", part).join(lists, ["entry", "part"]).where(F.col("node") != F.col("first"))
    stars = saved(stars.select(F.col("node").alias("x"), F.col("first").alias("y")).distinct())
    return rows.drop("family").join(components(stars).withColumnRenamed("component", "family"), "node")


def join(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, n_shingles, component_id) for each distinct pair of key and text: the smallest key that it reaches by links.

    Two documents are linked where 100 * intersection >= percent * union of their distinct n-word shingles; a text with
    fewer than n words has all its words as one. Documents without words, null and empty ones included, are linked with
    nothing, nor are rows without a key, of which each distinct text is a row. Rows of one key are one document in
    the links, with a row for each distinct text.
    """
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    docs = docs.where("doc IS NOT NULL").withColumn("shard", F.pmod(F.xxhash64("doc", "text"), F.lit(shards)).cast("int"))
    dealt = docs.groupBy("shard")
    found = saved(dealt.applyInArrow(trimmed(_prints(n)), "doc long, shard int, size long, a long, b long"))
    classes = found.where("size > 0").groupBy("a", "b").agg(F.min(F.struct("doc", "shard")).alias("f")).select("a", "b", F.col("f.doc").alias("first"), F.col("f.shard").alias("shard"))
    classes = saved(classes)
    firsts = classes.select("shard", F.col("first").alias("doc"), "a", "b")
    entered = dealt.cogroup(firsts.groupBy("shard")).applyInArrow(trimmed(_send_entries(n, percent, ranges_for(shards))), SENT)
    heard = entered.groupBy("range").applyInArrow(trimmed(find_repeated), HEARD)
    news = firsts.unionByName(heard, allowMissingColumns=True)
    members = saved(dealt.cogroup(news.groupBy("shard")).applyInArrow(trimmed(_members(n, percent)), _MEMBERS))
    linked = _linked(members, percent)
    # Documents with equal sets follow the first of them, and those with equal keys each other.
    own = found.join(classes.select("a", "b", "first"), ["a", "b"], "left")
    out = own.join(linked.withColumnsRenamed({"node": "first"}), "first", "left")
    out = out.withColumn("component_id", F.when(F.col("size") > 0, F.coalesce("component", "first")).otherwise(F.col("doc")))
    alone = df.where(F.col(f"`{key}`").isNull()).select(F.lit(None).cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).distinct()
    alone = alone.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int"))
    nulls = alone.groupBy("shard").applyInArrow(trimmed(_prints_of_nulls(n)), "doc long, size long").select("doc", "size", F.lit(None).cast("long").alias("component_id"))
    out = out.select("doc", "size", "component_id").union(nulls)
    return out.select(F.col("doc").alias(key), F.col("size").alias("n_shingles"), "component_id")


def _prints_of_nulls(n: int):
    def find(key: tuple, table: pa.Table) -> pa.Table:
        sets = shingle_sets([(t or "").encode("utf-8", "replace") for t in table["text"].to_pylist()], n)
        return pa.table({"doc": pa.array([None] * len(sets), pa.int64()), "size": pa.array([len(s) for s in sets], pa.int64())})

    return find


def oracle(table: str = "documents", n: int = 3, percent: int = 90) -> str:
    """DuckDB SQL for doc_id, n_shingles, component_id of a table of unique ids; it compares all pairs that share a shingle."""
    upper = "".join(map(chr, range(65, 91)))
    return f"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
    shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + {n - 1}], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS size FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (
        SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * common >= {percent} * (a.size + b.size - common)),
    either AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reached AS (SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT r.x, e.y FROM reached r JOIN either e ON r.y = e.x)
    SELECT d.doc_id, coalesce(any_value(s.size), 0)::BIGINT AS n_shingles, coalesce(min(r.y), d.doc_id)::BIGINT AS component_id
    FROM {table} d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reached r ON r.x = d.doc_id GROUP BY d.doc_id"""
