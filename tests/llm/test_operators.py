"""The operators against plain versions, and what they do with nulls, empty tables, ties, repeats and clashing names."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import helpers
from padlake.llm import decontaminate, graph, html_text, html_train, jaccard, labelled, line_dedup, neighbours, preference, quality, shards, suffix_dedup, toxicity
from padlake.llm.labelled import fold

SCHEMA = "doc_id long, text string"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def near_copies(seed=0, n=60):
    """Texts with exact and near copies, shared passages, short and empty ones."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 160)) for _ in range(n)]
    docs = list(base)
    for t in base:
        w = t.split()
        for edits in (0, 1, 2, max(1, len(w) // 20)):
            c = list(w)
            for _ in range(edits):
                c[rng.randrange(len(c))] = f"x{rng.randrange(50)}"
            docs.append(" ".join(c))
    passage = prose(rng, 60)
    docs += [prose(rng, 40) + " " + passage + " " + prose(rng, rng.randrange(50)) for _ in range(25)]
    docs += [None, "", "  \n ", "one", "One", "one two", "ONE two", "a b c", "é É ß", "x " * 300]
    rng.shuffle(docs)
    return list(enumerate(docs))


# n-gram Jaccard join


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard_equals_all_pairs(spark, n, percent):
    docs = near_copies(percent)
    got = jaccard.join(spark.createDataFrame(docs, SCHEMA), n=n, percent=percent, shard_bytes=4000).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == helpers.jaccard_components(docs, n, percent)


def test_jaccard_large_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FAMILY_ROWS", 7)
    rng = random.Random(5)
    base = prose(rng, 90).split()
    docs = []
    for k in range(120):
        c = list(base)
        for _ in range(rng.randrange(5)):
            c[rng.randrange(len(c))] = f"y{rng.randrange(9999)}"
        docs.append((k, " ".join(c)))
    got = jaccard.join(spark.createDataFrame(docs, SCHEMA), n=3, percent=90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == helpers.jaccard_components(docs, 3, 90)


@pytest.mark.parametrize("n, percent", [(3, 90), (2, 60), (1, 80)])
def test_jaccard_large_families_by_elements(spark, monkeypatch, n, percent):
    """Every family counts as large: lists of elements lose no link."""
    monkeypatch.setattr(jaccard, "REFINED", 0)
    monkeypatch.setattr(jaccard, "FAMILY_ROWS", 5)
    rng = random.Random(percent)
    base = prose(rng, 70).split()
    docs = near_copies(percent, 25)
    for k in range(90):
        c = list(base)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(c))
            c[at : at + 1] = rng.choice([[f"y{rng.randrange(60)}"], [], [c[at], "z"]])
        docs.append((1000 + k, " ".join(c)))
    got = jaccard.join(spark.createDataFrame(docs, SCHEMA), n=n, percent=percent, shard_bytes=4000).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == helpers.jaccard_components(docs, n, percent)


def test_jaccard_of_a_template(spark, monkeypatch):
    """20,000 texts of one template, each with enough of its own, are not compared with each other; a few copies among them are found."""
    rng, dealt = random.Random(9), []
    template = prose(rng, 80, 10**6).split()
    docs = [(k, " ".join(template + [f"own{k}x{j}" for j in range(14)])) for k in range(20_000)]
    docs += [(30_000 + k, docs[k * 900][1] + " more") for k in range(20)]
    kept = jaccard._refined

    def refined(rows, percent):
        out = kept(rows, percent)
        dealt.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard, "_refined", refined)
    began = time.time()
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(docs, SCHEMA).repartition(8), n=5, percent=80).collect()}
    assert all(got[k] == (k if k < 30_000 else (k - 30_000) * 900) for k in got) and len(got) == 20_020
    assert all(after <= 60 for _, after in dealt) and time.time() - began < 240


@pytest.mark.parametrize("shared", [1, 2048, 2049, 4097])
def test_jaccard_links_at_the_threshold_in_slices(shared):
    """Sets that are just alike have all their common elements counted, the last one of the last slice included."""
    own = shared // 9
    percent = -(-100 * shared // (shared + own))
    while 100 * shared < percent * (shared + own) or 100 * (shared - 1) >= percent * (shared + own + 1):
        own += 1
        percent = 100 * shared // (shared + own)
    a, b = np.arange(shared, dtype=np.uint64) + np.uint64(10**6), np.concatenate([np.arange(own, dtype=np.uint64), np.arange(shared, dtype=np.uint64) + np.uint64(10**6)])
    both = np.array([0]), np.array([1])
    assert jaccard._links(np.array([5, 7]), [a, b], np.array([5, 7]), *both, percent) == [(5, 7)]


def test_jaccard_small_sets_share_subsets():
    edge = jaccard.boundary(90)
    assert 10 < edge < 40
    rng = np.random.default_rng(0)
    for size in range(9, edge + 6):
        a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        for lost, won in ((1, 0), (0, 1), (1, 1)):
            b = np.unique(np.concatenate([a[lost:], rng.integers(0, 1 << 62, won).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both) and len(np.union1d(a, b)) > both:
                x, y = (np.concatenate([e for _, e in jaccard.entries(s, 90)]) for s in (a, b))
                assert len(np.intersect1d(x, y)), (size, lost, won)


def test_jaccard_edge_cases(spark):
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e"), (None, "a b c d e"), (1, "a b c d e"), (2, "A b c d e"), (2, "other words are here now"), (3, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", component int, shard int")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()), key=str)
    assert got == sorted([(-1, 1, None), (1, 1, 1), (2, 1, 1), (2, 1, 2), (3, 0, 3)], key=str)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "x long, y long")).count() == 0


# Suffix arrays


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(0)
    for alphabet, n in ((2, 200), (1, 90), (200, 500), (4, 700)):
        raw = rng.integers(65, 65 + alphabet, n).astype(np.uint8)
        order = suffix_dedup.suffix_order(raw)
        text = raw.tobytes()
        assert order.tolist() == sorted(range(n), key=lambda k: text[k:])
        got = suffix_dedup.common_prefixes(raw, order, np.array([0, n // 3, n // 2]), 40)
        for k in range(1, n):
            a, b = text[order[k - 1] :], text[order[k] :]
            want = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
            assert got[k] == min(want, 40)


@pytest.mark.parametrize("hot", [1 << 16, 6])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # goes to the workers with the function that uses it
    docs = near_copies(9, 25) + [(900, "abc " * 400), (901, "zabc " * 90), (902, "é" * 200), (903, "xé" + "é" * 120)]
    got = suffix_dedup.dedup(spark.createDataFrame(docs, SCHEMA), shard_bytes=3000).collect()
    made = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got}
    assert made == helpers.byte_dedup(docs, 50)
    assert len(got) == len(docs)


def test_every_string_has_one_anchor_that_its_copies_share(monkeypatch):
    rng = np.random.default_rng(3)
    shared = rng.integers(97, 100, 130).astype(np.uint8).tobytes()
    texts = [rng.integers(97, 101, n).astype(np.uint8).tobytes() + shared * (n % 3) for n in (0, 10, 49, 50, 51, 700, 90, 333)]
    for piece in (1 << 19, 60, 170):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        seen, gram = set(), {}
        for hot in (np.zeros(0, np.uint64), np.sort(np.concatenate([p.gram for p in suffix_dedup._pieces(texts, 50)]))):
            seen.clear()
            for p in suffix_dedup._pieces(texts, 50):
                low, high, owner, grams, hashes = suffix_dedup._runs(p, None, hot, 50)
                for a, b, o, g in zip(low.tolist(), high.tolist(), owner.tolist(), grams.tolist()):
                    for s in range(a, b + 1):
                        at = (int(p.texts[o]), int(s - p.starts[o] + p.base[o]))
                        assert at not in seen
                        seen.add(at)
                        w = texts[at[0]][at[1] : at[1] + 50]
                        assert len(w) == 50 and w == p.raw[s : s + 50].tobytes()
                        assert gram.setdefault((w, len(hot)), g) == g
            assert len(seen) == sum(max(0, len(t) - 49) for t in texts)


def test_suffix_dedup_edge_cases(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    t = prose(random.Random(0), 40)
    rows = [(None, t), (None, t), (5, t), (5, t), (6, t), (7, None), (8, t[:49])]
    got = [(r.doc_id, r.n_bytes - len(r.kept)) for r in suffix_dedup.dedup(spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA + ", spans int, doc int")).collect()]
    assert sorted(got, key=str) == sorted([(None, 0), (None, 0), (5, 0), (5, 0), (6, len(t)), (7, 0), (8, 0)], key=str)


def test_shard_messages():
    h = shards.mixed(np.arange(1000, dtype=np.uint64)) >> np.uint64(16)
    assert (shards.unpack(shards.pack(h)) == h).all()
    assert shards.range_of(h, 7).max() < 7


# Line chunks


def _hash(line):
    return int(hashlib.md5(line.encode()).hexdigest()[:7], 16)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    lines = [prose(rng, 4) for _ in range(60)] + ["", "", "same"]
    passage = [prose(rng, 5) for _ in range(14)]
    docs = []
    for k in range(60):
        own = [rng.choice(lines) for _ in range(rng.randrange(0, 12))]
        at = rng.randrange(len(own) + 1)
        docs.append((k, "\n".join(own[:at] + (passage if k % 3 == 0 else []) + own[at:])))
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(docs, SCHEMA)).collect()}
    want = helpers.line_dedup(docs, _hash, line_dedup.WINDOW, line_dedup.DIVISOR, line_dedup.BASE, line_dedup.MODULUS)
    assert got == want
    assert sum(len(t) for t in got.values()) < sum(len(t) for _, t in docs)


def test_line_dedup_is_linear_in_lines(spark, tmp_path):
    lines = [f"line {k * 7919 % 100_000} of it" for k in range(100_000)]
    spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["own"] + lines[500:]))], SCHEMA).write.parquet(str(tmp_path / "t"))
    began = time.time()
    got = line_dedup.dedup(spark.read.parquet(str(tmp_path / "t"))).orderBy("doc_id").collect()
    assert time.time() - began < 60
    assert got[0].n_removed_lines == 0 and got[0].n_lines == 100_000 and got[1].n_removed_lines > 85_000
    want = helpers.line_dedup([(1, "\n".join(lines)), (2, "\n".join(["own"] + lines[500:]))], _hash, line_dedup.WINDOW, line_dedup.DIVISOR, line_dedup.BASE, line_dedup.MODULUS)
    assert [r.text for r in got] == [want[1], want[2]]


def test_line_dedup_edge_cases(spark):
    assert line_dedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    t = "\n".join(prose(random.Random(1), 5) for _ in range(20))
    rows = [(None, t), (1, t), (1, t), (2, t), (3, None), (4, ""), (5, "\n\n\n\n")]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA + ", kept string, n_lines long")
    got = line_dedup.dedup(df)
    assert got.columns == ["doc_id", "text", "kept", "n_lines", "n_removed_lines"]
    rows = [(r.doc_id, r.text, r.n_lines) for r in got.collect()]
    assert (3, None, 0) in rows and (4, "", 1) in rows and (5, "\n\n\n\n", 5) in rows and (None, t, 20) in rows
    assert all(len(x or "") < len(t) for d, x, _ in rows if d in (1, 2))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# Benchmark


def test_best_match_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 8)), rng.integers(0, 4, rng.integers(0, 14))
        d, s, e = decontaminate.best_match(a, b)
        assert d == min(helpers.edit_distance(a.tolist(), b[i:j].tolist()) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert helpers.edit_distance(a.tolist(), b[s:e].tolist()) == d


def test_decontaminate_reaches_its_recall_and_is_exact(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, n, 3000)) for k, n in enumerate([5, 8, 12, 15, 20, 26, 33, 40, 47, 59] * 3)]
    docs, want = [], set()
    for d in range(300):
        k, text = items[d % len(items)]
        w = text.split()
        edits = decontaminate.most_edits(len(w), 0.8)
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([["qq"], [], [w[at], "zz"]])
        docs.append((d, prose(rng, 30, 3000) + " " + " ".join(w).upper() + " " + prose(rng, rng.randrange(30), 3000)))
        want.add((d, k))
    docs += [(1000 + d, prose(rng, 120, 3000)) for d in range(100)]
    df = decontaminate.find(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    rows = df.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*").collect()
    texts, wanted = dict(docs), dict(items)
    for r in rows:
        part = decontaminate.words(texts[r.doc_id])[r.start_word : r.start_word + r.n_words]
        item = decontaminate.words(wanted[r.item_id])
        assert helpers.edit_distance(item, part) == r.distance <= decontaminate.most_edits(len(item), 0.8)
    found = {(r.doc_id, r.item_id) for r in rows}
    assert len(found & want) >= 0.95 * len(want)
    assert all(d < 1000 for d, _ in found)


def test_decontaminate_equals_all_windows():
    """Few words, so that much is nearly alike: what is found is what the edit distance says, and little is missed."""
    rng = random.Random(12)
    items = [(k, prose(rng, rng.randrange(5, 24), 12).split()) for k in range(25)]
    index = decontaminate.Index(items)
    texts = []
    for k in range(120):
        w = list(items[k % 25][1])
        for _ in range(rng.randrange(len(w) // 4 + 2)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(12)}"
        texts.append(" ".join([prose(rng, rng.randrange(20), 12), *w, prose(rng, rng.randrange(20), 12)]))
    right = same = wanted = 0
    for text, found in zip(texts, index.find(texts)):
        words, got = decontaminate.words(text), {m[0]: m[3] for m in found}
        for k, item in items:
            least = helpers.nearest_part(item, words)
            if least <= decontaminate.most_edits(len(item), 0.8):
                wanted += 1
                right += k in got
                same += got.get(k) == least
            else:
                assert k not in got
    assert wanted > 80 and right >= 0.97 * wanted and same >= 0.95 * wanted


def test_decontaminate_of_any_length():
    rng = random.Random(13)
    items = [(n, prose(rng, n, 5000).split()) for n in (10, 30, 100, 300, 800, 2000)]
    index = decontaminate.Index(items)
    met = 0
    for n, w in items:
        for _ in range(10):
            copy = list(w)
            for _ in range(decontaminate.most_edits(n, 0.8)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([["qq"], [], [copy[at], "zz"]])
            met += [m[0] for m in index.find([prose(rng, 50, 5000) + " " + " ".join(copy) + " " + prose(rng, 50, 5000)])[0]] == [n]
    assert met >= 0.98 * 60


def test_decontaminate_verifies_all_windows_where_hashes_are_too_few(monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_HASHES", 1)
    rng = random.Random(6)
    items = [(k, prose(rng, n, 3000).split()) for k, n in enumerate([30, 60, 200, 400])]
    index = decontaminate.Index(items)
    assert index.exact == {30, 60, 200, 400}
    for k, w in items:
        for _ in range(8):
            copy = list(w)
            for at in rng.sample(range(len(w)), decontaminate.most_edits(len(w), 0.8)):
                copy[at] = "qq"
            found = index.find([prose(rng, 20, 3000) + " " + " ".join(copy) + " " + prose(rng, 20, 3000), "none of it"])
            assert [m[0] for m in found[0]] == [k] and found[1] == []


def test_decontaminate_edge_cases(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (2, None), (3, ""), (None, "x y"), (4, "one two three four five six")], "item_id long, text string")
    rows = [(1, "so Alpha, beta GAMMA delta epsilon!"), (2, None), (3, ""), (None, "one two three four five six")]
    df = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA + ", item_id string")
    for size in (1 << 20, 20):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", size)
        got = {r.doc_id: sorted(x.item_id for x in r.leaks) for r in decontaminate.find(df, bench).collect()}
        assert got == {1: [1], 2: [], 3: [], None: [4]}
    assert decontaminate.find(df, bench.limit(0)).where(F.size("leaks") > 0).count() == 0
    assert decontaminate.find(df.limit(0), bench).count() == 0


# Nearest neighbours


def test_neighbours_recall_order_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x[300] = x[0]
    rows = [(k, [float(v) for v in x[k]]) for k in range(600)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, 600, 50):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(600), -s))[:5].tolist()
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in mine)
        hits += len({r.vec_id for r in mine} & set(best))
    assert hits >= 0.9 * 60


def test_neighbours_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, key int, v int"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (None, [1.0, 1.0]), (50, [0.0, 3.0]), (8, [1.0]), (9, [])]
    got = neighbours.search(spark.createDataFrame([(*r, 1, 2) for r in rows], schema), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 0.0), (50, 1, 2, 1.0), (50, 2, 0, 0.0), (50, 3, 1, 0.0)]
    assert neighbours.search(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_exact_among_near_copies(spark):
    """A third are near copies, more than are reranked and nearer to each other than codes can tell."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 24))
    x[::3] = x[0] + 0.01 * rng.normal(size=(500, 24))
    x[3] = x[6] = x[9]
    schema = "vec_id long, embedding array<double>"
    books = neighbours.train(neighbours.unit(x), 2, 16)
    got = neighbours.search(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], schema), F.col("vec_id") % 50 == 0, books=books).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = []
    for q in range(0, 1500, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        want += [(q, rank, int(v)) for rank, v in enumerate(np.lexsort((np.arange(1500), -s))[:5], 1)]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == want


def test_neighbours_bound_holds():
    rng = np.random.default_rng(8)
    x = neighbours.unit(np.concatenate([rng.normal(size=(400, 16)), 1 + 0.01 * rng.normal(size=(200, 16))]))
    books = neighbours.train(x, 3, 16)
    y = books.decode(books.encode(x)).astype(float)
    size = (y**2).sum(1)
    own = (x * y).sum(1) / np.sqrt(size)
    for q in x[::7].astype(float):
        assert (neighbours.highest(2 * y @ q - size, size, np.clip(own, -1, 1), 1e-6) >= x @ q).all()


def test_codes_add_up():
    x = neighbours.unit(np.random.default_rng(1).normal(size=(500, 16)))
    books = neighbours.train(x, 4, 16)
    few, many = (((x - books.decode(books.encode(x, beam))) ** 2).sum() for beam in (1, 8))
    assert many <= few < 0.8 * (x**2).sum()


# Classifiers


def _labelled(spark, toxic_words, n=500, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        w = prose(rng, rng.randrange(20, 80), 150).split()
        y = rng.random() < 0.3
        if y:
            for t in toxic_words:
                w.insert(rng.randrange(len(w)), t)
        else:
            w.insert(0, rng.choice(toxic_words))
        rows.append((k, " ".join(w)))
        labels.append((k, int(y)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_learns_pairs(spark):
    """Either word alone is harmless; together they aren't."""
    docs, labels, y = _labelled(spark, ["vermin", "neighbours"])
    machine = toxicity.train(docs, labels, fold("doc_id", 5) != 0)
    got = toxicity.score(docs, machine).select("doc_id", "score", (fold("doc_id", 5) == 0).alias("held")).collect()
    held = [(r.score >= 0.5) == bool(y[r.doc_id]) for r in got if r.held]
    assert np.mean(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_learns_statistics(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, 60) + "." if k % 3 else " ".join([rng.choice("abc")] * 50) + " ***") for k in range(400)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(k, int(k % 3 > 0)) for k, _ in rows], "doc_id long, quality int")
    forest = quality.train(docs, labels, fold("doc_id", 4) != 2)
    got = quality.score(docs, forest).select("doc_id", "score", (fold("doc_id", 4) == 2).alias("held")).collect()
    assert np.mean([(r.score >= 0.7) == (r.doc_id % 3 > 0) for r in got if r.held]) > 0.97


def test_machine_equals_a_loop_over_pairs():
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(-0.3, {}, rng.normal(size=30), rng.normal(size=(30, toxicity.FACTORS)))
    rows = [sorted(rng.choice(30, k, replace=False).tolist()) for k in (0, 1, 2, 9, 30)]
    for row, got in zip(rows, machine.score(rows)):
        z = machine.bias + sum(machine.weight[i] for i in row)
        for a, i in enumerate(row):
            for j in row[a + 1 :]:
                z += sum(machine.factors[i, f] * machine.factors[j, f] for f in range(toxicity.FACTORS))
        assert got == pytest.approx(1 / (1 + np.exp(-z)))


def test_forest_equals_a_walk_from_node_to_node():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(400, len(quality.FEATURES))), 1)
    forest = quality.fit(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float))
    for row, got in zip(x[:60], forest.score(x[:60])):
        z = forest.start
        for feature, cut, value in zip(forest.feature, forest.cut, forest.value):
            node = 0
            while 2 * node + 2 < len(value):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            z += value[node]
        assert got == pytest.approx(1 / (1 + np.exp(-z)))


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(k, f"{'bad' if k % 2 else 'fine'} text", k) for k in range(40)], "label long, text string, key long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "label long, text long")
    rows = labelled.training_rows(docs, labels, "text", F.col("label") < 30, 100, key="label", text="text").collect()
    assert sorted((r.key, r.label) for r in rows) == [(k, k % 2) for k in range(30)]
    for module in (quality, toxicity):
        assert module.score(docs, module.train(docs, labels, F.lit(True), label="text", key="label"), out="key").count() == 40


def test_very_long_texts(spark, monkeypatch):
    """Whole texts count: what stands at the end of a megabyte is found, by every operator that reads documents."""
    rng = random.Random(10)
    item, passage = prose(rng, 30, 10**6), prose(rng, 30, 10**6)
    long = [prose(rng, 150_000, 10**6) for _ in range(2)]
    rows = [(1, long[0] + " " + item), (2, long[1] + " " + passage), (3, passage + "."), (4, long[1] + " " + passage + " end"), (5, "x" * 300_000), (6, "x" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id: [x.item_id for x in r.leaks] for r in decontaminate.find(df, bench).collect()} == {1: [7], 2: [], 3: [], 4: [], 5: [], 6: []}
    assert {r.doc_id: r.component_id for r in jaccard.join(df, n=5, percent=80).collect()} == {1: 1, 2: 2, 3: 3, 4: 2, 5: 5, 6: 5}
    gone = {r.doc_id: r.n_bytes - len(r.kept) for r in suffix_dedup.dedup(df, shard_bytes=1 << 20).collect()}
    assert gone[1] == gone[2] == 0 and gone[3] == len(passage) and gone[4] >= len(rows[1][1]) and gone[5] == 0 and gone[6] == 300_000
    y = spark.createDataFrame([(k, k % 2) for k in range(1, 7)], "doc_id long, quality int").withColumn("toxic", F.col("quality"))
    for module in (quality, toxicity):
        scores = module.score(df, module.train(df, y, F.lit(True))).collect()
        assert len(scores) == 6 and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.terms(long[0] + " zzzz")[-1] >= 0 and set(toxicity.buckets("zzzz")) <= set(toxicity.terms(long[0] + " zzzz").tolist())


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "x", 0.5)], SCHEMA + ", score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(2, 1, 1), (None, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        for module in (quality, toxicity):
            got = module.score(docs, module.train(docs, labels, F.lit(True))).collect()
            assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert len(quality.statistics("")) == len(quality.statistics("A b.")) == len(quality.FEATURES)


# Pages


def test_blocks():
    page = '<p>a &amp;  b<b>c</b><br>d<script>var x = "</p>";</script><p class="x-y">e<!-- f --> g</p><ul><li><a href="/">h</a><li>i</ul> 1 < 2 <div>'
    got = [(text, linked) for _, text, linked in html_text.blocks(page)]
    assert got == [("a & bc d", 0), ("e g", 0), ("h", 1), ("i", 0), ("1 < 2", 0)]
    assert html_text.blocks("<style>x") == [] == html_text.blocks("<!-- x")
    assert html_text.blocks("<div" * 5000 + ">x")[-1:] != None  # noqa: E711


def test_labeller_on_unseen_pages():
    net, vectors = html_text.trained(), html_text._Vectors()
    make = html_train._Maker(np.random.default_rng(77))
    right = total = 0
    for _ in range(120):
        page = [b for b in html_text.blocks(make.page()) if b[1][0] in html_train.MAIN + html_train.REST and len(b[1]) > 1]
        if page:
            p = net.likely([[(path, text[1:].strip() or "-", linked) for path, text, linked in page]], vectors)[0]
            right += int(((p >= html_text.LEAST) == [t[0] == html_train.MAIN for _, t, _ in page]).sum())
            total += len(page)
    assert right > 0.98 * total


def test_labeller_equals_a_plain_lstm(monkeypatch):
    """One block and one cell at a time; pages of unlike lengths in one go, and long ones in several."""
    monkeypatch.setattr(html_text, "AT_ONCE", 3)
    net, vectors, make = html_text.trained(), html_text._Vectors(), html_train._Maker(np.random.default_rng(5))
    pages = [html_text.blocks(make.page()) for _ in range(3)] + [[]]
    got, w, cells = net.likely(pages, vectors), net.weights, html_text.CELLS
    sigma = lambda z: 1 / (1 + np.exp(-z))
    for page, p in zip(pages, got):
        x, both = vectors.of(page), []
        for way, order in (("1", range(len(page))), ("2", range(len(page) - 1, -1, -1))):
            h, c, hs = np.zeros(cells), np.zeros(cells), {}
            for t in order:
                z = x[t].astype(float) @ w[f"wx{way}"] + h @ w[f"wh{way}"] + w[f"b{way}"]
                new_h, new_c = np.zeros(cells), np.zeros(cells)
                for k in range(cells):
                    i, f, o, g = sigma(z[k]), sigma(z[cells + k]), sigma(z[2 * cells + k]), np.tanh(z[3 * cells + k])
                    new_c[k] = f * c[k] + i * g
                    new_h[k] = o * np.tanh(new_c[k])
                h, c = new_h, new_c
                hs[t] = h
            both.append([hs[t] for t in range(len(page))])
        want = [sigma(float(np.concatenate([a, b]) @ w["out"] + w["bias"][0])) for a, b in zip(*both)]
        assert len(p) == len(page) and np.allclose(p, want, atol=1e-4)


#: Pages written by hand, without telling class names, and what is main text in them.
BY_HAND = [
    (
        '<html><body><div class="a1"><div class="b2"><a href="/">Start</a> <a href="/n">News</a> <a href="/s">Sport</a></div></div><div class="c3"><h1>River floods the old town</h1>'
        "<p>After three days of rain the river rose over its banks on Monday night, and the market square stood under a metre of water.</p>"
        '<p>Shopkeepers carried what they could to the upper floors. "We have seen it before, but never in spring," said one of them.</p></div>'
        '<div class="d4"><h3>2 comments</h3><div><b>Anna says:</b><p>My cellar is full of mud, thanks for reporting on it.</p></div><div><b>Tom, 3 days ago</b><p>They should have built the wall years ago.</p></div></div>'
        '<div class="e5">&copy; 2024 Valley Herald. All rights reserved.</div></body></html>',
        ["River floods", "After three", "Shopkeepers carried"],
    ),
    (
        '<body><div id="x"><ul><li><a href="/1">Home</a></li><li><a href="/2">About</a></li><li><a href="/3">Contact</a></li></ul></div><div id="y"><h2>How to sharpen a knife</h2>'
        "<p>Hold the blade at about twenty degrees to the stone and draw it towards you, from heel to tip.</p><p>Turn it over and repeat, ten strokes on each side, with light pressure.</p>"
        '<ul><li>Use water or oil on the stone, never both.</li><li>Wipe the blade before you test it.</li></ul></div><div id="z">Categories: tools, kitchen, how-to</div><p>Copyright 2019 by the author</p></body>',
        ["How to", "Hold the", "Turn it", "Use water", "Wipe the"],
    ),
    (
        '<html><body><header><h2>The Bakery Blog</h2><p>Bread and more</p></header><main><h1>A rye loaf for beginners</h1><p>Rye flour takes up more water than wheat, so expect a wet and sticky dough.</p>'
        "<p>Leave it in a warm place overnight.</p></main><aside><h3>Popular</h3><ul><li><a href='/a'>Sourdough in a week</a></li><li><a href='/b'>Which oven to buy</a></li></ul></aside>"
        '<form><label>Your email</label><input><button>Subscribe</button></form><footer>&copy; 2021 The Bakery Blog</footer></body></html>',
        ["A rye", "Rye flour", "Leave it"],
    ),
]


@pytest.mark.parametrize("page, main", BY_HAND)
def test_pages_without_telling_names(page, main):
    text = html_text.main_text([page], html_text.trained(), html_text._Vectors())[0].split("\n")
    assert [" ".join(t.split()[:2]) for t in text] == main


def test_deep_and_long_pages(spark):
    net, vectors = html_text.trained(), html_text._Vectors()
    began = time.time()
    for page in ("<div>" * 1_000_000 + "deep", "<div>" * 200_000 + "x" + "</div>" * 200_000, "<ul>" * 20_000 + "</p>" * 200_000 + "y", "<article>" + "<div><p>a text of some words</p>" * 20_000):
        html_text.main_text([page, "<p>z</p>"], net, vectors)
    assert time.time() - began < 60
    long = "<article><h1>Title</h1>" + "".join(f"<p>Paragraph {k} of a long text, with words.</p>" for k in range(20_000)) + "</article><footer>&copy; 2024</footer>"
    got = html_text.extract(spark.createDataFrame([(1, long), (2, "<div>" * 50_000 + "x")], "page_id long, html string")).collect()[0].text.split("\n")
    assert len(got) > 19_900 and got[-1].startswith("Paragraph 19999 of")


def test_extract(spark):
    page = (
        '<html><head><title>T</title></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie">We use cookies.</div>'
        "<article><h1>A &eacute; title</h1><p>First  paragraph\nof text, long enough to be one.</p><p>Second paragraph, also of text.</p></article>"
        '<aside class="sidebar"><h3>Related</h3><ul><li><a href="/b">Other</a></li></ul></aside><section id="comments"><h3>Comments</h3><p>I think so too, says a reader.</p></section>'
        "<footer>&copy; 2024 Site</footer></body></html>"
    )
    rows = [(1, page), (2, None), (3, ""), (4, "<nav><a>Home</a></nav>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, html string, text string")).collect()}
    assert got[1] == "A é title\nFirst paragraph of text, long enough to be one.\nSecond paragraph, also of text."
    assert got[2] == got[3] == ""
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


# Preference pairs


def test_preference(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "a <|x|>"), (0, 1, "assistant", "a <|x|>"), (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 2, None, None),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "system", "alone"), (None, 0, "user", "x"),
    ]
    df = spark.createDataFrame([(*t, "q") for t in turns], "conv_id long, turn long, role string, text string, prompt string")
    made = preference.format_pairs(preference.pairs(df, F.expr("conv_id div 2"), F.col("conv_id") % 2 != 0))
    got = {r.pair_id: r for r in made.withColumns({m: preference.mask_text(m) for m in ("chosen_mask", "rejected_mask")}).collect()}
    assert sorted(got) == [0, 1, 2]
    assert got[0].prompt == "<|user|>\nhi<|end|>\n" and got[0].n_common == 1
    assert got[0].chosen_text == "<|assistant|>\na < |x|><|end|>\n" and got[0].rejected_text == "<|assistant|>\nb<|end|>\n<|unknown|>\n<|end|>\n"
    assert got[0].chosen_mask == "14-,16+" and got[0].rejected_mask == "14-,9+,12-,8-"
    assert (got[1].n_common, got[1].chosen_text, got[1].rejected_text) == (1, "", "")
    assert got[2].rejected_text == "" and got[2].chosen_text.startswith("<|system|>")
    assert preference.format_pairs(preference.pairs(df.limit(0), F.expr("conv_id div 2"), F.col("conv_id") % 2 != 0)).count() == 0


def test_preference_of_answers(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 2, "user", "more"), (0, 3, "assistant", "b"), (0, 4, "user", "bye"),
        (1, 0, "user", "x"), (1, 1, "assistant", "c"), (2, 0, "assistant", "alone"), (4, 0, "user", "no answer"), (5, 0, "assistant", "d"), (None, 0, "user", "x"),
        (-1, 0, "assistant", "e"), (-2, 0, "assistant", "f"),
    ]
    df = spark.createDataFrame([(*t, "q") for t in turns], "conv_id long, turn long, role string, text string, prompt string")
    got = {r.pair_id: r for r in preference.format_pairs(preference.answer_pairs(df)).collect()}
    assert sorted(got) == [-2, -1, 0, 1, 2, 4, 5]
    assert got[0].n_common == 3 and got[0].prompt.endswith("more<|end|>\n")
    assert got[0].chosen_text == "<|assistant|>\nb<|end|>\n<|user|>\nbye<|end|>\n" and got[0].rejected_text == "<|assistant|>\nc<|end|>\n<|user|>\nbye<|end|>\n"
    assert got[1].rejected_text == "<|assistant|>\nb<|end|>\n" and got[2].rejected_text == "<|assistant|>\n<|end|>\n"
    assert got[4].n_common == 1 and got[4].chosen_text == "" and got[5].rejected_text == "<|assistant|>\n<|end|>\n"
    assert got[-1].rejected_text == "<|assistant|>\nf<|end|>\n"


def test_preference_token_masks(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    theirs = tokenizers.Tokenizer.from_file(path)
    long = prose(random.Random(1), 30_000)
    turns = [(0, 0, "user", "hé  there"), (0, 1, "assistant", "an 🙂 answer"), (0, 2, None, "x"), (1, 0, "assistant", long), (3, 0, "assistant", "")]
    df = preference.format_pairs(preference.answer_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    for r in preference.token_masks(df, path).collect():
        ids = lambda t: theirs.encode(t, add_special_tokens=False).ids
        assert r.prompt_ids == ids(r.prompt)
        for text, mask, got, learn in ((r.chosen_text, r.chosen_mask, r.chosen_ids, r.chosen_learn), (r.rejected_text, r.rejected_mask, r.rejected_ids, r.rejected_learn)):
            at, want = 0, []
            for run in mask:
                want += [(i, run.learn) for i in ids(text[at : at + run.n_chars])]
                at += run.n_chars
            assert at == len(text) and list(zip(got, learn)) == want


def test_neighbours_of_repeated_ids(spark):
    """400 rows of one id near the query hide none of the others."""
    rng = np.random.default_rng(3)
    q = rng.normal(size=8)
    rows = [(0, q.tolist())] + [(1, (q + 0.01 * rng.normal(size=8)).tolist()) for _ in range(400)] + [(k, rng.normal(size=8).tolist()) for k in range(2, 45)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = [r.vec_id for r in neighbours.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    cos = {}
    for k, v in rows[1:]:
        cos[k] = max(cos.get(k, -2), float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)))
    assert got == sorted(cos, key=lambda k: -cos[k])[:5]


@pytest.mark.parametrize("size", [1e-200, 1e200, 1e-310])
def test_neighbours_of_any_size(spark, size):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=6) * size).tolist()) for k in range(40)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    x = np.array([np.array(v) / size for _, v in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [k for k in np.argsort(-(u @ u[0])).tolist() if k][:5]
    assert [r.vec_id for r in got] == want and all(np.isfinite(r.score) for r in got)


def test_neighbours_in_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(300)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, neighbours.search(df, F.col("vec_id") % 5 == 0).collect()))
    monkeypatch.setattr(neighbours, "QUERY_BYTES", 8 * 8 * 9)
    monkeypatch.setattr(neighbours, "ROWS", 64)
    assert sorted(map(tuple, neighbours.search(df, F.col("vec_id") % 5 == 0, reranked=10).collect())) == whole and len(whole) == 300


def test_codes_alone_find_neighbours():
    """20,000 vectors: the best 1 % by code have nine in ten of the five nearest."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(200, 24))
    x = neighbours.unit(centres[rng.integers(0, 200, 20_000)] + 0.5 * rng.normal(size=(20_000, 24)))
    books = neighbours.train(x[:4000], 12, 64)
    codes = books.encode(x)
    size = (books.decode(codes) ** 2).sum(1)
    hits = 0
    for q in range(0, 20_000, 1000):
        cos = x.astype(float) @ x[q]
        table = books.words @ x[q]
        near = 2 * sum(table[m][codes[:, m]] for m in range(codes.shape[1])) - size
        cos[q] = near[q] = -9
        hits += len(set(np.argsort(-cos)[:5].tolist()) & set(np.argsort(-near)[:200].tolist()))
    assert hits >= 0.9 * 5 * 20


# Hashes


def _thue_morse(n, letters):
    return bytes(letters[bin(k).count("1") % 2] for k in range(n))


def test_hashes_tell_thue_morse_words_apart(spark):
    """Words that polynomials modulo a power of two can't tell apart, whatever their base."""
    a, b = _thue_morse(2048, b"ab"), _thue_morse(2048, b"ba")
    raw = np.frombuffer(a + b, np.uint8)
    h = shards.Hashes(raw).parts(np.array([0, 2048, 0]), np.array([2048, 4096, 2047]))
    assert len(set(h.tolist())) == 3
    docs = spark.createDataFrame([(1, a.decode()), (2, b.decode()), (3, a.decode().upper())], SCHEMA)
    got = {r.doc_id: r.component_id for r in jaccard.join(docs, n=3, percent=90).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_words_of_long_texts_in_parts(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("aBc Éé\x85\u00a0 \t\x0b\x0c\n\r") for _ in range(rng.randrange(200))) + "longerword " * (k % 3) for k in range(40)] + ["", "x"]
    whole = jaccard.shingle_sets([t.encode() for t in texts], 2)
    assert [len(s) for s in whole] == [len(helpers.shingles(t, 2)) for t in texts]
    seen = {}
    for t in texts:
        for w in helpers.WORD.findall(helpers._lower(t)):
            seen[w] = jaccard.word_hashes(w.encode())[0].tolist()
    assert len({h[0] for h in seen.values()}) == len(seen) and all(len(h) == 1 for h in seen.values())
    monkeypatch.setattr(jaccard, "PIECE", 10)
    assert all((a == b).all() for a, b in zip(whole, jaccard.shingle_sets([t.encode() for t in texts], 2)))


@pytest.mark.parametrize("n", [10, 100, 1000])
def test_messages_grow_with_what_is_sent(n):
    """A shard sends at most a row for each range, of which there are fewer than shards, and never more rows than hashes."""
    h = shards.mixed(np.arange(5000, dtype=np.uint64)) >> np.uint64(16)
    ranges = shards.ranges_for(n)
    assert ranges <= n // shards.RANGE_SHARDS + 1
    assert shards.sent(3, h, ranges).num_rows <= ranges and shards.sent(3, h[:20], ranges).num_rows <= 20


def test_contexts_with_one_hash_are_compared():
    """Contexts of equal hashes but other bytes stay apart."""
    bodies = [b"a" * 60, b"b" * 60, b"a" * 60, b"b" * 60, b"c" * 61]
    one = np.zeros(5, np.uint64)
    first, which = suffix_dedup._distinct(one, one, np.array([60, 60, 60, 60, 61]), bodies.__getitem__)
    assert len(first) == 3 and which[0] == which[2] and which[1] == which[3] and len({*which.tolist()}) == 3
    assert all(bodies[first[w]] == b for w, b in zip(which.tolist(), bodies))
