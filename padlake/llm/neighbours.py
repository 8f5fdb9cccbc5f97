"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one word from each of several full-dimensional codebooks, found by beam search. A query
makes one table of products with all words; the score of a coded vector is a sum of table entries and its stored norm.
The best by that score are ranked by the exact cosine, and so is every other vector whose cosine may reach theirs: its
angle to the query differs from that of its code by the angle between the two at most. So the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from padlake.llm.graph import saved

#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 16384
CODEBOOKS, WORDS, BEAM, ROUNDS, SEED = 20, 256, 6, 2, 3
#: Of the least squares: how strongly words stay as they are, and how often each is looked at in a round.
RIDGE, SWEEPS = np.float32(0.5), 6
#: Candidates of a query in a block whose exact cosines raise the bar; whatever the bound doesn't put below it is ranked too.
RERANKED = 200
#: Coded vectors that a task holds at a time, and bytes of the queries' vectors that are sent to all tasks in a pass.
ROWS, QUERY_BYTES = 8192, 8 << 20


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): vectors as doubles, without those that are null, empty or zero or hold a null, infinite or undefined number, and null keys."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("key").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@dataclass
class Codebooks:
    """``words``: [codebook, word, dimension], float32."""

    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM, block: int = 512) -> np.ndarray:
        """Codes [row, codebook], uint8: the sum of words nearest to each row among what a beam search meets."""
        return np.concatenate([self._encode(x[k : k + block], beam) for k in range(0, len(x), block)]) if len(x) else np.zeros((0, len(self.words)), np.uint8)

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, every = len(x), np.arange(len(x))[:, None]
        left = x[:, None]  # what the words chosen so far leave over, for each state of the beam
        codes, cost = np.zeros((n, 1, 0), np.uint8), np.zeros((n, 1), np.float32)
        for w in self.words:
            step = (cost[:, :, None] + (w**2).sum(1) - 2 * (left.reshape(-1, x.shape[1]) @ w.T).reshape(n, -1, len(w))).reshape(n, -1)
            keep = min(beam, step.shape[1])
            best = np.argpartition(step, keep - 1, 1)[:, :keep]
            cost, state, word = step[every, best], best // len(w), best % len(w)
            left = left[every, state] - w[word]
            codes = np.concatenate([codes[every, state], word[:, :, None].astype(np.uint8)], 2)
        return codes[np.arange(n), cost.argmin(1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))


def train(x: np.ndarray, books: int = CODEBOOKS, words: int = WORDS, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks for unit vectors: residual k-means, then rounds of beam search and of least squares, word by word."""
    rng = np.random.default_rng(SEED)
    words = max(1, min(words, len(x)))
    left, found = x.copy(), []
    for _ in range(books):
        w = left[rng.choice(len(x), words, replace=False)].copy()
        for _ in range(6):
            at = ((w**2).sum(1) - 2 * left @ w.T).argmin(1)
            count = np.bincount(at, minlength=words)
            sums = np.zeros_like(w)
            np.add.at(sums, at, left)
            w = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], w)
        left = left - w[((w**2).sum(1) - 2 * left @ w.T).argmin(1)]
        found.append(w)
    made = Codebooks(np.stack(found).astype(np.float32))
    for _ in range(rounds):
        codes = made.encode(x, 3)
        left = x - made.decode(codes)
        for _ in range(SWEEPS):
            for m, w in enumerate(made.words):
                at = codes[:, m]
                sums = np.zeros_like(w)
                np.add.at(sums, at, left)
                change = sums / (np.bincount(at, minlength=words).astype(np.float32)[:, None] + RIDGE)
                w += change
                left -= change[at]
    return made


def fit(vectors: DataFrame, bound: int = SAMPLE) -> Codebooks | None:
    """Codebooks from at most ``bound`` rows (key, v), those of the smallest key hash; None if there are none or their lengths differ."""
    some = vectors.orderBy(F.xxhash64("key", "v"), "key").limit(bound).select("v").toPandas().v
    if some.empty:
        return None
    return train(unit(np.stack(some.to_numpy())))


def _codes(books: Codebooks):
    @F.arrow_udf("binary")
    def codes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dim = books.words.shape[2]
        for vectors in batches:
            x = vectors.values.slice(vectors.offsets[0].as_py(), len(vectors) * dim).to_numpy(zero_copy_only=False).reshape(-1, dim) if len(vectors) else np.zeros((0, dim))
            yield pa.array([row.tobytes() for row in books.encode(unit(x))], pa.binary())

    return codes


def index(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(key, v, code, size, own): every vector, its code, the squared norm of what that stands for and the cosine between the two."""
    coded = vectors.withColumn("code", _codes(books)("v"))

    @F.arrow_udf("float")
    def size(codes: pa.Array) -> pa.Array:
        c = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, len(books.words))
        return pa.array((books.decode(c) ** 2).sum(1) if len(c) else np.zeros(0, np.float32), pa.float32())

    @F.arrow_udf("double")
    def own(vectors: pa.Array, codes: pa.Array) -> pa.Array:
        if not len(codes):
            return pa.array([], pa.float64())
        y = books.decode(np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)).astype(float)
        x = scaled(np.stack(vectors.to_numpy(zero_copy_only=False)))
        size = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
        return pa.array(np.clip((x * y).sum(1) / np.where(size > 0, size, 1), -1, 1), pa.float64())

    return coded.select("key", "v", "code", size("code").alias("size"), own("v", "code").alias("own"))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square overflows or vanishes and cosines keep every bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row of ``x`` with ``q``, both scaled; summed from left to right, so that equal rows have equal ones."""
    sums = lambda y: np.cumsum(y, 1)[:, -1]
    return sums(x * q) / (np.sqrt(sums(q[None] ** 2)) * np.sqrt(sums(x**2)))


def highest(near: np.ndarray, size: np.ndarray, own: np.ndarray, slack: float) -> np.ndarray:
    """What the cosine of a vector with a query can be at most: ``near`` is 2 <q, y> - |y|^2 for its code y, ``size`` |y|^2, ``own`` the cosine of vector and y.

    Angles obey the triangle inequality. ``slack`` is the error of <q, y>.
    """
    length = np.sqrt(np.maximum(size, 1e-12))
    at, off = (near + size) / 2 / length, slack / length
    # The cosine to y that is nearest to the vector's own, within the error.
    at = np.clip(np.clip(own, at - off, at + off), -1, 1)
    return at * own + np.sqrt((1 - at**2) * (1 - own**2)) + 1e-6


@dataclass
class _Best:
    """The k nearest distinct ids that a query has met, nearest first, ties to the smaller id."""

    k: int
    keys: np.ndarray
    scores: np.ndarray

    @classmethod
    def none(cls, k: int) -> _Best:
        return cls(k, np.zeros(0, np.int64), np.zeros(0))

    @property
    def bar(self) -> float:
        """What a row's cosine must reach to be looked at, a little less than the last one's; anything while there are fewer than k ids."""
        return self.scores[-1] - 1e-9 if len(self.keys) == self.k else -2.0

    def add(self, keys: np.ndarray, scores: np.ndarray) -> None:
        keys, scores = np.concatenate([self.keys, keys]), np.concatenate([self.scores, scores])
        order = np.lexsort((-scores, keys))
        order = order[np.concatenate([[True], np.diff(keys[order]) != 0])] if len(order) else order
        order = order[np.lexsort((keys[order], -scores[order]))][: self.k]
        self.keys, self.scores = keys[order], scores[order]


_FOUND = "query long, key long, score double"


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            n += held[-1].num_rows
            if n >= rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _scan(books: Codebooks, asked: Broadcast, k: int, reranked: int, rows: int):
    # Of sums of float32 products: those of a table's entries, of the entries, and of the stored norm.
    slack = (books.words.shape[2] + len(books.words) + 16) * 2.0**-23 * (1 + float(np.sqrt((books.words.astype(float) ** 2).sum(2).max(1)).sum())) ** 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = asked.value
        dim = vectors.shape[1]
        best = [_Best.none(k) for _ in ids]
        tables, exact = unit(vectors), scaled(vectors)
        for block in _blocks(batches, rows):
            keys = block["key"].to_numpy()
            size, own = block["size"].to_numpy().astype(np.float64), block["own"].to_numpy()
            codes = np.frombuffer(b"".join(block["code"].to_pylist()), np.uint8).reshape(len(keys), -1)
            x = scaled(block["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            inverse = 1 / np.linalg.norm(x, axis=1)
            for i, q in enumerate(ids.tolist()):
                table = books.words @ tables[i]
                near = 2 * sum(table[m][codes[:, m]] for m in range(codes.shape[1])).astype(np.float64) - size
                direction = exact[i] / np.linalg.norm(exact[i])
                here, others = best[i], keys != q

                def look(at: np.ndarray) -> None:
                    at = at[(x[at] @ direction) * inverse[at] >= here.bar]
                    here.add(keys[at], cosines(x[at], exact[i]))

                may = np.flatnonzero(others & (highest(near, size, own, slack) >= here.bar))
                if len(may) > reranked:
                    # The best by code raise the bar for the rest.
                    first = np.argpartition(near[may], len(may) - reranked)
                    look(may[first[len(may) - reranked :]])
                    may = may[first[: len(may) - reranked]]
                    may = may[highest(near[may], size[may], own[may], slack) >= here.bar]
                if len(may):
                    look(may)
        yield pa.RecordBatch.from_pydict({
            "query": np.repeat(ids, [len(b.keys) for b in best]),
            "key": np.concatenate([np.zeros(0, np.int64), *(b.keys for b in best)]),
            "score": np.concatenate([np.zeros(0), *(b.scores for b in best)]),
        })

    return scan


def search(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", reranked: int = RERANKED, books: Codebooks | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine that each row for which ``is_query`` holds has among all others.

    Nearest first, ties to the smaller id. Vectors that are null, empty or zero or hold a null or non-finite number
    take no part, nor do null ids or vectors of another length than most of the sample's. Rows that repeat an id count
    once, at their best score, and ask with the least of their vectors; the query's own id is no candidate. Fewer candidates than k give fewer rows. Scores are
    those of the original vectors, in double precision.

    The queries are sent to the rows in passes of QUERY_BYTES or so, as many as their number asks for; no row is moved or
    copied. A task goes through its rows block by block, keeps the k nearest of each query, and looks at every row that
    the bound of its code doesn't put below them; the ``reranked`` best by code come first.
    """
    spark = df.sparkSession
    every = usable(df, key, vector)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length = every.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return empty
    every = every.where(F.size("v") == length.n)
    books = books or fit(every)
    queries = usable(df.where(is_query), key, vector).where(F.size("v") == length.n).groupBy("key").agg(F.min("v").alias("v"))
    passes = math.ceil(queries.count() * length.n * 8 / QUERY_BYTES)
    rows = index(every, books)
    if passes > 1:
        queries, rows = saved(queries), saved(rows)
    found = spark.createDataFrame([], _FOUND)
    for p in range(passes):
        some = queries.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == p).toPandas().sort_values("key")
        if len(some):
            asked = spark.sparkContext.broadcast((some["key"].to_numpy(np.int64), np.stack(some["v"].to_numpy()).astype(float)))
            found = found.union(rows.mapInArrow(_scan(books, asked, k, reranked, ROWS), _FOUND))
    # Rows of one id may have been in several tasks.
    found = found.groupBy("query", "key").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")


def oracle(table: str = "embeddings", every: int = 50, k: int = 5) -> str:
    """DuckDB SQL for query_id, rank, vec_id, score of a table of unique ids; it compares all queries with all rows, and sums from left to right."""
    return f"""
    WITH fine AS (
        SELECT vec_id, embedding FROM {table}
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
    parts AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM fine),
    norms AS (SELECT vec_id, sqrt(sum(x * x ORDER BY i)) AS norm FROM parts GROUP BY vec_id),
    dots AS (
        SELECT q.vec_id AS query_id, r.vec_id, sum(r.x * q.x ORDER BY r.i) AS dot
        FROM parts q JOIN parts r ON q.i = r.i AND q.vec_id != r.vec_id WHERE q.vec_id % {every} = 0 GROUP BY q.vec_id, r.vec_id),
    scored AS (SELECT query_id, d.vec_id, dot / (a.norm * b.norm) AS score FROM dots d JOIN norms a ON a.vec_id = query_id JOIN norms b ON b.vec_id = d.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= {k}"""
