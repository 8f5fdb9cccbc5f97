"""Partitions of an integer key domain [1, domain] into intervals: equi-width, or private by a threshold scan."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from padlake.functions.noise import BoundedLaplace, Keyed, Laplace, geometric_steps
from padlake.operators.held import cut

PARTS = "part_id long, start long, end long"
#: Intervals that one task puts in order, at most: a list of more is an error.
MOST_INTERVALS = 20_000_000


def uniform_parts(spark: SparkSession, domain: int, bins: int) -> DataFrame:
    """(part_id, start, end): ``bins`` intervals of equal width, the last one takes the remainder."""
    step = max(1, domain // bins)
    bins = min(bins, domain)
    k = F.col("id")
    return spark.range(bins).select(k.alias("part_id"), (k * step + 1).alias("start"), F.when(k == bins - 1, domain).otherwise((k + 1) * step).cast("long").alias("end"))


def uniform_bucket(key: Column, domain: int, bins: int) -> Column:
    """The interval of a key, by arithmetic."""
    return F.least(F.floor((key - 1) / max(1, domain // bins)), F.lit(min(bins, domain) - 1)).cast("long")


def format_splits(splits: Iterable[int], domain: int) -> list[tuple[int, int]]:
    """The intervals of [1, domain] that end at the distinct splits within it and at the domain itself, each beginning after the end before."""
    ends = sorted({domain, *(s for s in splits if 0 < s < domain)})
    return [(before + 1, end) for before, end in zip([0, *ends], ends)]


@dataclass(frozen=True)
class PrivateScan:
    """Parameters of the scan: load is summed up key by key and cut where it exceeds a noisy threshold.

    Ranges without keys aren't stepped through: one geometric draw says where in them the threshold would be met.
    ``gap_first`` looks at the range before a key, then at the key; else at the key, then at the range after it.
    """

    mechanism: Laplace
    threshold: float
    domain: int
    gap_first: bool = True
    least_chance: float = 0.0
    clip: tuple[float, float] = (0.0, 1.0)

    @classmethod
    def offline(cls, eps: float, delta: float, domain: int, sens: int = 1) -> PrivateScan:
        m = Laplace(eps, sens)
        return cls(m, m.scale * cls.level(domain, delta), domain, least_chance=1e-15)

    @classmethod
    def clamped(cls, eps: float, delta: float, domain: int, sens: int = 1) -> PrivateScan:
        m = BoundedLaplace(eps, sens, delta)
        return cls(m, 3 * m.bound, domain)

    @classmethod
    def key_first(cls, eps: float, delta: float, domain: int) -> PrivateScan:
        return cls(_OldestLaplace(eps, 1.0, delta), 2 / eps * math.log(domain / (2 * delta)), domain, gap_first=False, clip=(1e-20, 1 - 1e-10))

    @staticmethod
    def level(domain: int, delta: float) -> float:
        """The offline threshold, in scales of its noise."""
        return 2 * math.log(domain / (2 * min(delta, 0.5)))

    def splits(self, freqs: Iterable[tuple[int, int]], source: Keyed, table: str) -> Iterator[int]:
        """Cuts, in order, of (key, freq) in key order."""
        drawn = ((key, freq, self.mechanism.value(source.value("check", table, key)), source.value("gap", table, key)) for key, freq in freqs)
        return self.cuts(drawn, source.value("gap", table, 0), lambda segment: source.value("init", table, segment))

    def cuts(self, rows: Iterable[tuple[int, int, float, float]], first_gap: float, init: Callable[[int], float]) -> Iterator[int]:
        """As splits, of (key, freq, noise of the check at the key, uniform of the gap after it); in constant memory.

        ``first_gap`` is the uniform of the gap before the first key, ``init`` gives that of a segment's threshold.
        """
        segment, load, last, gap_u = 0, 0, 0, first_gap
        goal = self.threshold + self.mechanism.value(init(0))
        for key, freq, noise, next_u in chain(rows, [(self.domain + 1, None, 0.0, 0.0)]):
            steps = self._steps_to_cut(load, goal, key - last - 1, gap_u) if self.gap_first or last else None
            if steps is not None:
                yield last + steps
                segment, load = segment + 1, 0
                goal = self.threshold + self.mechanism.value(init(segment))
            if freq is None:
                return
            load += freq
            if load + noise > goal:
                yield key
                segment, load = segment + 1, 0
                goal = self.threshold + self.mechanism.value(init(segment))
            last, gap_u = key, next_u

    def _steps_to_cut(self, load: int, goal: float, length: int, u: float) -> int | None:
        """So many steps into a range without keys, or None."""
        if length <= 0:
            return None
        p = self.mechanism.seal(load, goal)
        if 0 < p < 1:
            p = min(max(p, self.clip[0]), self.clip[1])
        if p <= self.least_chance:
            return None
        steps = geometric_steps(u, p)
        return steps if steps <= length else None


@dataclass(frozen=True)
class _OldestLaplace(BoundedLaplace):
    """Its bound leaves out the sensitivity, and distances at the bound still have a chance."""

    @property
    def bound(self) -> float:
        return self.scale * math.log(1 / self.delta)

    def seal(self, load: float, threshold: float) -> float:
        d = threshold - load
        return 0.0 if d > self.bound else 1.0 if d < -self.bound else Laplace.seal(self, load, threshold)


def private_parts(freq: DataFrame, scan: PrivateScan, source: Keyed, table: str) -> DataFrame:
    """(part_id, start, end) for a key histogram (key, freq).

    The scan is sequential by its nature, for where it cuts decides how it goes on. It runs over the distinct keys, not
    the rows, sorted on disk where they are many, in one task of constant memory; its noise is drawn beforehand, side
    by side. ``private_parts_precut`` scans parts of a domain alike.
    """
    return private_parts_precut(freq, scan, source, table, 1)


def private_parts_precut(freq: DataFrame, scan: PrivateScan, source: Keyed, table: str, pieces: int) -> DataFrame:
    """As private_parts, with the domain cut beforehand at ``pieces`` - 1 places that don't depend on data; each piece is a scan of its own, and no task holds one."""
    domain, pieces = scan.domain, min(pieces, scan.domain)
    step = domain // pieces
    spark = freq.sparkSession
    rows = freq.where(F.col("key").between(1, domain) & (F.col("freq") > 0)).select("key", F.col("freq").cast("long").alias("freq"))
    every = spark.range(pieces).select((F.col("id") * step + 1).alias("key"), F.lit(0).cast("long").alias("freq"))  # pieces without keys are there too
    which = F.least(F.floor((F.col("key") - 1) / step), F.lit(pieces - 1)).cast("int")
    own = F.col("key") - F.col("piece") * step
    tag = F.lit(table) if pieces == 1 else F.concat(F.lit(f"{table}/"), F.col("piece").cast("string"))
    rows = rows.union(every).withColumn("piece", which).repartition(pieces, "piece").sortWithinPartitions("piece", "key")
    drawn = rows.select("piece", own.alias("key"), "freq", source.column("check", tag, own).alias("check"), source.column("gap", tag, own).alias("gap"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            noise = scan.mechanism.values(b["check"].to_numpy())
            yield from zip(b["piece"].to_pylist(), b["key"].to_pylist(), b["freq"].to_pylist(), noise.tolist(), b["gap"].to_pylist())

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        for k, group in groupby(read(batches), key=lambda r: r[0]):
            low, high = k * step, domain if k == pieces - 1 else (k + 1) * step
            name = table if pieces == 1 else f"{table}/{k}"
            cuts = replace(scan, domain=high - low).cuts((r[1:] for r in group if r[2]), source.value("gap", name, 0), lambda segment: source.value("init", name, segment))
            before = 0
            for end in chain((c for c in cuts if c < high - low), [high - low]):
                if end > before:
                    yield low + before + 1, low + end
                before = end

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = spans(batches)
        while some := list(islice(found, 8192)):
            yield pa.RecordBatch.from_pydict({"start": [a for a, _ in some], "end": [b for _, b in some]}, pa.schema([("start", pa.int64()), ("end", pa.int64())]))

    return cut(numbered(drawn.mapInArrow(scanned, "start long, end long")))


def numbered(parts: DataFrame) -> DataFrame:
    """Intervals numbered from 0 in order. They are metadata, fewer by far than keys, and MOST_INTERVALS at most."""
    return parts.select(in_order("start").alias("part_id"), "start", "end")


def in_order(column: str) -> Column:
    """The place of a row by ``column``, from 0. One task orders all rows, so that there may be MOST_INTERVALS of them."""
    place = F.row_number().over(Window.orderBy(column))
    return F.when(place <= MOST_INTERVALS, place - 1).otherwise(F.raise_error(F.lit(f"more than {MOST_INTERVALS} intervals")).cast("int")).cast("long")


def part_of(keys: DataFrame, parts: DataFrame, domain: int, id_name: str = "part_id", pieces: int = 4096) -> DataFrame:
    """``keys`` with the id of the interval that holds ``key``; keys in none go.

    Intervals are listed under the slices of the domain that they touch, so that the range join is an equi-join by
    slice. There are ``pieces`` equal slices, and one in which many intervals begin, as where keys cluster, is cut into
    twice as many: intervals are disjoint, so there are at most thrice as many entries as intervals and slices
    together. What is broadcast is a row for each slice, ``pieces`` at most.
    """
    width = max(1, -(-domain // pieces))
    slice_of = lambda c: F.floor((c - 1) / width)
    fine = parts.groupBy(slice_of(F.col("start")).alias("_slice")).agg(F.greatest(F.ceil(F.lit(width) / (2 * F.count("*"))), F.lit(1)).cast("long").alias("_fine"))
    fine = F.broadcast(fine)
    each = F.coalesce("_fine", F.lit(width))
    listed = parts.select(F.col("part_id").alias(id_name), F.col("start").alias("_start"), F.col("end").alias("_end"), F.explode(F.sequence(slice_of(F.col("start")), slice_of(F.col("end")))).alias("_slice"))
    within = lambda c: F.floor(F.least(F.greatest(c - 1 - F.col("_slice") * width, F.lit(0)), F.lit(width - 1)) / each)
    listed = listed.join(fine, "_slice", "left").withColumn("_sub", F.explode(F.sequence(within(F.col("_start")), within(F.col("_end"))))).drop("_fine")
    rows = keys.withColumn("_slice", slice_of(F.col("key"))).join(fine, "_slice", "left").withColumn("_sub", within(F.col("key"))).drop("_fine")
    return rows.join(listed, ["_slice", "_sub"]).where(F.col("key").between(F.col("_start"), F.col("_end"))).drop("_slice", "_sub", "_start", "_end")


# The same as DuckDB SQL


def uniform_parts_sql(domain: int, bins: int) -> str:
    step = max(1, domain // bins)
    return f"SELECT k AS part_id, (k * {step} + 1)::BIGINT AS start, (CASE WHEN k = {bins - 1} THEN {domain} ELSE (k + 1) * {step} END)::BIGINT AS \"end\" FROM (SELECT unnest(range({bins})) AS k)"


def private_parts_sql(name: str, freq: str, scan: PrivateScan, source: Keyed, table: str, sens: tuple[str, float, float] | None = None) -> str:
    """Common table expressions that end in ``name`` (part_id, start, end), by a recursion over the keys of ``freq`` (key, freq).

    ``sens``: (SQL of the sensitivity, eps, delta) of an offline scan whose sensitivity isn't known beforehand.
    """
    m = scan.mechanism
    scale, threshold = repr(float(m.scale)), repr(scan.threshold)
    if sens:
        scale, threshold = "scale", f"scale * {scan.level(scan.domain, sens[2])!r}"
    goal = lambda segment: f"({threshold} + {m.noise_sql(source.sql(_quoted('init'), _quoted(table), segment), scale)})"
    bounded = isinstance(m, BoundedLaplace)
    bound = m.bound if bounded else 0.0

    def chance(load: str, goal: str) -> str:
        d = f"({goal} - {load})"
        p = f"(CASE WHEN {d} >= 0 THEN 0.5 * exp(-{d} / {scale}) ELSE 1 - 0.5 * exp({d} / {scale}) END)"
        if not scan.gap_first:
            return f"(CASE WHEN {d} > {bound!r} THEN 0.0 WHEN {d} < -{bound!r} THEN 1.0 ELSE least(greatest({p}, {scan.clip[0]!r}), {scan.clip[1]!r}) END)"
        return f"(CASE WHEN {d} >= {bound!r} THEN 0.0 WHEN {d} <= -{bound!r} THEN 1.0 ELSE {p} END)" if bounded else p

    steps = f"(CASE WHEN p >= 1 THEN 1 ELSE greatest(1, ceil(ln({source.sql(_quoted('gap'), _quoted(table), 'last')}) / ln(1 - p))) END)"
    may = "" if scan.gap_first else " AND last > 0"
    begin = f"{sens[0]}::DOUBLE / {float(sens[1])!r}" if sens else scale
    return f"""
    {name}_seq AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY key) AS n, key, freq FROM (
            SELECT key::BIGINT AS key, freq::BIGINT AS freq FROM {freq} WHERE key BETWEEN 1 AND {scan.domain}
            UNION ALL SELECT {scan.domain} + 1, NULL)),
    {name}_scan AS (
        SELECT 0::BIGINT AS n, 0::BIGINT AS last, 0::BIGINT AS load, 0::BIGINT AS segment, scale, {goal("0")} AS goal, NULL::BIGINT AS cut1, NULL::BIGINT AS cut2
        FROM (SELECT ({begin})::DOUBLE AS scale) begins
        UNION ALL
        SELECT n, key, CASE WHEN cut2 IS NULL THEN load2 + coalesce(freq, 0) ELSE 0 END, segment2 + (cut2 IS NOT NULL)::INT, scale,
               CASE WHEN cut2 IS NULL THEN goal2 ELSE {goal("segment2 + 1")} END, cut1, cut2
        FROM (
            SELECT *, CASE WHEN freq IS NOT NULL AND load2 + freq + {m.noise_sql(source.sql(_quoted('check'), _quoted(table), 'key'), scale)} > goal2 THEN key END AS cut2
            FROM (
                SELECT *, CASE WHEN cut1 IS NULL THEN load ELSE 0 END AS load2, segment + (cut1 IS NOT NULL)::INT AS segment2,
                       CASE WHEN cut1 IS NULL THEN goal ELSE {goal("segment + 1")} END AS goal2
                FROM (
                    SELECT *, CASE WHEN gap > 0 AND p > {scan.least_chance!r}{may} AND {steps} <= gap THEN (last + {steps})::BIGINT END AS cut1
                    FROM (SELECT q.n, q.key, q.freq, s.last, s.load, s.segment, s.scale, s.goal, q.key - s.last - 1 AS gap, {chance("s.load", "s.goal")} AS p
                          FROM {name}_scan s JOIN {name}_seq q ON q.n = s.n + 1) a) b) c) d),
    {name}_cuts AS (
        SELECT DISTINCT cut FROM (SELECT cut1 AS cut FROM {name}_scan UNION ALL SELECT cut2 FROM {name}_scan UNION ALL SELECT {scan.domain}) WHERE cut BETWEEN 1 AND {scan.domain}),
    {name} AS (
        SELECT row_number() OVER (ORDER BY cut) - 1 AS part_id, (coalesce(lag(cut) OVER (ORDER BY cut), 0) + 1)::BIGINT AS start, cut::BIGINT AS "end" FROM {name}_cuts)"""


def precut_parts_sql(name: str, freq: str, scan: PrivateScan, source: Keyed, table: str, pieces: int) -> str:
    """Common table expressions that end in ``name``, a recursion for each of several pieces."""
    step, out, every = scan.domain // pieces, [], []
    for k in range(pieces):
        low, high = k * step, scan.domain if k == pieces - 1 else (k + 1) * step
        own = f"(SELECT key - {low} AS key, freq FROM {freq} WHERE key BETWEEN {low + 1} AND {high})"
        out.append(private_parts_sql(f"{name}_{k}", own, replace(scan, domain=high - low), source, f"{table}/{k}"))
        every.append(f'SELECT start + {low} AS start, "end" + {low} AS "end" FROM {name}_{k}')
    return ",".join(out) + f""",
    {name} AS (SELECT row_number() OVER (ORDER BY start) - 1 AS part_id, start, "end" FROM ({" UNION ALL ".join(every)}))"""


def _quoted(s: str) -> str:
    return f"'{s}'"
