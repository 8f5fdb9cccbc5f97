"""The interval-aligned, padded join of two bucketed tables.

Both sides tile the key domain with intervals. Their common refinement is swept in order; every ``merge`` refined
intervals make a batch, whose result is padded with noisily many dummies, up to a bound from the sides' frequencies.
What is padded is counted from key histograms: the real rows of the result are those of a plain equi-join, which is
how ``joined_rows`` makes them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from padlake.functions.metadata import JoinMeta
from padlake.functions.noise import Keyed, ShiftedGeometric, shifted_geometric_sql
from padlake.operators.frequency import joined_freq
from padlake.operators.held import cut, held
from padlake.operators.partition import in_order, part_of


@dataclass(frozen=True)
class Side:
    """freq: (key, freq) of the real rows; buckets: (part_id, start, end, n_real, n_dummy)."""

    freq: DataFrame
    buckets: DataFrame
    domain: int


def _aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair, start, end, a, b): the intersections in order; a and b are structs of the interval, its id, end and rows, of either side.

    The refined intervals end where one of either list ends, so one sort of the ends gives them all, in one task: an
    interval list is metadata, and no pair of intervals that don't meet is looked at.
    """
    rows = lambda x: F.coalesce(F.col("n_real") + F.col("n_dummy"), F.lit(0)) if "n_real" in x.columns else F.lit(0).cast("long")
    own = lambda x: F.struct(F.col("part_id").alias("part"), F.col("end").alias("end"), rows(x).alias("rows"))
    none = F.lit(None).cast("struct<part:bigint,end:bigint,rows:bigint>")
    ends = a.select("end", own(a).alias("a"), none.alias("b")).union(b.select("end", none, own(b)))
    ends = ends.groupBy("end").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    order = Window.orderBy("end")
    ahead = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return ends.select(
        in_order("end").alias("pair"),
        (F.coalesce(F.lag("end").over(order), F.lit(0)) + 1).cast("long").alias("start"),
        "end",
        F.min("a").over(ahead).alias("a"),
        F.min("b").over(ahead).alias("b"),
    )


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair, start, end, a_part, b_part): the intersections of two interval lists that tile the same domain, in order."""
    return _aligned(a, b).select("pair", "start", "end", F.col("a.part").alias("a_part"), F.col("b.part").alias("b_part"))


def pairs(a: DataFrame, b: DataFrame, merge: int) -> DataFrame:
    """Aligned intervals with the rows of both buckets, dummies included, the batch, and what a batch has met of each side.

    A batch counts the rows of a side's bucket when the sweep comes to it. After a batch a side starts anew only if it
    moves on to another bucket; else it keeps all it has counted.
    """
    p = _aligned(a, b).select("pair", "start", "end", *[F.col(f"{s}.{x}").alias(f"{s}_{x}") for s in "ab" for x in ("part", "end", "rows")])
    order = Window.orderBy("pair")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.lead("pair").over(order).isNull()
    p = p.withColumn("batch", F.floor(F.col("pair") / merge).cast("long")).withColumn("emits", (F.col("pair") % merge == merge - 1) | last)
    p = p.withColumns({f"{s}_adds": F.col(f"{s}_part") != F.coalesce(F.lag(f"{s}_part").over(order), F.lit(-1)) for s in "ab"})
    p = p.withColumns({f"{s}_group": F.coalesce(F.sum((F.col("emits") & (F.col("end") == F.col(f"{s}_end"))).cast("long")).over(before), F.lit(0)) for s in "ab"})
    for s in "ab":
        p = p.withColumn(f"{s}_met", F.sum(F.when(F.col(f"{s}_adds"), F.col(f"{s}_rows")).otherwise(0)).over(Window.partitionBy(f"{s}_group").orderBy("pair")))
    return p.select("pair", "start", "end", "a_part", "b_part", "a_rows", "b_rows", "batch", "emits", "a_met", "b_met")


def padded_join(a: Side, b: Side, merge: int, noise: ShiftedGeometric, source: Keyed, tag: str, metas: tuple[JoinMeta, JoinMeta] | None = None) -> tuple[Side, DataFrame]:
    """The joined side, and per batch (part_id, start, end, compared, real, drawn, n_dummy).

    Without ``metas`` all that is drawn is added. With them a batch of real rows and dummies stays at the bound
    min(a_freq * met of b, b_freq * met of a), or at its real rows where these are more: no real row is ever cut.
    """
    freq = held(joined_freq(a.freq, b.freq))
    p = pairs(a.buckets, b.buckets, merge)
    batch = p.groupBy("batch").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum(F.col("a_rows") * F.col("b_rows")).alias("compared"),
        F.max(F.when(F.col("emits"), F.col("a_met"))).alias("a_met"),
        F.max(F.when(F.col("emits"), F.col("b_met"))).alias("b_met"),
    )
    batch = batch.withColumnRenamed("batch", "part_id")
    real = part_of(freq, batch.select("part_id", "start", "end"), a.domain).groupBy("part_id").agg(F.sum("freq").cast("long").alias("real"))
    batch = batch.join(real, "part_id", "left").withColumn("real", F.coalesce("real", F.lit(0)).cast("long"))
    batch = batch.withColumn("drawn", noise.noise(source.column("batch", tag, F.col("part_id"), "u"), source.column("batch", tag, F.col("part_id"), "v")))
    dummies = F.col("drawn")
    if metas:
        wide = lambda c: F.col(c).cast("decimal(38,0)")
        bound = F.least(F.lit(metas[0].a).cast("decimal(19,0)") * wide("b_met").cast("decimal(18,0)"), F.lit(metas[1].a).cast("decimal(19,0)") * wide("a_met").cast("decimal(18,0)"))
        dummies = F.greatest(F.least(wide("real") + wide("drawn"), bound.cast("decimal(38,0)")) - wide("real"), F.lit(0).cast("decimal(38,0)")).cast("long")
    batch = batch.withColumn("n_dummy", dummies)
    # Metadata, used by the next join and by the costs.
    batch = cut(batch.select("part_id", "start", "end", "compared", "real", "drawn", "n_dummy"))
    buckets = batch.select("part_id", "start", "end", F.col("real").alias("n_real"), "n_dummy")
    return Side(freq, buckets, a.domain), batch


def joined_rows(a: DataFrame, b: DataFrame, on_conflict: str = "right_wins", key: str = "key", how: str = "inner") -> DataFrame:
    """The real rows: an equi-join of keyed tables. Of columns that both have, the right one stays, or both get a suffix, or it is an error."""
    both = [c for c in a.columns if c in b.columns and c != key]
    if both and on_conflict == "error":
        raise ValueError(f"both sides have {', '.join(both)}")
    if on_conflict == "suffix":
        a, b = a.withColumnsRenamed({c: f"{c}_x" for c in both}), b.withColumnsRenamed({c: f"{c}_y" for c in both})
    else:
        a = a.drop(*both)
    return a.join(b, key, how)


def strict_pairs(a: DataFrame, b: DataFrame, a_buckets: DataFrame, b_buckets: DataFrame, merge: int, domain: int) -> DataFrame:
    """Every pair of rows that the oblivious join compares, dummies included, with is_match: for small inputs, to see the cost model at work.

    ``a`` and ``b`` are padded rows (key, part_id, is_dummy, ...). Rows pair up by an equi-join on the aligned
    intervals, which is as many rows as the cost says.
    """
    p = pairs(a_buckets, b_buckets, merge).select("pair", "batch", "a_part", "b_part", "start", "end")
    left = a.select(F.col("part_id").alias("a_part"), F.col("key").alias("a_key"), F.col("is_dummy").alias("a_dummy"))
    right = b.select(F.col("part_id").alias("b_part"), F.col("key").alias("b_key"), F.col("is_dummy").alias("b_dummy"))
    met = p.join(left, "a_part").join(right, "b_part")
    return met.select("pair", "batch", "a_key", "b_key", (~F.col("a_dummy") & ~F.col("b_dummy") & (F.col("a_key") == F.col("b_key"))).alias("is_match"))


def cost_events(stage: str, batches: DataFrame) -> DataFrame:
    """(stage, kind, size) of a padded join: its comparisons, and for each batch the scans and the sort that cut it to its padded size."""
    size2 = F.col("real") + F.col("n_dummy")
    events = F.array(
        F.struct(F.lit("pairs").alias("kind"), F.col("compared").alias("size")),
        F.struct(F.lit("scan").alias("kind"), F.col("compared").alias("size")),
        F.struct(F.lit("scan").alias("kind"), size2.alias("size")),
        F.struct(F.lit("sort").alias("kind"), (F.col("compared") + size2).alias("size")),
    )
    return batches.select(F.lit(stage).alias("stage"), F.explode(events).alias("e")).select("stage", "e.kind", "e.size")


def repartition_events(stage: str, joined: DataFrame, again: DataFrame) -> DataFrame:
    """(stage, kind, size) of dealing a padded table anew: ``joined`` are its batches, ``again`` its new buckets."""
    n = joined.agg(F.sum(F.col("n_real") + F.col("n_dummy")).alias("n_in"))
    total = again.agg(F.sum(F.col("n_real") + F.col("n_dummy")).alias("n_out"))
    events = F.array(*[F.struct(F.lit(kind).alias("kind"), size.cast("long").alias("size")) for kind, size in (
        ("partition", F.col("n_in")), ("sort", F.col("n_in")), ("sort", F.col("n_in") + F.col("n_out")), ("scan", F.col("n_out")),
    )])
    return n.crossJoin(total).select(F.lit(stage).alias("stage"), F.explode(events).alias("e")).select("stage", "e.kind", "e.size")


def cost_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.sum("size").cast("long").alias("total"))


# The same as DuckDB SQL


def pairs_sql(name: str, a: str, b: str, merge: int) -> str:
    """Common table expressions that end in ``name``, by a range join of the interval lists ``a`` and ``b``."""
    side = lambda s: f"sum(CASE WHEN {s}_adds THEN {s}_rows ELSE 0 END) OVER (PARTITION BY {s}_group ORDER BY pair)::BIGINT AS {s}_met"
    return f"""
    {name}_met AS (
        SELECT row_number() OVER (ORDER BY greatest(a.start, b.start)) - 1 AS pair, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end",
               a.part_id AS a_part, b.part_id AS b_part, a.n_real + a.n_dummy AS a_rows, b.n_real + b.n_dummy AS b_rows, a."end" AS a_end, b."end" AS b_end
        FROM {a} a JOIN {b} b ON a.start <= b."end" AND b.start <= a."end"),
    {name}_flags AS (
        SELECT *, pair // {merge} AS batch, pair % {merge} = {merge - 1} OR pair = max(pair) OVER () AS emits,
               a_part IS DISTINCT FROM lag(a_part) OVER (ORDER BY pair) AS a_adds, b_part IS DISTINCT FROM lag(b_part) OVER (ORDER BY pair) AS b_adds
        FROM {name}_met),
    {name}_groups AS (
        SELECT *, coalesce(sum((emits AND a_end <= b_end)::INT) OVER w, 0) AS a_group, coalesce(sum((emits AND b_end <= a_end)::INT) OVER w, 0) AS b_group
        FROM {name}_flags WINDOW w AS (ORDER BY pair ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {name} AS (SELECT pair, start, "end", a_part, b_part, a_rows, b_rows, batch, emits, {side("a")}, {side("b")} FROM {name}_groups)"""


def padded_join_sql(name: str, a: str, b: str, merge: int, noise: ShiftedGeometric | tuple[str, float, float], source: Keyed, tag: str, metas: tuple[str, str] | None = None) -> str:
    """Common table expressions that end in ``name``_freq (key, freq), ``name``_batch and ``name`` (part_id, start, end, n_real, n_dummy).

    ``a`` and ``b`` name buckets whose histograms are ``a``_freq and ``b``_freq. ``metas`` are SQL expressions of the
    frequency bounds; ``noise`` is a mechanism, or (SQL of its sensitivity, eps, delta).
    """
    u, v = (source.sql("'batch'", f"'{tag}'", "batch", f"'{x}'") for x in "uv")
    drawn = noise.noise_sql(u, v) if isinstance(noise, ShiftedGeometric) else shifted_geometric_sql(*noise, u, v)
    bound = f"least({metas[0]}::HUGEINT * b_met, {metas[1]}::HUGEINT * a_met)" if metas else "NULL"
    dummies = f"greatest(least(n_real::HUGEINT + drawn, {bound}) - n_real, 0)::BIGINT" if metas else "drawn"
    return f"""
    {name}_freq AS MATERIALIZED (SELECT a.key, (a.freq * b.freq)::BIGINT AS freq FROM {a}_freq a JOIN {b}_freq b ON a.key = b.key),
    {pairs_sql(name + "_pairs", a, b, merge)},
    {name}_spans AS (
        SELECT batch, min(start) AS start, max("end") AS "end", sum(a_rows * b_rows)::BIGINT AS compared,
               max(CASE WHEN emits THEN a_met END) AS a_met, max(CASE WHEN emits THEN b_met END) AS b_met
        FROM {name}_pairs GROUP BY batch),
    {name}_real AS (
        SELECT s.batch, coalesce(sum(f.freq), 0)::BIGINT AS n_real
        FROM {name}_spans s LEFT JOIN {name}_freq f ON f.key BETWEEN s.start AND s."end" GROUP BY s.batch),
    {name}_drawn AS (SELECT *, {drawn} AS drawn FROM {name}_spans JOIN {name}_real USING (batch)),
    {name} AS MATERIALIZED (SELECT batch AS part_id, start, "end", n_real, {dummies} AS n_dummy, compared, drawn FROM {name}_drawn)"""
