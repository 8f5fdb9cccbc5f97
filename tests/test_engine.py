"""Closed-form values, hand-sized cases, invariants, and every query against its SQL in DuckDB."""

import bisect
import json
import math
import os
import random
import subprocess
import sys
from dataclasses import replace
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from padlake.functions.metadata import PRESETS, Budget, JoinMeta
from padlake.functions.noise import BoundedLaplace, Keyed, Laplace, ShiftedGeometric, geometric_steps, secure_uniforms
from padlake.operators import bucket, frequency, held, interval_join, partition, profile, synopsis
from padlake.operators.partition import PrivateScan, format_splits
from padlake.operators.tables import Table, join_tables
from padlake.plans import inputs, registry
from padlake.sources import csv, generators, sinks

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.mark.parametrize(
    "eps, delta, sens, k0, shift, upper",
    [
        (1 / 12, 1e-6 / 12, 1, 204, 204, 408),
        (1 / 12, 1e-6 / 12, 50, 10197, 10246, 20492),
        (1 / 12, 1e-6 / 12, 2150, 438434, 440583, 881166),
        (1 / 8, 1.25e-7, 1, 133, 133, 266),
        (1 / 8, 1.25e-7, 49, 6503, 6551, 13102),
        (1 / 8, 1.25e-7, 2401, 318625, 321025, 642050),
        (1 / 12, 1e-6 / 12, 55, 11216, 11270, 22540),
        (1 / 12, 1e-6 / 12, 2530, 515925, 518454, 1036908),
        (1 / 6, 1e-6 / 6, 1, 98, 98, 196),
        (1 / 6, 1e-6 / 6, 50, 4891, 4940, 9880),
        (1 / 6, 1e-6 / 6, 2350, 229836, 232185, 464370),
    ],
)
def test_noise_parameters(eps, delta, sens, k0, shift, upper):
    m = ShiftedGeometric(eps, delta, sens)
    assert (m.k0, m.shift, m.upper) == (k0, shift, upper)


@pytest.mark.parametrize("eps, delta, sens, threshold", [(1 / 12, 1e-6 / 12, 1, 706.1467), (1 / 12, 1e-6 / 12, 50, 35307.3367), (1 / 8, 1.25e-7, 1, 464.2770), (1 / 12, 1e-6 / 12, 55, 38838.0704)])
def test_thresholds(eps, delta, sens, threshold):
    assert PrivateScan.offline(eps, delta, 10**6, sens).threshold == pytest.approx(threshold, abs=1e-4)


def test_oldest_thresholds():
    for eps, delta, domain, bound, threshold in ((0.5, 5e-10, 10**8, 42.83, 156.58), (0.5, 5e-6, 100, 24.41, 64.47)):
        scan = PrivateScan.key_first(eps, delta, domain)
        assert scan.mechanism.bound == pytest.approx(bound, abs=0.01) and scan.threshold == pytest.approx(threshold, abs=0.01)


def test_delta_is_checked():
    for delta in (0, 1):
        with pytest.raises(ValueError):
            ShiftedGeometric(1, delta)
        with pytest.raises(ValueError):
            BoundedLaplace(1, 1, delta)
        with pytest.raises(ValueError):
            Laplace(1).tail_bound(delta)


def test_metadata():
    t1, t2, t3 = JoinMeta(43), JoinMeta(50), JoinMeta(42)
    assert t1.join(t2) == JoinMeta(2150, 50)
    assert t1.join(t2).join(t3).b == 2150
    assert JoinMeta.of_frequency(0, 1, 1e-6, Keyed(), "t") == JoinMeta.of_frequency(None, 1, 1e-6, Keyed(), "t") == JoinMeta(1, 1)
    assert Budget(1.0, 1e-6, 0.5, 5).stage == (0.1, pytest.approx(1e-7))
    assert PRESETS["four_way"][1] == (2, 3, 4)


def test_keyed_noise_is_the_same_everywhere(spark):
    source, m, lap = Keyed("s"), ShiftedGeometric(0.3, 1e-4, 3), Laplace(0.7)
    df = spark.range(500).select("id", source.column("t", F.col("id"), "u").alias("u"), source.column("t", F.col("id"), "v").alias("v"))
    got = df.select("id", "u", m.two_sided(F.col("u"), F.col("v")).alias("n"), lap.noise(F.col("u")).alias("l")).collect()
    for r in got:
        u, v = source.value("t", r.id, "u"), source.value("t", r.id, "v")
        assert (r.u, r.n) == (u, m.two_sided_value(u, v)) and r.l == pytest.approx(lap.value(u))
    noise = df.select(m.noise(F.col("u"), F.col("v")).alias("n")).agg(F.min("n"), F.max("n"), F.avg("n")).first()
    assert noise[0] >= 0 and noise[1] <= m.upper and abs(noise[2] - m.shift) < 3
    assert secure_uniforms(spark, 20).where("u <= 0 OR u >= 1").count() == 0


def test_splits():
    assert format_splits([5, 5, 10], 10) == [(1, 5), (6, 10)]
    assert format_splits([0, 4, 99], 10) == [(1, 4), (5, 10)]
    assert format_splits([], 3) == [(1, 3)]
    assert geometric_steps(0.5, 1.0) == 1


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def parts(spark, *spans):
    return frame(spark, [(k, a, b) for k, (a, b) in enumerate(spans)], partition.PARTS)


def test_uniform(spark):
    got = [(r.start, r.end) for r in partition.uniform_parts(spark, 15000, 8).orderBy("part_id").collect()]
    assert got[0] == (1, 1875) and got[-1] == (13126, 15000)
    assert [(r.start, r.end) for r in partition.uniform_parts(spark, 10, 3).collect()] == [(1, 3), (4, 6), (7, 10)]
    assert partition.uniform_parts(spark, 2, 5).count() == 2


def test_distribution_and_padding(spark):
    keys = frame(spark, [(k, 1) for k in (0, 3, 5, 6, 11)], "key long, freq long")
    pad = ShiftedGeometric(1.0, 1e-2)
    b = bucket.buckets(keys, parts(spark, (1, 5), (6, 10)), 10, pad, Keyed(), "t")
    assert [r.n_real for r in b.orderBy("part_id").collect()] == [2, 1]
    assert b.where(f"n_dummy < 0 OR n_dummy > {pad.upper}").count() == 0
    none = bucket.summary(b.limit(0)).first()
    assert (none.n_buckets, none.n_real, none.ratio, none.mean_size) == (0, 0, None, None)


def test_part_of_every_key(spark):
    spans = [(1, 1), (2, 7), (8, 8), (9, 4000), (4001, 10000)]
    keys = spark.range(1, 10001).withColumnRenamed("id", "key")
    for pieces in (1, 3, 4096, 100000):
        got = partition.part_of(keys, parts(spark, *spans), 10000, pieces=pieces).groupBy("part_id").count().orderBy("part_id").collect()
        assert [r["count"] for r in got] == [b - a + 1 for a, b in spans]


def test_part_of_where_intervals_cluster(spark):
    """Thousands of intervals in one slice, few elsewhere; keys on every edge."""
    rng = random.Random(2)
    ends = sorted({*rng.sample(range(500_000, 504_000), 1500), *rng.sample(range(1, 1_000_000), 40), 1_000_000})
    spans = list(zip([1, *(e + 1 for e in ends)], ends))
    keys = sorted({*(k for span in spans for k in span), *rng.sample(range(1, 1_000_001), 3000)})
    df = spark.createDataFrame([(k,) for k in [*keys, 0, 1_000_001]], "key long")
    for pieces in (16, 4096):
        got = partition.part_of(df, parts(spark, *spans), 1_000_000, pieces=pieces)
        assert sorted(map(tuple, got.select("key", "part_id").collect())) == [(k, bisect.bisect_left(ends, k)) for k in keys]


@pytest.mark.parametrize("make", [PrivateScan.offline, PrivateScan.clamped, PrivateScan.key_first])
def test_scan_of_a_table_equals_that_of_a_list(spark, make):
    rng = random.Random(3)
    freqs = sorted((k, rng.randrange(1, 60)) for k in rng.sample(range(1, 5000), 700))
    df = frame(spark, [*freqs, (0, 9), (6000, 9)], "key long, freq long").repartition(5)
    scan = make(0.5, 1e-3, 5000)
    got = [(r.start, r.end) for r in partition.private_parts(df, scan, Keyed(), "t").orderBy("part_id").collect()]
    assert got == format_splits(scan.splits(freqs, Keyed(), "t"), 5000) and len(got) > 5
    want = []
    for k in range(3):
        low, high = k * 1666, 5000 if k == 2 else (k + 1) * 1666
        own = replace(scan, domain=high - low)
        want += [(a + low, b + low) for a, b in format_splits(own.splits([(x - low, f) for x, f in freqs if low < x <= high], Keyed(), f"t/{k}"), high - low)]
    assert [(r.start, r.end) for r in partition.private_parts_precut(df, scan, Keyed(), "t", 3).orderBy("part_id").collect()] == want
    empty = partition.private_parts_precut(df.limit(0), scan, Keyed(), "t", 4).orderBy("part_id").collect()
    assert empty[0].start == 1 and empty[-1].end == 5000 and all(a.end + 1 == b.start for a, b in zip(empty, empty[1:]))


def test_keys_beyond_the_domain_are_an_error(spark, tmp_path):
    spark.createDataFrame([(5, "a"), (None, "b")], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    assert [tuple(r) for r in inputs.freq(spark, str(tmp_path), "account", 6).collect()] == [(6, 1)]
    with pytest.raises(Exception, match="outside the declared domain"):
        inputs.freq(spark, str(tmp_path), "account", 5).collect()


def test_too_many_intervals_are_an_error(spark, monkeypatch):
    spans = parts(spark, (1, 1), (2, 7), (8, 10))
    monkeypatch.setattr(partition, "MOST_INTERVALS", 3)
    assert [r.part_id for r in partition.numbered(spans).orderBy("start").collect()] == [0, 1, 2]
    monkeypatch.setattr(partition, "MOST_INTERVALS", 2)
    with pytest.raises(Exception, match="more than 2 intervals"):
        partition.numbered(spans).collect()
    with pytest.raises(Exception, match="more than 2 intervals"):
        interval_join.align(spans, spans).collect()


def test_what_runs_hold_is_given_back(spark):
    df = held.held(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10 and df.is_cached
    held.release()
    assert not df.storageLevel.useMemory and not held._held and df.agg(F.sum("x")).first()[0] == 90


def test_generated_rows_do_not_depend_on_partitions(spark):
    one = generators.clustered_keys(spark, 10**6, 500, seed=4)
    other = spark.range(0, 500, 1, 13).select(generators._clustered(F.col("id"), 500, 10**6, generators.centers(10**6, seed=4), generators.SPREAD, "4/key").alias("key"))
    assert sorted(one.toPandas().key) == sorted(other.toPandas().key)


def test_cost_log_with_totals(spark, tmp_path):
    events, seconds = frame(spark, [("join1", "pairs", 12), ("join2", "pairs", 3), ("join1", "sort", 15)], "stage string, kind string, size long"), {}
    with sinks.timed(seconds, "join1"):
        pass
    with sinks.timed(seconds, "join1"):
        pass
    sinks.write_cost_log(events, str(tmp_path / "log"), seconds | {"join2": 1.5})
    lines = [tuple(x.split("\t")) for x in spark.read.text(str(tmp_path / "log")).toPandas().value]
    assert {("total", "pairs", "15"), ("total", "sort", "15"), ("total", "all", "30"), ("join2", "seconds", "1.5000"), ("total", "seconds", "1.5000")} <= set(lines)
    assert sinks.report("t", bucket.summary(_buckets(spark, (1, 5))), 0.25).endswith("1.0 rows a bucket, 0.2500 s")


def _buckets(spark, *spans, size=1):
    return parts(spark, *spans).withColumn("n_real", F.lit(size).cast("long")).withColumn("n_dummy", F.lit(0).cast("long"))


def test_alignment_and_batches(spark):
    a, b = _buckets(spark, (1, 4), (5, 10)), _buckets(spark, (1, 6), (7, 10))
    got = interval_join.align(a, b).orderBy("pair").collect()
    assert [(r.start, r.end, r.a_part, r.b_part) for r in got] == [(1, 4, 0, 0), (5, 6, 1, 0), (7, 10, 1, 1)]
    merged = interval_join.pairs(a, b, 2).groupBy("batch").agg(F.min("start"), F.max("end")).orderBy("batch").collect()
    assert [tuple(r)[1:] for r in merged] == [(1, 6), (7, 10)]


def test_bound_counts_what_batches_retain(spark):
    """Three compared bucket pairs, batches of two: the side that doesn't move on keeps what it has met."""
    a = frame(spark, [(0, 1, 4, 487, 0), (1, 5, 6, 144, 0)], partition.PARTS + ", n_real long, n_dummy long")
    b = frame(spark, [(0, 1, 2, 495, 0), (1, 3, 5, 317, 0), (2, 6, 6, 9, 0)], partition.PARTS + ", n_real long, n_dummy long")
    got = interval_join.pairs(a, b, 2).orderBy("pair").collect()
    assert [(r.a_rows, r.b_rows) for r in got] == [(487, 495), (487, 317), (144, 317), (144, 9)]
    assert [r.b_met for r in got if r.emits] == [812, 821]
    assert [r.a_met for r in got if r.emits] == [487, 144]


def test_padding_never_cuts(spark):
    freq = frame(spark, [(k, 4) for k in range(1, 4)], "key long, freq long")
    side = interval_join.Side(freq, _buckets(spark, (1, 10), size=5), 10)
    big = ShiftedGeometric(0.01, 1e-3)
    _, free = interval_join.padded_join(side, side, 1, big, Keyed(), "x")
    _, bound = interval_join.padded_join(side, side, 1, big, Keyed(), "x", (JoinMeta(2), JoinMeta(3)))
    _, wide = interval_join.padded_join(side, side, 1, big, Keyed(), "x", (JoinMeta(20), JoinMeta(11)))
    assert free.first().n_dummy == free.first().drawn > 0
    assert (bound.first().real, bound.first().n_dummy) == (48, 0)
    assert wide.first().n_dummy == min(55, 48 + wide.first().drawn) - 48


def test_collisions(spark):
    a, b = frame(spark, [(1, 1)], "key long, x long"), frame(spark, [(1, 2)], "key long, x long")
    assert interval_join.joined_rows(a, b).collect() == [(1, 2)]
    assert interval_join.joined_rows(a, b, "suffix").columns == ["key", "x_x", "x_y"]
    with pytest.raises(ValueError):
        interval_join.joined_rows(a, b, "error")


def test_indexes(spark):
    h = lambda *n: frame(spark, list(enumerate(n)), "bin long, cnt long")
    assert [tuple(r)[1:] for r in synopsis.cdf_indexes(h(5, 6), h(1, 2)).orderBy("bin").collect()] == [(0, 5), (1, 11)]
    assert [tuple(r)[1:] for r in synopsis.dp_indexes(h(3, 4), h(5, 6)).orderBy("bin").collect()] == [(0, 5), (1, 7)]


def test_histogram(spark):
    df = frame(spark, [(float(k),) for k in range(1, 10)] + [(None,)], "x double")
    got = synopsis.histogram(df, "x", 4).orderBy("bin").collect()
    assert [r.cnt for r in got] == [2, 2, 2, 3] and [r.lo_edge for r in got] == [1, 3, 5, 7]
    one = synopsis.histogram(frame(spark, [(3.0,)] * 5, "x double"), "x", 4).orderBy("bin").collect()
    assert [r.cnt for r in one] == [0, 0, 0, 5]
    assert synopsis.histogram(df.limit(0), "x", 4).count() == 0


def test_profile_and_extremes(spark):
    df = frame(spark, [(0, 5, "a"), (1, 5, None), (2, 9, "b"), (3, None, "b")], "row long, v int, s string")
    got = {r["column"]: r for r in profile.profile(df).collect()}
    assert (got["v"].n_rows, got["v"].n_distinct, got["v"].low, got["v"].high) == (4, 2, 5.0, 9.0)
    assert (got["s"].is_numeric, got["s"].n_distinct) == (False, 2)
    low = profile.extreme_locations(df, "v", "row").where("extreme = 'min'").first()
    assert (low.value, low.n_rows, low.first_rows) == (5.0, 2, "0,1")
    with pytest.raises(ValueError):
        profile.extreme_locations(df, "w", "row")
    with pytest.raises(TypeError):
        profile.extreme_locations(df, "s", "row")


def test_private_scan_by_hand():
    """Dense keys are cut; an empty table is one interval; every variant tiles the domain."""
    scan = PrivateScan.clamped(2.0, 1e-2, 1000)
    freqs = [(k, 50) for k in range(1, 40)]
    cuts = list(scan.splits(freqs, Keyed(), "t"))
    assert len(cuts) > 5 and cuts == sorted(cuts)
    assert list(PrivateScan.offline(1.0, 1e-6, 1000).splits([], Keyed(), "t")) == []
    for make in (PrivateScan.offline, PrivateScan.clamped, PrivateScan.key_first):
        spans = format_splits(make(1.0, 1e-3, 500).splits([(k, 30) for k in range(3, 300, 7)], Keyed(), "t"), 500)
        assert spans[0][0] == 1 and spans[-1][1] == 500 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))


def test_generators(spark):
    keys = generators.clustered_keys(spark, 10**6, 4000, seed=3)
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    assert 1 <= low and high <= 10**6 and n == 4000
    dense = keys.groupBy(F.floor(F.col("key") / 1000)).count().orderBy(F.desc("count")).limit(70).agg(F.sum("count")).first()[0]
    assert dense > 2500
    t1, t2, t3 = generators.fk_tables(spark, 10**5, 300, 200, 100)
    assert (t1.columns, t2.columns, t3.columns) == (["A", "B"], ["B", "C"], ["C", "D"])
    assert t1.where("A < 1 OR A > 999").count() == 0
    a, b, c, d = generators.same_key_tables(spark, 10**5, 50, 40, 30, 20)
    assert [x.count() for x in (a, b, c, d)] == [50, 40, 30, 20] and c.columns == ["Key", "Attr_C"]
    assert generators.same_key_tables(spark, 100, 5, 5, attributes=False)[0].columns == ["Key"]
    assert generators.sparse_keys(spark, 10**6, 500).count() == 500
    mock = generators.mock_keys(spark)
    assert mock.where("key BETWEEN 11 AND 39 OR key BETWEEN 46 AND 89").count() == 0
    assert all(5 <= r["count"] <= 14 for r in mock.where("key <= 10").groupBy("key").count().collect())


def test_csv_and_sinks(spark, tmp_path):
    path = tmp_path / "loan.csv"
    path.write_text('"loan_id";"account_id";"date";"amount";"duration";"payments";"status"\n1;7;930101;100;36;2.5;A\n2;;930102;200;36;2.5;B\n3;8;930103;0;12;1.0;C\n')
    df = csv.load_keyed(spark, str(path), "account_id", csv.SCHEMAS["loan"], {"duration": 36})
    assert [(r.loan_id, r.account_id) for r in df.collect()] == [(1, 7)]
    assert csv.load_keyed(spark, str(path), "account_id", where={"amount": 0}).count() == 1
    with pytest.raises(csv.MissingTable):
        csv.read_csv(spark, str(tmp_path / "none.csv"), csv.SCHEMAS["loan"])
    events = frame(spark, [("join1", "pairs", 12), ("join1", "sort", 15)], "stage string, kind string, size long")
    sinks.write_cost_log(events, str(tmp_path / "log"))
    assert sorted(spark.read.text(str(tmp_path / "log")).toPandas().value) == ["join1\tpairs\t12", "join1\tsort\t15"]
    assert sinks.join_report("t", bucket.summary(_buckets(spark, (1, 5))), events).endswith("'size': 12}")
    assert "1 buckets" in sinks.report("t", bucket.summary(_buckets(spark, (1, 5))))


def test_tables_and_plain_joins(spark):
    t = Table("t", frame(spark, [(k,) for k in (1, 1, 1, 2, 2, 3, 4, 5, 5)], "key long"), 5, 2)
    assert t.true_max_freq() == 3
    assert 3 <= t.noisy_max_freq(1.0, 1e-3, Keyed()) <= 3 + ShiftedGeometric(1.0, 1e-3, 2).upper
    assert Table("e", t.rows.limit(0), 5).true_max_freq() == 0
    a, b = frame(spark, [(1, "x"), (None, "y")], "k int, v string"), frame(spark, [(1, "z"), (None, "w")], "k int, v string")
    assert join_tables(a, b, "k").collect() == [(1, "x", "z")]
    assert join_tables(a, b, "k", null_keys_match=True).count() == 2
    assert join_tables(a, b, "k", {"v": "none"}, how="right").count() == 2


def test_multi_key_frequency(spark):
    df = frame(spark, [(1, 5), (1, 6), (2, 5), (3, 5)], "a long, b long")
    assert frequency.multi_key_max_freq(df, [F.col("a"), F.col("b")]).first().max_freq == 3
    assert frequency.multi_key_max_freq(df.withColumn("b", F.lit(None).cast("long")), [F.col("a"), F.col("b")]).first().max_freq == 1
    assert frequency.max_freq(frequency.key_freq(df.withColumnRenamed("a", "key").limit(0))).first().max_freq == 0


def test_plans_prune_and_push(spark):
    plan = registry.queries()["q3_count_distinct"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan and "o_totalprice" not in plan


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _plain(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return ""
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return f"{float(x):.9g}"
        return str(x).removesuffix(" 00:00:00")

    return sorted(tuple(value(x) for x in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    if name in registry.oracle_sql():
        want = duck.execute(registry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _plain(got) == _plain(want)
    else:
        assert len(got)
    spark.catalog.clearCache()


#: Where keys lie beyond the declared domain: by query, the domain whose SQL it equals. That is the wider one, or the declared one where its SQL leaves no key out.
BEYOND = {
    "key_freq": 2 * inputs.DOMAIN,
    "max_freq": inputs.DOMAIN,
    "meta_join": inputs.DOMAIN,
    "uniform_buckets": inputs.DOMAIN,
    "padded_buckets": 2 * inputs.DOMAIN,
    "bucket_summary": 2 * inputs.DOMAIN,
    "extracted_rows": inputs.DOMAIN,
    "dp_parts_clamped": 2 * inputs.DOMAIN,
    "dp_parts_keyfirst": 2 * inputs.DOMAIN,
    "single_table": 2 * inputs.DOMAIN,
    "dp_parts_precut": 2 * inputs.DOMAIN,
    "joined_rows": inputs.DOMAIN,
    "batch_sizes": 2 * inputs.DOMAIN,
    "bounded_padding": 2 * inputs.DOMAIN,
    "padded_2way_a": 2 * inputs.DOMAIN,
    "padded_2way_c": 2 * inputs.DOMAIN,
    "count_join_2way": 2 * inputs.DOMAIN,
    "padded_3way_b": 2 * inputs.DOMAIN,
    "padded_q5_a": 2 * inputs.DOMAIN,
    "padded_q6_a": 2 * inputs.DOMAIN,
    "count_join_3way": 2 * inputs.DOMAIN,
    "cost_totals_b": 2 * inputs.DOMAIN,
    "cost_totals_c": 2 * inputs.DOMAIN,
    "cost_log": 2 * inputs.DOMAIN,
}


@pytest.fixture(scope="module")
def beyond(tmp_path_factory):
    """The tables of customers' keys twice, the second time beyond the declared domain, and the SQL of both domains."""
    folder, con = tmp_path_factory.mktemp("beyond"), duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t, key in (("customer", "c_custkey"), ("orders", "o_custkey"), ("events", "user_id")):
        rows = f"SELECT * FROM '{DATA}/{t}.parquet'"
        con.execute(f"COPY ({rows} UNION ALL SELECT * REPLACE ({key} + 25000 AS {key}) FROM ({rows})) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    code = "import json; from padlake.plans import registry; print(json.dumps(registry.oracle_sql()))"
    env = os.environ | {"PADLAKE_DOMAIN": str(2 * inputs.DOMAIN)}
    wider = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], env=env, capture_output=True, text=True, check=True, timeout=120)
    return str(folder), con, {inputs.DOMAIN: registry.oracle_sql(), 2 * inputs.DOMAIN: json.loads(wider.stdout)}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", BEYOND)
def test_keys_beyond_the_declared_domain_are_in_the_result(spark, beyond, name):
    folder, con, sql = beyond
    got, want = registry.queries()[name](spark, folder).toPandas(), con.execute(sql[BEYOND[name]][name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _plain(got) == _plain(want)
    spark.catalog.clearCache()


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", ["max_freq", "meta_join"])
def test_the_largest_frequency_may_lie_beyond_the_declared_domain(spark, beyond, tmp_path, name):
    """One key beyond is the most frequent: it counts, while the SQL of the declared domain doesn't see it."""
    con, sql = duckdb.connect(), beyond[2]
    for t, more in (("customer", ""), ("events", ""), ("orders", f"UNION ALL SELECT * REPLACE (25000 AS o_custkey, '1-URGENT' AS o_orderpriority) FROM '{DATA}/orders.parquet'")):
        con.execute(f"COPY (SELECT * FROM '{DATA}/{t}.parquet' {more}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = _plain(registry.queries()[name](spark, str(tmp_path)).toPandas())
    declared, wider = (_plain(con.execute(sql[d][name]).df()) for d in (inputs.DOMAIN, 2 * inputs.DOMAIN))
    assert got == wider != declared
    spark.catalog.clearCache()


def test_the_domain_holds_every_key(spark, tmp_path):
    """Keys begin at 0, the domain at 1; null keys and empty tables leave the domain as declared; the largest table counts."""
    for last, want in ((None, 1), (0, 1), (inputs.DOMAIN - 1, 1), (inputs.DOMAIN, 2), (5 * inputs.DOMAIN, 8)):
        frame(spark, [(3, "1-URGENT"), (last, "none")], "o_custkey int, o_orderpriority string").write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
        frame(spark, [(7,)], "c_custkey long").where(F.lit(last is not None)).write.mode("overwrite").parquet(str(tmp_path / "customer.parquet"))
        for names in (("urgent",), ("disp",), ("account", "urgent")):
            assert inputs.domain_of(spark, str(tmp_path), *names) == want * inputs.DOMAIN
