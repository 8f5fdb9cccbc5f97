"""Queries over noise, metadata, partitions and buckets."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from padlake.functions.metadata import JoinMeta, meta_sql
from padlake.functions.noise import BoundedLaplace, Keyed, Laplace, ShiftedGeometric
from padlake.operators import bucket, frequency, partition
from padlake.operators.held import held
from padlake.operators.partition import PrivateScan
from padlake.operators.tables import Table
from padlake.plans.inputs import DOMAIN, MOST, domain_of, freq, freq_sql, freqs, rows
from padlake.sources.tables import table

SOURCE = Keyed()
GEOMETRIC, PAD = ShiftedGeometric(0.5, 1e-5, 2), ShiftedGeometric(0.4, 1e-4)
PLAIN, BOUNDED = Laplace(0.5, 2.0), BoundedLaplace(0.5, 2.0, 1e-5)
BINS = 8
#: Scans of a domain, on which their thresholds depend.
SCANS = {
    "offline": partial(PrivateScan.offline, 0.5, 1e-5),
    "clamped": partial(PrivateScan.clamped, 0.5, 1e-4),
    "keyfirst": partial(PrivateScan.key_first, 0.5, 1e-4),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _uv(what: str) -> tuple:
    return SOURCE.column(what, F.col("key"), "u"), SOURCE.column(what, F.col("key"), "v")


def _uv_sql(what: str) -> tuple[str, str]:
    return SOURCE.sql(f"'{what}'", "key", "'u'"), SOURCE.sql(f"'{what}'", "key", "'v'")


_KEYS_SQL = "(SELECT c_custkey + 1 AS key FROM customer)"


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("key"))


@query(f"SELECT key, {GEOMETRIC.two_sided_sql(*_uv_sql('geom'))} AS two_sided, {GEOMETRIC.noise_sql(*_uv_sql('geom'))} AS noise FROM {_KEYS_SQL}")
def noise_geometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided geometric noise, and as it is shifted and clamped."""
    return _keys(spark, sf_dir).select("key", GEOMETRIC.two_sided(*_uv("geom")).alias("two_sided"), GEOMETRIC.noise(*_uv("geom")).alias("noise"))


@query(f"SELECT key, floor({BOUNDED.noise_sql(_uv_sql('lap')[0])} * 1000)::BIGINT AS bounded, floor({PLAIN.noise_sql(_uv_sql('lap')[0])} * 1000)::BIGINT AS plain FROM {_KEYS_SQL}")
def noise_laplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laplace noise, clamped and not, in thousandths."""
    return _keys(spark, sf_dir).select("key", F.floor(BOUNDED.noise(_uv("lap")[0]) * 1000).alias("bounded"), F.floor(PLAIN.noise(_uv("lap")[0]) * 1000).alias("plain"))


@query(f"SELECT key, floor({PLAIN.seal_sql('(key % 100)', '60')} * 1000000)::BIGINT AS millionths FROM {_KEYS_SQL}")
def seal_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that noise lifts a load over a threshold."""
    return _keys(spark, sf_dir).select("key", F.floor(PLAIN.seal_column(F.col("key") % 100, F.lit(60)) * 1000000).alias("millionths"))


@query(f"WITH {freq_sql('orders_all')} SELECT key, freq FROM orders_all_freq")
def key_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freq(spark, sf_dir, "orders_all", domain_of(spark, sf_dir, "orders_all"))


@query("SELECT (o_custkey + 1)::BIGINT AS key, count(*)::BIGINT AS freq, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS payloads FROM orders GROUP BY o_custkey")
def key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed groups with their rows."""
    df = rows(spark, sf_dir, "orders_all", 1 << 62).select("key", "o_orderkey", "o_orderstatus")
    payload = F.array_join(F.transform("payloads", lambda r: F.concat_ws(":", r["o_orderkey"].cast("string"), r["o_orderstatus"])), ",")
    return frequency.key_groups(df).select("key", "freq", payload.alias("payloads"))


@query(f"WITH {freq_sql('orders_all')} SELECT max(freq)::BIGINT AS max_freq FROM orders_all_freq")
def max_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.max_freq(freq(spark, sf_dir, "orders_all", domain_of(spark, sf_dir, "orders_all")))


@query("SELECT greatest((SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)), (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)), 1)::BIGINT AS max_freq")
def multi_key_max_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.multi_key_max_freq(table(spark, sf_dir, "lineitem"), [F.col("l_orderkey"), F.col("l_partkey")])


_METAS = ("account", "trans", "urgent")


@query("WITH " + freq_sql(*_METAS) + " " + " UNION ALL ".join(f"SELECT '{t}' AS name, {meta_sql('max(freq)', 0.1, 1e-6, SOURCE, t)} AS a, 1::BIGINT AS b FROM {t}_freq" for t in _METAS))
def noisy_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy frequency bounds of base tables."""
    found = [(t, JoinMeta.of_frequency(frequency.max_freq(f).first().max_freq, 0.1, 1e-6, SOURCE, t)) for t, f in freqs(spark, sf_dir, *_METAS).items()]
    return spark.createDataFrame([(t, m.a, m.b) for t, m in found], "name string, a long, b long")


@query("WITH " + freq_sql(*_METAS) + ", " + ", ".join(f"m_{t} AS (SELECT {meta_sql('max(freq)', 0.1, 1e-6, SOURCE, t)} AS a, 1 AS b FROM {t}_freq)" for t in _METAS) + """,
    j1 AS (SELECT x.a * y.a AS a, greatest(x.a * y.b, y.a * x.b) AS b FROM m_account x, m_trans y),
    j2 AS (SELECT x.a * y.a AS a, greatest(x.a * y.b, y.a * x.b) AS b FROM j1 x, m_urgent y)
    SELECT 1 AS step, a::BIGINT AS a, b::BIGINT AS b FROM j1 UNION ALL SELECT 2, a::BIGINT, b::BIGINT FROM j2""")
def meta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata along a chain of joins."""
    domain = domain_of(spark, sf_dir, *_METAS)
    x, y, z = (JoinMeta.of_frequency(frequency.max_freq(f).first().max_freq, 0.1, 1e-6, SOURCE, t) for t, f in freqs(spark, sf_dir, *_METAS, domain=domain).items())
    return spark.createDataFrame([(1, x.join(y).a, x.join(y).b), (2, x.join(y).join(z).a, x.join(y).join(z).b)], "step int, a long, b long")


_TABLE_NOISE = ShiftedGeometric(0.2, 1e-5, 2)


@query("WITH " + freq_sql(*_METAS) + " " + " UNION ALL ".join(
    f"SELECT '{t}' AS name, max(freq)::BIGINT AS true_max, (max(freq) + {_TABLE_NOISE.noise_sql(*(SOURCE.sql(chr(39) + 'table' + chr(39), chr(39) + t + chr(39), chr(39) + x + chr(39)) for x in 'uv'))})::BIGINT AS noisy_max FROM {t}_freq" for t in _METAS))
def table_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest frequencies of tables, true and private."""
    tables = [Table(t, rows(spark, sf_dir, t), DOMAIN, 2) for t in _METAS]
    return spark.createDataFrame([(t.name, t.true_max_freq(), t.noisy_max_freq(0.2, 1e-5, SOURCE)) for t in tables], "name string, true_max long, noisy_max long")


@query(f"""SELECT {meta_sql('m', 0.1, 1e-6, SOURCE, 'bridge')} AS a, 1::BIGINT AS b FROM (SELECT greatest(
    (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)), (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)))::BIGINT AS m)""")
def noisy_meta_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noisy frequency bound of a table that joins on two keys, one draw for both."""
    most = frequency.multi_key_max_freq(table(spark, sf_dir, "orders"), [F.col("o_custkey"), F.col("o_orderkey")]).first().max_freq
    m = JoinMeta.of_frequency(most, 0.1, 1e-6, SOURCE, "bridge")
    return spark.createDataFrame([(m.a, m.b)], "a long, b long")


def named(parts: DataFrame) -> DataFrame:
    """Interval ends under names that are no keywords."""
    return parts.withColumnsRenamed({"start": "lo", "end": "hi"})


_LO_HI = 'start AS lo, "end" AS hi'


@query(f"SELECT part_id::BIGINT AS part_id, {_LO_HI} FROM ({partition.uniform_parts_sql(DOMAIN, 7)})")
def uniform_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(partition.uniform_parts(spark, DOMAIN, 7))


@query(f"SELECT least((c_custkey + 1 - 1) // {DOMAIN // BINS}, {BINS - 1})::BIGINT AS part_id, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def uniform_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each equal interval, by arithmetic; the last one takes what lies beyond the domain too."""
    return rows(spark, sf_dir, "account", MOST).groupBy(partition.uniform_bucket(F.col("key"), DOMAIN, BINS).alias("part_id")).agg(F.count("*").alias("n"))


_BUCKETS_SQL = f"WITH {freq_sql('urgent')}, parts AS ({partition.uniform_parts_sql(DOMAIN, BINS)}), {bucket.buckets_sql('b', 'urgent_freq', 'parts', PAD, SOURCE, 'urgent')}"


def _buckets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Padded buckets of equal intervals, and their domain."""
    domain = domain_of(spark, sf_dir, "urgent")
    return bucket.buckets(freq(spark, sf_dir, "urgent", domain), partition.uniform_parts(spark, domain, BINS), domain, PAD, SOURCE, "urgent"), domain


@query(f"{_BUCKETS_SQL} SELECT part_id::BIGINT AS part_id, {_LO_HI}, n_real, n_dummy FROM b")
def padded_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(_buckets(spark, sf_dir)[0])


@query(f"""{_BUCKETS_SQL} SELECT count(*)::BIGINT AS n_buckets, sum((n_real = 0)::INT)::BIGINT AS n_empty, sum(n_real)::BIGINT AS n_real, sum(n_dummy)::BIGINT AS n_dummy,
    round(sum(n_real + n_dummy) / sum(n_real), 6) AS ratio, round(sum(n_real + n_dummy) / count(*), 6) AS mean_size FROM b""")
def bucket_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket.summary(_buckets(spark, sf_dir)[0])


@query(f"{_BUCKETS_SQL} SELECT part_id::BIGINT AS part_id, 'real' AS kind, n_real AS n FROM b WHERE n_real > 0 UNION ALL SELECT part_id::BIGINT, 'dummy', n_dummy FROM b WHERE n_dummy > 0")
def materialized_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real rows and dummies as rows, counted by bucket."""
    buckets, domain = _buckets(spark, sf_dir)
    padded = bucket.padded_rows(rows(spark, sf_dir, "urgent", domain), buckets, domain)
    return padded.groupBy("part_id", F.when(F.col("is_dummy"), "dummy").otherwise("real").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'")
def extracted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes back when the dummies go again."""
    buckets, domain = _buckets(spark, sf_dir)
    return bucket.real_rows(bucket.padded_rows(rows(spark, sf_dir, "urgent", domain), buckets, domain)).select("o_orderkey", "o_custkey", "o_orderstatus")


def _scan_query(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        domain = domain_of(spark, sf_dir, "urgent")
        return named(partition.private_parts(freq(spark, sf_dir, "urgent", domain), SCANS[kind](domain), SOURCE, "urgent"))

    run.__name__ = f"dp_parts_{kind}"
    run.__doc__ = f"Private intervals by the {kind} scan."
    return query(f"WITH RECURSIVE {freq_sql('urgent')}, {partition.private_parts_sql('p', 'urgent_freq', SCANS[kind](DOMAIN), SOURCE, 'urgent')} SELECT part_id::BIGINT AS part_id, {_LO_HI} FROM p")(run)


for _kind in SCANS:
    _scan_query(_kind)

_SINGLE_SQL = f"WITH RECURSIVE {freq_sql('urgent')}, {partition.private_parts_sql('parts', 'urgent_freq', SCANS['clamped'](DOMAIN), SOURCE, 'urgent')}, {bucket.buckets_sql('b', 'urgent_freq', 'parts', PAD, SOURCE, 'urgent')}"


@query(f"{_SINGLE_SQL} SELECT part_id::BIGINT AS part_id, {_LO_HI}, n_real, n_dummy FROM b")
def single_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table from rows to padded private buckets."""
    domain = domain_of(spark, sf_dir, "urgent")
    f = held(freq(spark, sf_dir, "urgent", domain))
    return named(bucket.buckets(f, partition.private_parts(f, SCANS["clamped"](domain), SOURCE, "urgent"), domain, PAD, SOURCE, "urgent"))


PIECES = 8
_PRECUT_SQL = f"WITH RECURSIVE {freq_sql('urgent')}, {partition.precut_parts_sql('parts', 'urgent_freq', SCANS['offline'](DOMAIN), SOURCE, 'urgent', PIECES)}, {bucket.buckets_sql('b', 'urgent_freq', 'parts', PAD, SOURCE, 'urgent')}"


@query(f"{_PRECUT_SQL} SELECT part_id::BIGINT AS part_id, {_LO_HI}, n_real, n_dummy FROM b")
def dp_parts_precut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of eight pieces of the domain, side by side, and their buckets."""
    domain = domain_of(spark, sf_dir, "urgent")
    f = held(freq(spark, sf_dir, "urgent", domain))
    return named(bucket.buckets(f, partition.private_parts_precut(f, SCANS["offline"](domain), SOURCE, "urgent", PIECES), domain, PAD, SOURCE, "urgent"))
