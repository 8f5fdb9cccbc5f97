"""Queries over sources and sinks: CSV files, synthetic tables, reports and cost logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from padlake.operators import bucket, interval_join
from padlake.operators.tables import join_tables
from padlake.plans.join_queries import ORACLE as JOIN_ORACLE
from padlake.plans.join_queries import ROUTES, routed
from padlake.plans.private_queries import _BUCKETS_SQL, _buckets
from padlake.sources import csv, generators, sinks
from padlake.sources.scratch import shared_folder
from padlake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _path(spark: SparkSession, name: str) -> str:
    """A folder of this session's own, which the query writes anew each time."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{name}"


# CSV: orders as a file of the banking tables' kind, a third of them without a customer


_ORDERS = "o_orderkey LONG, o_custkey LONG, o_orderstatus STRING, o_priority INT, o_totalprice DOUBLE"
_ORDERS_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS o_custkey, o_orderstatus, substr(o_orderpriority, 1, 1)::INT - 1 AS o_priority, o_totalprice FROM orders"


def _orders_csv(spark: SparkSession, sf_dir: str, name: str) -> str:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("o_custkey"),
        "o_orderstatus",
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("o_priority"),
        "o_totalprice",
    )
    path = _path(spark, name)
    csv.write_csv(orders, path)
    return path


@query(f"SELECT * FROM ({_ORDERS_SQL})")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A semicolon file with a schema, as it is."""
    return csv.read_csv(spark, _orders_csv(spark, sf_dir, "csv_scan"), _ORDERS)


@query(f"SELECT * FROM ({_ORDERS_SQL}) WHERE o_custkey IS NOT NULL AND o_priority = 0 AND o_orderstatus = 'F'")
def csv_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's rows that have a key and equal some values, 0 among them."""
    return csv.load_keyed(spark, _orders_csv(spark, sf_dir, "csv_keyed"), "o_custkey", _ORDERS, {"o_priority": 0, "o_orderstatus": "F"})


@query(f"SELECT o_custkey::BIGINT AS o_custkey, count(*)::BIGINT AS n, max(o_priority)::INT AS most FROM ({_ORDERS_SQL}) WHERE o_custkey IS NOT NULL AND o_priority = 0 GROUP BY o_custkey")
def csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a schema: types are inferred, the key becomes a long."""
    rows = csv.load_keyed(spark, _orders_csv(spark, sf_dir, "csv_inferred"), "o_custkey", where={"o_priority": 0})
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_priority").cast("int").alias("most"))


@query("""SELECT a.o_custkey, a.o_orderkey, b.event_id FROM orders a JOIN events b ON a.o_custkey = b.user_id
    WHERE a.o_orderstatus = 'F' AND a.o_orderpriority = '1-URGENT' AND b.event_type = 'click'""")
def table_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of tables that are filtered by several values each."""
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "o_custkey")
    joined = join_tables(table(spark, sf_dir, "orders"), events, "o_custkey", {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, {"event_type": "click"})
    return joined.select("o_custkey", "o_orderkey", "event_id")


# Synthetic tables


_DOMAIN, _AROUND = 1_000_000, [k * 19_000 + 500 for k in range(50)]


@query(generators.keys_sql(10_000, _DOMAIN, _AROUND, "1/key"))
def gen_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic clustered keys around given centres."""
    return generators.clustered_keys(spark, _DOMAIN, 10_000, around=_AROUND)


def _same_key_sql(sizes: tuple[int, ...], attributes: bool, domain: int = 100_000) -> str:
    around, out = generators.centers(domain), []
    for k, n in enumerate(sizes):
        attribute = generators.small_sql(1, 99, f"1/Attr{k}") if attributes else "NULL::BIGINT"
        out.append(f"SELECT '{'ABCD'[k]}' AS name, {generators.clustered_sql(n, domain, around, f'1/Key{k}')} AS key, {attribute} AS attribute FROM {generators._at_sql(n)}")
    return " UNION ALL ".join(out)


def _same_key(spark: SparkSession, sizes: tuple[int, ...], attributes: bool) -> DataFrame:
    out = None
    for k, t in enumerate(generators.same_key_tables(spark, 100_000, *sizes, attributes=attributes)):
        one = t.select(F.lit("ABCD"[k]).alias("name"), F.col("Key").alias("key"), (F.col(f"Attr_{'ABCD'[k]}") if attributes else F.lit(None).cast("long")).alias("attribute"))
        out = out.union(one) if out else one
    return out


@query(_same_key_sql((2000, 1500), True))
def gen_two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two synthetic tables of shared centres, with attributes."""
    return _same_key(spark, (2000, 1500), True)


@query(_same_key_sql((2000, 1500, 1000), True))
def gen_three_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three synthetic tables of shared centres, with attributes."""
    return _same_key(spark, (2000, 1500, 1000), True)


@query(_same_key_sql((2000, 1500, 1000, 500), False))
def gen_four_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four synthetic tables of shared centres, of keys alone."""
    return _same_key(spark, (2000, 1500, 1000, 500), False)


def _fk_sql(domain: int = 100_000) -> str:
    on_b, on_c = generators.centers(domain, seed=1), generators.centers(domain, seed=2)
    key = lambda n, around, tag: generators.clustered_sql(n, domain, around, f"1/{tag}")
    return f"""
    SELECT 1 AS t, {generators.small_sql(1, 999, "1/A1")} AS x, {key(2000, on_b, "B1")} AS y FROM {generators._at_sql(2000)} UNION ALL
    SELECT 2, {key(1500, on_b, "B2")}, {key(1500, on_c, "C2")} FROM {generators._at_sql(1500)} UNION ALL
    SELECT 3, {key(1000, on_c, "C3")}, {generators.small_sql(1, 999, "1/D3")} FROM {generators._at_sql(1000)}"""


@query(_fk_sql())
def gen_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tables of the chain over two keys."""
    every = [t.select(F.lit(k + 1).alias("t"), *[F.col(c).alias(n) for c, n in zip(t.columns, "xy")]) for k, t in enumerate(generators.fk_tables(spark, 100_000, 2000, 1500, 1000))]
    return every[0].union(every[1]).union(every[2])


@query(generators.keys_sql(3000, 10_000_000, generators.centers(10_000_000, 5, 1), "1/key", spread=0.005))
def gen_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few wide clusters in a large domain."""
    return generators.sparse_keys(spark, 10_000_000, 3000)


@query(generators.mock_sql())
def gen_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small table of three spans of keys."""
    return generators.mock_keys(spark)


# Reports and logs


@query(f"""{_BUCKETS_SQL} SELECT concat('urgent: ', count(*), ' buckets, ', sum((n_real = 0)::INT), ' empty, ', sum(n_real), ' real rows, ', sum(n_dummy), ' dummies, ',
    printf('%.2f', round(sum(n_real + n_dummy) / sum(n_real), 6)), 'x, ', printf('%.1f', round(sum(n_real + n_dummy) / count(*), 6)), ' rows a bucket') AS line FROM b""")
def bucket_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that is printed on a padded table."""
    return spark.createDataFrame([(sinks.report("urgent", bucket.summary(_buckets(spark, sf_dir)[0])),)], "line string")


def _log_sql() -> str:
    totals = JOIN_ORACLE["cost_totals_c"]
    return f"SELECT kind, total FROM ({totals}) UNION ALL SELECT 'all' AS kind, sum(total)::BIGINT FROM ({totals})"


@query(_log_sql())
def cost_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of a cost log that a route's events and seconds are written to, read back from its lines."""
    route, tables = ROUTES["padded_q5_c"]
    path = _path(spark, "cost_log")
    seconds = {}
    with sinks.timed(seconds, "route"):
        events = routed(spark, sf_dir, route, tables).costs()
        interval_join.cost_totals(events).collect()
    sinks.write_cost_log(events, path, seconds)
    lines = spark.read.text(path).select(F.split("value", "\t").alias("x"))
    return lines.where("x[0] = 'total' AND x[1] != 'seconds'").select(F.col("x")[1].alias("kind"), F.col("x")[2].cast("long").alias("total"))
