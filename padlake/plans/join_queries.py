"""Queries over joins: aligned and padded ones, by every route, their costs, and plain ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from padlake.functions.metadata import PRESETS, JoinMeta
from padlake.functions.noise import Keyed, ShiftedGeometric
from padlake.operators import bucket, frequency, interval_join, partition
from padlake.operators.interval_join import Side
from padlake.operators.tables import join_tables
from padlake.plans.inputs import DOMAIN, MOST, ORDER_DOMAIN, declared, domain_of, freq, freq_sql, freqs, rows
from padlake.plans.private_queries import named
from padlake.plans.routes import Route, Run
from padlake.sources.tables import table

SOURCE = Keyed()
PAD = ShiftedGeometric(0.4, 1e-4)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# Alignment, batches and bounds, on two uniform bucketings of unlike widths


def _sides(spark: SparkSession, sf_dir: str) -> tuple[Side, Side]:
    domain, out = domain_of(spark, sf_dir, "account", "urgent"), []
    for t, bins in (("account", 6), ("urgent", 9)):
        f = freq(spark, sf_dir, t, domain)
        out.append(Side(f, bucket.buckets(f, partition.uniform_parts(spark, domain, bins), domain, PAD, SOURCE, t), domain))
    return out[0], out[1]


_SIDES_SQL = "WITH " + freq_sql("account", "urgent") + ", " + ", ".join(
    f"{t}_parts AS ({partition.uniform_parts_sql(DOMAIN, bins)}), {bucket.buckets_sql(t, f'{t}_freq', f'{t}_parts', PAD, SOURCE, t)}" for t, bins in (("account", 6), ("urgent", 9))
)
_PAIRS_SQL = f"{_SIDES_SQL}, {interval_join.pairs_sql('p', 'account', 'urgent', 2)}"
_LO_HI = 'start AS lo, "end" AS hi'


@query(f"{_PAIRS_SQL} SELECT pair::BIGINT AS pair, {_LO_HI}, a_part::BIGINT AS a_part, b_part::BIGINT AS b_part FROM p")
def interval_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return named(interval_join.align(a.buckets, b.buckets))


@query(f"{_PAIRS_SQL} SELECT batch::BIGINT AS batch, min(start) AS lo, max(\"end\") AS hi, count(*)::BIGINT AS n_pairs FROM p GROUP BY batch")
def batch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return interval_join.pairs(a.buckets, b.buckets, 2).groupBy("batch").agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.count("*").alias("n_pairs"))


@query(f"{_PAIRS_SQL} SELECT pair::BIGINT AS pair, a_rows::BIGINT AS a_rows, b_rows::BIGINT AS b_rows, a_met, b_met, emits FROM p")
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What batches have met of each side, retained buckets included."""
    a, b = _sides(spark, sf_dir)
    return interval_join.pairs(a.buckets, b.buckets, 2).select("pair", "a_rows", "b_rows", "a_met", "b_met", "emits")


@query(f"{_SIDES_SQL}, {interval_join.padded_join_sql('j', 'account', 'urgent', 2, PAD, SOURCE, 'bound', ('3', '7'))} SELECT part_id::BIGINT AS part_id, {_LO_HI}, compared, n_real AS real, drawn, n_dummy FROM j")
def bounded_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A padded join held at its bound."""
    a, b = _sides(spark, sf_dir)
    return named(interval_join.padded_join(a, b, 2, PAD, SOURCE, "bound", (JoinMeta(3), JoinMeta(7)))[1])


@query(f"{_PAIRS_SQL} SELECT pair::BIGINT AS pair, (a_rows * b_rows)::BIGINT AS n_pairs, coalesce((SELECT sum(x.freq * y.freq) FROM account_freq x JOIN urgent_freq y ON x.key = y.key WHERE x.key BETWEEN p.start AND p.\"end\"), 0)::BIGINT AS n_matches FROM p")
def strict_oblivious_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every compared pair of rows is made, and counted by aligned interval."""
    a, b = _sides(spark, sf_dir)
    left, right = (bucket.padded_rows(rows(spark, sf_dir, t, s.domain).select("key"), s.buckets, s.domain) for t, s in (("account", a), ("urgent", b)))
    met = interval_join.strict_pairs(left, right, a.buckets, b.buckets, 2, a.domain)
    counts = met.groupBy("pair").agg(F.count("*").alias("n_pairs"), F.sum(F.col("is_match").cast("long")).alias("n_matches"))
    every = interval_join.align(a.buckets, b.buckets).select("pair")
    return every.join(counts, "pair", "left").select("pair", F.coalesce("n_pairs", F.lit(0)).cast("long").alias("n_pairs"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"))


# Routes


def _route(preset: str, kind: str, bounded: bool) -> Route:
    budget, merges = PRESETS[preset]
    return Route(preset, kind, budget, merges, DOMAIN, bounded)


#: name: (route, tables in join order); the key columns are all customers'.
ROUTES = {
    "padded_2way_a": (_route("two_way_a", "pipelined", True), ("urgent", "trans")),
    "padded_2way_c": (_route("two_way_c", "uniform", True), ("urgent", "trans")),
    "padded_3way_a": (_route("same_key_a", "pipelined", False), ("orders_all", "trans", "account")),
    "padded_3way_b": (_route("same_key_b", "repartitioned", False), ("orders_all", "trans", "account")),
    "padded_3way_c": (_route("same_key_c", "uniform", False), ("orders_all", "trans", "account")),
    "padded_4way": (_route("four_way", "pipelined", False), ("orders_all", "trans", "account", "disp")),
    "padded_q3": (_route("q3", "pipelined", True), ("account", "disp")),
    "padded_q5_a": (_route("q5_a", "pipelined", True), ("account", "trans", "urgent")),
    "padded_q5_b": (_route("q5_b", "repartitioned", True), ("account", "trans", "urgent")),
    "padded_q5_c": (_route("q5_c", "uniform", True), ("account", "trans", "urgent")),
    "padded_q6_a": (_route("q6_a", "pipelined", True), ("urgent", "trans", "disp")),
    "padded_q6_b": (_route("q6_b", "repartitioned", True), ("urgent", "trans", "disp")),
    "padded_q6_c": (_route("q6_c", "uniform", True), ("urgent", "trans", "disp")),
}


def routed(spark: SparkSession, sf_dir: str, route: Route, tables: tuple[str, ...]) -> Run:
    """The route over the tables' own domain."""
    domain = domain_of(spark, sf_dir, *tables)
    return replace(route, domain=domain).same_key(freqs(spark, sf_dir, *tables, domain=domain))


def _route_query(name: str, route: Route, tables: tuple[str, ...]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return named(routed(spark, sf_dir, route, tables).side.buckets)

    run.__name__ = name
    run.__doc__ = f"The last batches of the {route.kind} route over {', '.join(tables)}."
    return query(f"{route.same_key_sql(freq_sql(*tables), list(tables))} SELECT part_id::BIGINT AS part_id, {_LO_HI}, n_real, n_dummy FROM j{len(tables) - 2}")(run)


for _name, (_r, _tables) in ROUTES.items():
    _route_query(_name, _r, _tables)


def _cost_query(name: str, route: Route, tables: tuple[str, ...]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return interval_join.cost_totals(routed(spark, sf_dir, route, tables).costs())

    run.__name__ = name
    run.__doc__ = f"Comparisons, scans and sorts of the {route.kind} route over {', '.join(tables)}."
    joins = range(len(tables) - 1)
    every = " UNION ALL ".join(f"SELECT compared, n_real + n_dummy AS padded FROM j{k}" for k in joins)
    again = "SELECT NULL AS n_in, NULL AS n_out WHERE false"
    if route.kind == "repartitioned":
        again = " UNION ALL ".join(f"SELECT (SELECT sum(n_real + n_dummy) FROM j{k - 1}) AS n_in, (SELECT sum(n_real + n_dummy) FROM again{k}) AS n_out" for k in joins if k)
    return query(f"""{route.same_key_sql(freq_sql(*tables), list(tables))}, every AS ({every}), again AS ({again})
        SELECT kind, sum(total)::BIGINT AS total FROM (
            SELECT 'pairs' AS kind, sum(compared) AS total FROM every UNION ALL
            SELECT 'scan', sum(compared + padded) FROM every UNION ALL
            SELECT 'sort', sum(compared + padded) FROM every UNION ALL
            SELECT 'partition', n_in FROM again UNION ALL
            SELECT 'scan', n_out FROM again UNION ALL
            SELECT 'sort', n_in + n_in + n_out FROM again) GROUP BY kind""")(run)


_cost_query("cost_totals_a", *ROUTES["padded_q5_a"])
_cost_query("cost_totals_b", *ROUTES["padded_q5_b"])
_cost_query("cost_totals_c", *ROUTES["padded_q5_c"])


@query(f"WITH {freq_sql('account', 'trans', 'urgent')} SELECT key, (account_freq.freq * trans_freq.freq * urgent_freq.freq)::BIGINT AS freq FROM account_freq JOIN trans_freq USING (key) JOIN urgent_freq USING (key)")
def count_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of a three-way join, without its rows."""
    return frequency.joined_freq(*freqs(spark, sf_dir, "account", "trans", "urgent").values())


def _count_route(preset: str, kind: str) -> Route:
    budget, merges = PRESETS[preset]
    return Route(preset, kind, budget if budget.meta_share else replace(budget, meta_share=0.2, shares=4), merges, DOMAIN)


_COUNTS = {"count_join_3way_again": (_count_route("count_three_way", "repartitioned"), ("urgent", "trans", "account")), **{"count_join_2way": (_count_route("count_two_way", "pipelined"), ("urgent", "trans")), "count_join_3way": (_count_route("count_three_way", "pipelined"), ("urgent", "trans", "account"))}}
for _name, (_r, _tables) in _COUNTS.items():
    _route_query(_name, _r, _tables)


# The chain over two keys: customers, orders, lines


def _fk_route() -> Route:
    budget, merges = PRESETS["fk"]
    return Route("fk", "repartitioned", budget, merges, ORDER_DOMAIN)


_CHAIN_SQL = _fk_route().chain_sql(
    f"""first_freq AS (SELECT (c_custkey + 1)::BIGINT AS key, count(*)::BIGINT AS freq FROM customer GROUP BY c_custkey),
    bridge_freq AS (SELECT (o_custkey + 1)::BIGINT AS key, count(*)::BIGINT AS freq FROM orders GROUP BY o_custkey),
    last_freq AS (SELECT (l_orderkey + 1)::BIGINT AS key, count(*)::BIGINT AS freq FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)""",
    "SELECT greatest((SELECT max(freq) FROM bridge_freq), (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)), 1) AS m",
    "SELECT (o_orderkey + 1)::BIGINT AS key, sum(f.freq)::BIGINT AS freq FROM orders JOIN first_freq f ON f.key = o_custkey + 1 GROUP BY o_orderkey",
)


@query(f"{_CHAIN_SQL} SELECT part_id::BIGINT AS part_id, {_LO_HI}, n_real, n_dummy FROM j1")
def padded_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last batches of a chain of joins on two keys, customers, orders and lines, with a key switch between."""
    domain = ORDER_DOMAIN
    orders = table(spark, sf_dir, "orders").select(declared(F.col("o_custkey") + 1, domain).alias("b"), declared(F.col("o_orderkey") + 1, domain).alias("c"))
    customers, lines = freq(spark, sf_dir, "account", domain), freq(spark, sf_dir, "lines", domain)
    bridge = frequency.key_freq(frequency.keyed(orders, F.col("b"), domain))

    def rekey(joined: DataFrame) -> DataFrame:
        kept = frequency.keyed(orders, F.col("c"), domain).join(customers.select(F.col("key").alias("b"), F.col("freq").alias("times")), "b")
        return kept.groupBy("key").agg(F.sum("times").cast("long").alias("freq"))

    return named(_fk_route().chain(customers, bridge, lines, rekey, frequency.multi_key_max_freq(orders, [F.col("b"), F.col("c")])).side.buckets)


# Rows


@query("SELECT o_orderkey, event_id, value FROM orders JOIN events ON o_custkey = user_id WHERE o_orderpriority = '1-URGENT' AND event_type = 'click'")
def joined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The real rows of a padded join."""
    return interval_join.joined_rows(rows(spark, sf_dir, "urgent", MOST), rows(spark, sf_dir, "trans", MOST)).select("o_orderkey", "event_id", "value")


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("tag"))
    return left, table(spark, sf_dir, "nation").where("n_regionkey IN (1, 2, 3)").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("tag"), "n_regionkey")


_LEFT = "(SELECT c_nationkey AS key, c_custkey AS id, c_mktsegment AS tag FROM customer WHERE c_nationkey < 12) a"
_RIGHT = "(SELECT n_nationkey AS key, n_name AS tag, n_regionkey FROM nation WHERE n_regionkey IN (1, 2, 3)) b"


def _join_query(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return interval_join.joined_rows(*_pair(spark, sf_dir), "suffix", how=how)

    run.__name__ = f"join_{how}"
    run.__doc__ = f"A plain {how} join of filtered tables, with suffixes where both have a column."
    return query(f"SELECT coalesce(a.key, b.key) AS key, a.id, a.tag AS tag_x, b.tag AS tag_y, b.n_regionkey FROM {_LEFT} {how.upper()} JOIN {_RIGHT} ON a.key = b.key")(run)


for _how in ("inner", "left", "right", "full"):
    _join_query(_how)


@query("""SELECT coalesce(a.key, b.key) AS key, a.id, a.tag AS tag_x, b.tag AS tag_y FROM
    (SELECT CASE WHEN c_nationkey > 2 THEN c_nationkey END AS key, c_custkey AS id, c_mktsegment AS tag FROM customer WHERE c_mktsegment = 'BUILDING') a
    FULL JOIN (SELECT CASE WHEN n_nationkey > 1 THEN n_nationkey END AS key, n_name AS tag FROM nation) b ON a.key IS NOT DISTINCT FROM b.key""")
def join_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full join in which null keys match each other."""
    left = table(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") > 2, F.col("c_nationkey")).alias("key"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("tag"))
    right = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") > 1, F.col("n_nationkey")).alias("key"), F.col("n_name").alias("tag"))
    return join_tables(left, right, "key", {"tag": "BUILDING"}, how="full", null_keys_match=True)


@query(f"SELECT a.key, a.id, b.tag, b.n_regionkey FROM {_LEFT} JOIN {_RIGHT} ON a.key = b.key")
def join_right_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a column that both sides have, the right one stays."""
    return interval_join.joined_rows(*_pair(spark, sf_dir))


@query("""SELECT count(*)::BIGINT AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F') d
    JOIN events e ON d.o_custkey = e.user_id AND e.event_type = 'click' JOIN customer c ON c.c_custkey = d.o_custkey JOIN orders o ON o.o_custkey = d.o_custkey AND o.o_orderpriority = '1-URGENT'""")
def ground_truth_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the four-table chain without privacy."""
    d = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderstatus").distinct().withColumnRenamed("o_custkey", "key")
    e = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("key"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("key"))
    return d.join(e, "key").join(c, "key").join(o, "key").agg(F.count("*").alias("n"))
