"""Queries over histograms, synopses and profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from padlake.functions.noise import Keyed
from padlake.operators import profile as profiles
from padlake.operators import synopsis as syn
from padlake.sources.tables import table

SOURCE, E = Keyed(), 0.5
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_HIST_SQL = f"WITH {syn.histogram_sql('h', 'orders', 'o_totalprice')}"
_BOTH_SQL = f"{_HIST_SQL}, pos AS ({syn.noisy_sql('h', E, SOURCE, 'price')}), neg AS ({syn.noisy_sql('h', E, SOURCE, 'price', True)})"


def _hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syn.histogram(table(spark, sf_dir, "orders"), "o_totalprice")


@query(f"{_HIST_SQL} SELECT * FROM h")
def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hist(spark, sf_dir)


@query(f"""WITH {syn.histogram_sql('h', 'orders', 'o_totalprice', 16, "o_orderstatus = 'F'")} SELECT * FROM h""")
def hist_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen bins of filtered rows."""
    return syn.histogram(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_totalprice", 16)


@query(f"{_BOTH_SQL} SELECT bin, cnt::BIGINT AS cnt FROM pos")
def hist_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syn.noisy_histogram(_hist(spark, sf_dir), E, SOURCE, "price")


@query(f"{_BOTH_SQL} SELECT bin, cnt::BIGINT AS cnt FROM neg")
def hist_noisy_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syn.noisy_histogram_negative(_hist(spark, sf_dir), E, SOURCE, "price")


@query(f"""{_BOTH_SQL} SELECT bin, greatest((SELECT sum(cnt) FROM h) - sum(cnt) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::BIGINT AS lo,
    least(sum(cnt) OVER (ORDER BY bin), (SELECT sum(cnt) FROM h))::BIGINT AS hi FROM pos""")
def dp_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hist(spark, sf_dir)
    return syn.dp_indexes(h, syn.noisy_histogram(h, E, SOURCE, "price"))


@query(f"{_BOTH_SQL} {syn.CDF_SQL}")
def cdf_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hist(spark, sf_dir)
    return syn.cdf_indexes(syn.noisy_histogram(h, E, SOURCE, "price"), syn.noisy_histogram_negative(h, E, SOURCE, "price"))


@query(syn.max_frequency_sql("orders", "o_custkey", E, SOURCE, "cust"))
def noisy_max_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syn.noisy_max_frequency(table(spark, sf_dir, "orders"), "o_custkey", E, SOURCE, "cust")


@query(f"{_BOTH_SQL}, i AS ({syn.CDF_SQL}) SELECT pos.bin, pos.cnt::BIGINT AS positive, neg.cnt::BIGINT AS negative, i.lo, i.hi, m.max_freq FROM pos JOIN neg USING (bin) JOIN i USING (bin), ({syn.max_frequency_sql('orders', 'o_totalprice', E, SOURCE, 'price')}) m")
def synopsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole synopsis of a column."""
    return syn.synopsis(table(spark, sf_dir, "orders"), "o_totalprice", E, SOURCE, "price")


#: Experiment: (name, table, column, filter).
SYNOPSES = (
    ("account_all", "customer", "c_custkey", "true"),
    ("account_18", "customer", "c_custkey", "c_nationkey = 18"),
    ("client_all", "orders", "o_custkey", "true"),
    ("client_f", "orders", "o_custkey", "o_orderstatus = 'F'"),
    ("trans_all", "events", "user_id", "true"),
    ("trans_click", "events", "user_id", "event_type = 'click'"),
    ("order_all", "orders", "o_totalprice", "true"),
    ("order_urgent", "orders", "o_totalprice", "o_orderpriority = '1-URGENT'"),
)


def _experiment_sql() -> str:
    ctes, out = [], []
    for n, t, c, where in SYNOPSES:
        ctes.append(syn.histogram_sql(n, t, c, syn.BINS, where))
        out.append(f"SELECT '{n}' AS name, bin, cnt::BIGINT AS positive FROM ({syn.noisy_sql(n, E, SOURCE, n)})")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(out)


@query(_experiment_sql())
def synopsis_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive histograms of eight columns and filters."""
    parts = [syn.noisy_histogram(syn.histogram(table(spark, sf_dir, t).where(where), c), E, SOURCE, n).select(F.lit(n).alias("name"), "bin", F.col("cnt").alias("positive")) for n, t, c, where in SYNOPSES]
    first, *rest = parts
    for p in rest:
        first = first.union(p)
    return first


@query("SELECT count(*)::BIGINT AS n FROM orders WHERE o_orderpriority = '1-URGENT'")
def count_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syn.count_where(table(spark, sf_dir, "orders"), "o_orderpriority", "1-URGENT")


_COLUMNS = (("c_custkey", True), ("c_name", False), ("c_nationkey", True), ("c_acctbal", True), ("c_mktsegment", False))


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {str(n).lower()} AS is_numeric, count(*)::BIGINT AS n_rows, count(DISTINCT {c})::BIGINT AS n_distinct, "
    + (f"min({c})::DOUBLE AS low, max({c})::DOUBLE AS high" if n else "NULL::DOUBLE AS low, NULL::DOUBLE AS high") + " FROM customer" for c, n in _COLUMNS))
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.profile(table(spark, sf_dir, "customer"))


@query("SELECT 'customer' AS name, count(*)::BIGINT AS n_rows, 5::BIGINT AS n_columns, 3::BIGINT AS n_numeric, 2::BIGINT AS n_other FROM customer")
def table_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.table_summary(table(spark, sf_dir, "customer"), "customer")


@query("""SELECT extreme, any_value(l_quantity)::DOUBLE AS value, count(*)::BIGINT AS n_rows, array_to_string(list_sort(list(row ORDER BY row))[1:5], ',') AS first_rows FROM (
    SELECT l_orderkey * 10 + l_linenumber AS row, l_quantity, e.extreme FROM lineitem, (SELECT unnest(['min', 'max']) AS extreme) e
    WHERE l_quantity = CASE WHEN e.extreme = 'min' THEN (SELECT min(l_quantity) FROM lineitem) ELSE (SELECT max(l_quantity) FROM lineitem) END) GROUP BY extreme""")
def extreme_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return profiles.extreme_locations(df, "l_quantity", "row")


@query("""SELECT least(floor((x - low) * 50 / (high - low)), 49)::BIGINT AS bin, count(*)::BIGINT AS cnt
    FROM (SELECT c_acctbal AS x FROM customer WHERE c_acctbal IS NOT NULL), (SELECT min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer) GROUP BY 1""")
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.density(table(spark, sf_dir, "customer"), "c_acctbal")
