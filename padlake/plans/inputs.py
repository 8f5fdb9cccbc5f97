"""The keyed tables that the queries run on, in Spark and as SQL. Keys of the test tables begin at 0, those of a domain at 1."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from padlake.operators.frequency import key_freq, keyed
from padlake.sources.tables import table

#: The public range of customers' and orders' keys. Tables of one customers' key may go beyond it, see ``domain_of``; else a key beyond is an error.
DOMAIN = int(os.environ.get("PADLAKE_DOMAIN", 20_000))
ORDER_DOMAIN = int(os.environ.get("PADLAKE_ORDER_DOMAIN", 200_000))
#: The largest domain, for where none is needed.
MOST = 1 << 62

#: Table, key, filter, as SQL that both engines read.
TABLES = {
    "account": ("customer", "c_custkey", "true"),
    "trans": ("events", "user_id", "event_type = 'click'"),
    "orders_all": ("orders", "o_custkey", "true"),
    "urgent": ("orders", "o_custkey", "o_orderpriority = '1-URGENT'"),
    "disp": ("(SELECT DISTINCT o_custkey, o_orderstatus FROM orders)", "o_custkey", "true"),
    "lines": ("lineitem", "l_orderkey", "l_returnflag = 'R'"),
}


def domain_of(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """The domain that the tables ``names`` have in common: DOMAIN, doubled until it holds the largest key of each, whatever the filter.

    So no row of a larger table is lost. All that this tells of keys is how often the declared range was doubled, and
    nothing where they lie within it.
    """
    columns = dict.fromkeys((source if source.isidentifier() else "orders", key) for source, key, _ in (TABLES[n] for n in names))
    each = [table(spark, sf_dir, source).agg(F.max(F.col(key).cast("long")).alias("last")) for source, key in columns]
    last = reduce(DataFrame.union, each).agg(F.max("last")).first()[0]
    domain = DOMAIN
    while last is not None and domain <= last:  # keys begin at 0, the domain at 1
        domain *= 2
    return min(domain, MOST)


def rows(spark: SparkSession, sf_dir: str, name: str, domain: int = DOMAIN) -> DataFrame:
    source, key, where = TABLES[name]
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus").distinct() if name == "disp" else table(spark, sf_dir, source)
    return keyed(df.where(where), declared(F.col(key) + 1, domain), domain)


def declared(key: Column, domain: int) -> Column:
    """``key``, which must lie in [1, domain] or be null: a row outside of what is declared is reported, not dropped."""
    outside = F.raise_error(F.concat(F.lit("key "), key.cast("string"), F.lit(f" is outside the declared domain 1..{domain}")))
    return F.when(key.isNull() | key.between(1, domain), key).otherwise(outside.cast("long"))


def freq(spark: SparkSession, sf_dir: str, name: str, domain: int = DOMAIN) -> DataFrame:
    return key_freq(rows(spark, sf_dir, name, domain))


def freqs(spark: SparkSession, sf_dir: str, *names: str, domain: int = DOMAIN) -> dict[str, DataFrame]:
    return {n: freq(spark, sf_dir, n, domain) for n in names}


def freq_sql(*names: str, domain: int = DOMAIN) -> str:
    """Common table expressions n_freq (key, freq) for each name."""
    out = []
    for n in names:
        source, key, where = TABLES[n]
        out.append(f"{n}_freq AS (SELECT ({key} + 1)::BIGINT AS key, count(*)::BIGINT AS freq FROM {source} WHERE {where} AND {key} + 1 BETWEEN 1 AND {domain} GROUP BY {key})")
    return ", ".join(out)
