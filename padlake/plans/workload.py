"""The eight workload queries, as Spark SQL over the star-schema analogues of the banking tables.

Each query is one SQL text that both Spark and the oracle understand; Catalyst gets the whole plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from padlake.sources.tables import table

#: The link table between customers and order states, several rows for a customer.
DISP = "(SELECT DISTINCT o_custkey, o_orderstatus FROM orders)"

SQL = {
    "q1_filter_eq": "SELECT * FROM part WHERE p_size = 36",
    "q2_filter_range": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem WHERE l_extendedprice > 10000 AND l_extendedprice < 20000 AND l_returnflag = 'R'",
    "q3_count_distinct": """SELECT CAST(count(DISTINCT o.o_custkey) AS BIGINT) AS n_accounts
        FROM customer c, orders o
        WHERE c.c_custkey = o.o_custkey AND c.c_nationkey = 18 AND o.o_orderpriority = '1-URGENT'""",
    "q4_group_count": """SELECT CAST(e.ts AS DATE) AS day, CAST(count(e.ts) AS BIGINT) AS cnt
        FROM customer c, events e
        WHERE c.c_custkey = e.user_id AND e.event_type = 'click' AND c.c_nationkey = 18
        GROUP BY CAST(e.ts AS DATE) ORDER BY cnt, day""",
    "q5_three_way": """SELECT CAST(count(DISTINCT c.c_custkey) AS BIGINT) AS n_accounts
        FROM customer c, events e, orders o
        WHERE c.c_custkey = e.user_id AND c.c_custkey = o.o_custkey
          AND e.event_type = 'click' AND o.o_orderpriority = '1-URGENT'""",
    "q6_sum": f"""SELECT CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) * 100 AS BIGINT) AS total_cents
        FROM orders o, events e, {DISP} d
        WHERE o.o_custkey = e.user_id AND o.o_custkey = d.o_custkey
          AND o.o_orderpriority = '1-URGENT' AND e.event_type = 'click'""",
    "q7_min": f"""SELECT CAST(min(CAST(o.o_totalprice AS DECIMAL(18,2))) * 100 AS BIGINT) AS lowest_cents
        FROM customer c, events e, orders o, {DISP} d
        WHERE c.c_custkey = e.user_id AND c.c_custkey = o.o_custkey AND c.c_custkey = d.o_custkey
          AND o.o_orderpriority = '1-URGENT' AND e.event_type = 'click' AND d.o_orderstatus = 'F'""",
    "q8_max_cross": f"""SELECT CAST(max(CAST(o.o_totalprice AS DECIMAL(18,2))) * 100 AS BIGINT) AS highest_cents
        FROM customer c, events e, orders o, {DISP} d
        WHERE EXISTS (SELECT 1 FROM part WHERE p_size = 36) AND c.c_custkey = e.user_id AND c.c_custkey = o.o_custkey AND c.c_custkey = d.o_custkey
          AND o.o_orderpriority = '1-URGENT' AND e.event_type = 'click' AND d.o_orderstatus = 'F'""",
}
ORACLE = dict(SQL)
#: As the workload has it, a product with the unlinked table; all that max() sees of that is whether it has rows.
ORACLE["q8_max_cross"] = SQL["q8_max_cross"].replace("d\n        WHERE EXISTS (SELECT 1 FROM part WHERE p_size = 36)", "d, part l\n        WHERE l.p_size = 36")
assert "part l" in ORACLE["q8_max_cross"]


def _run(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        views = {t: table(spark, sf_dir, t) for t in ("part", "lineitem", "customer", "orders", "events") if t in SQL[name]}
        sql = SQL[name]
        for t in views:
            sql = sql.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"FROM {t})", f"FROM {{{t}}})").replace(f", {t} ", f", {{{t}}} ")
        return spark.sql(sql, **views)

    query.__doc__ = SQL[name]
    return query


QUERIES = {name: _run(name) for name in SQL}
