"""Validated SQL text, run by Spark; the same text (parameters filled in) is the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.catalogue import star_catalogue
from ..plans.sqltext import run_sql
from .registry import query, table


def add(name: str, sql: str, tables: list[str], oracle: str | None = None, **parameters: object) -> None:
    filled = oracle or sql
    for key, value in parameters.items():
        filled = filled.replace(f"@{key}", f"'{value}'" if isinstance(value, str) else str(value))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spark, sql, star_catalogue(), {t: table(spark, sf_dir, t) for t in tables}, parameters)

    query(filled, name)(run)


add("sql_union_agg", "SELECT o_orderstatus AS kind, count(*) AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY o_orderpriority", ["orders"])
add("sql_except_agg", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority EXCEPT SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = @s GROUP BY o_orderpriority", ["orders"], s="F")
add("sql_intersect_agg", "SELECT l_returnflag, min(l_linenumber) AS n FROM lineitem GROUP BY l_returnflag INTERSECT SELECT l_returnflag, min(l_linenumber) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag", ["lineitem"])
add("sql_cte_agg", "WITH t AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority) SELECT max(n) AS most, min(n) AS least FROM t", ["orders"])
add("sql_having", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > @p GROUP BY o_orderpriority HAVING count(*) > 10", ["orders"], p=1000)
add("sql_count_if", "SELECT COUNTIF(o_orderstatus = 'F') AS finished, count(*) AS n FROM orders", ["orders"], "SELECT count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) AS n FROM orders")
add("sql_join_using_alias", "SELECT c.c_mktsegment, count(DISTINCT o.o_orderkey) AS orders FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment", ["customer", "orders"])
