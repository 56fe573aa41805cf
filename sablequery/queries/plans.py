"""Queries that run authorised plans. Money is summed as decimals on both sides, so sums don't depend on order."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.authorize import authorize
from ..plans.catalogue import star_catalogue
from ..plans.compile import compile_plan, parquet_reader
from ..plans.model import Aggregate, Bucket, Filter, Join, Order, Parameter, PlanError, QueryPlan, Ref, Scope
from ..plans.results import redact_result, verify_result
from .registry import query, table

SCOPE = Scope(star_catalogue())


def ref(text: str) -> Ref:
    return Ref(*text.split("."))


def run(spark: SparkSession, sf_dir: str, plan: QueryPlan) -> DataFrame:
    """Authorise, compile and verify; doubles of the result are rounded, since their sums depend on order."""
    plan = replace(plan, outputs=tuple(plan.output_names))
    verdict = authorize(plan.objective, plan, SCOPE)
    if verdict.approved is None:
        raise PlanError("rejected", ", ".join(verdict.codes))
    result = verify_result(compile_plan(verdict.approved, parquet_reader(spark, sf_dir)), plan, SCOPE.catalogue)
    return result.select(*[F.round(c, 2).alias(c) if kind == "double" else F.col(c) for c, kind in result.dtypes])


COUNT = Aggregate("COUNT", "n")


def add(name: str, sql: str, **parts: object) -> None:
    plan = QueryPlan(**({"objective": name.replace("_", " "), "aggregates": (COUNT,)} | parts))
    query(sql, name)(lambda spark, sf_dir: run(spark, sf_dir, plan))


O, L, C, N, R, P = "orders", "lineitem", "customer", "nation", "region", "part"

add("plan_count_star", "SELECT count(*) AS n FROM orders", tables=(O,))
add("plan_count_col", "SELECT count(o_orderstatus) AS n FROM orders", tables=(O,), aggregates=(Aggregate("COUNT", "n", ref("orders.o_orderstatus")),))
add("plan_count_distinct", "SELECT count(DISTINCT o_custkey) AS customers FROM orders", tables=(O,), aggregates=(Aggregate("COUNT_DISTINCT", "customers", ref("orders.o_custkey")),))
add("plan_sum_avg_min_max", "SELECT round(sum(l_quantity),2) AS total, round(avg(l_quantity),2) AS mean, round(min(l_quantity),2) AS least, round(max(l_quantity),2) AS most FROM lineitem", tables=(L,),
    aggregates=tuple(Aggregate(f, a, ref("lineitem.l_quantity")) for f, a in (("SUM", "total"), ("AVG", "mean"), ("MIN", "least"), ("MAX", "most"))))
add("plan_group_multi", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity),2) AS quantity FROM lineitem GROUP BY ALL", tables=(L,),
    groups=(ref("lineitem.l_returnflag"), ref("lineitem.l_linestatus")), aggregates=(COUNT, Aggregate("SUM", "quantity", ref("lineitem.l_quantity"))))

for _key, _operator, _value in (("eq", "=", 24.0), ("ne", "!=", 24.0), ("lt", "<", 24.0), ("le", "<=", 24.0), ("gt", ">", 24.0), ("ge", ">=", 24.0)):
    add(f"plan_filter_{_key}", f"SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity {_operator} 24 GROUP BY ALL", tables=(L,), groups=(ref("lineitem.l_returnflag"),),
        filters=(Filter(ref("lineitem.l_quantity"), _operator, ("q",)),), parameters=(Parameter("q", "FLOAT64", _value),))
add("plan_filter_between", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' GROUP BY ALL", tables=(O,), groups=(ref("orders.o_orderpriority"),),
    time_filters=(Filter(ref("orders.o_orderdate"), "BETWEEN", ("a", "b")),), parameters=(Parameter("a", "DATETIME", "1995-01-01 00:00:00"), Parameter("b", "DATETIME", "1996-12-31 00:00:00")))
add("plan_filter_and", "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.05 AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY ALL", tables=(L,), groups=(ref("lineitem.l_linestatus"),),
    filters=(Filter(ref("lineitem.l_returnflag"), "=", ("f",)), Filter(ref("lineitem.l_discount"), ">=", ("d",))), time_filters=(Filter(ref("lineitem.l_shipdate"), "<", ("t",)),),
    parameters=(Parameter("f", "STRING", "R"), Parameter("d", "FLOAT64", 0.05), Parameter("t", "DATETIME", "1997-01-01 00:00:00")))

for _grain in ("day", "month", "quarter", "year"):
    add(f"plan_bucket_{_grain}", f"SELECT CAST(date_trunc('{_grain}', o_orderdate) AS TIMESTAMP) AS period, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders GROUP BY 1", tables=(O,),
        buckets=(Bucket(ref("orders.o_orderdate"), _grain.upper(), "period"),), aggregates=(COUNT, Aggregate("SUM", "total", ref("orders.o_totalprice"))))
add("plan_bucket_week", "SELECT CAST(date_trunc('day', o_orderdate) - to_days(CAST(dayofweek(o_orderdate) AS INTEGER)) AS TIMESTAMP) AS week, count(*) AS n FROM orders GROUP BY 1", tables=(O,), buckets=(Bucket(ref("orders.o_orderdate"), "WEEK", "week"),))
add("plan_two_buckets", "SELECT CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS ordered, CAST(date_trunc('quarter', l_shipdate) AS TIMESTAMP) AS shipped, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2", tables=(O, L),
    joins=(Join(ref("orders.o_orderkey"), ref("lineitem.l_orderkey")),), buckets=(Bucket(ref("orders.o_orderdate"), "YEAR", "ordered"), Bucket(ref("lineitem.l_shipdate"), "QUARTER", "shipped")))

ORDERS_LINES = Join(ref("orders.o_orderkey"), ref("lineitem.l_orderkey"))
CUSTOMERS_ORDERS = Join(ref("customer.c_custkey"), ref("orders.o_custkey"), "LEFT")
add("plan_join_inner", "SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice),2) AS price FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL", tables=(O, L), joins=(ORDERS_LINES,), groups=(ref("orders.o_orderpriority"),),
    aggregates=(COUNT, Aggregate("SUM", "price", ref("lineitem.l_extendedprice"))))
add("plan_join_left", "SELECT c_mktsegment, count(*) AS n, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL", tables=(C, O), joins=(CUSTOMERS_ORDERS,), groups=(ref("customer.c_mktsegment"),),
    aggregates=(COUNT, Aggregate("COUNT", "orders", ref("orders.o_orderkey"))))
add("plan_join_left_swapped", "SELECT o_orderstatus, count(*) AS n, count(c_custkey) AS customers FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY ALL", tables=(O, C), joins=(CUSTOMERS_ORDERS,), groups=(ref("orders.o_orderstatus"),),
    aggregates=(COUNT, Aggregate("COUNT", "customers", ref("customer.c_custkey"))))
add("plan_join_four", "SELECT n_name, count(DISTINCT c_custkey) AS customers, round(sum(l_extendedprice),2) AS price FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL",
    tables=(N, C, O, L), groups=(ref("nation.n_name"),), aggregates=(Aggregate("COUNT_DISTINCT", "customers", ref("customer.c_custkey")), Aggregate("SUM", "price", ref("lineitem.l_extendedprice"))),
    joins=(Join(ref("nation.n_nationkey"), ref("customer.c_nationkey")), replace(CUSTOMERS_ORDERS, kind="INNER"), ORDERS_LINES))
add("plan_left_then_filter", "SELECT c_mktsegment, count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY ALL", tables=(C, O), joins=(CUSTOMERS_ORDERS,), groups=(ref("customer.c_mktsegment"),),
    filters=(Filter(ref("orders.o_orderstatus"), "=", ("s",)),), parameters=(Parameter("s", "STRING", "F"),))
add("plan_order_limit_desc", "SELECT p_type, count(*) AS n, max(p_size) AS p_most FROM part GROUP BY ALL ORDER BY p_type DESC LIMIT 5", tables=(P,), groups=(ref("part.p_type"),), aggregates=(COUNT, Aggregate("MAX", "p_most", ref("part.p_size"))), order=Order("p_type"), limit=5)
add("plan_order_limit_asc", "SELECT p_brand, count(*) AS n FROM part GROUP BY ALL ORDER BY p_brand ASC NULLS FIRST LIMIT 7", tables=(P,), groups=(ref("part.p_brand"),), order=Order("p_brand", "ASC"), limit=7)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def plan_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result with a column too many keeps only what the plan declares."""
    plan = QueryPlan("redact", (O,), (COUNT,), groups=(ref("orders.o_orderstatus"),))
    wide = table(spark, sf_dir, O).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_custkey").alias("o_custkey"))
    return redact_result(wide, plan)
