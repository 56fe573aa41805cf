"""Plan rules: one change, one code; compiler and result checks."""

from dataclasses import replace

import pytest

from sablequery.plans.authorize import GUIDANCE, authorize, guidance
from sablequery.plans.catalogue import star_catalogue, with_safety
from sablequery.plans.compile import compile_plan, parquet_reader
from sablequery.plans.model import Aggregate, Bucket, Catalogue, ColumnEvidence, Filter, Join, Order, Parameter, PlanError, QueryPlan, Ref, Scope, TableEvidence
from sablequery.plans.results import redact_result, verify_result

SCOPE = Scope(star_catalogue())
COUNT = Aggregate("COUNT", "n")


def base():
    return QueryPlan("orders by status", ("orders", "lineitem"), (COUNT, Aggregate("SUM", "price", Ref("lineitem", "l_extendedprice"))), joins=(Join(Ref("orders", "o_orderkey"), Ref("lineitem", "l_orderkey")),),
        groups=(Ref("orders", "o_orderstatus"),), filters=(Filter(Ref("orders", "o_orderpriority"), "=", ("p",)),), parameters=(Parameter("p", "STRING", "1-URGENT"),), outputs=("o_orderstatus", "n", "price"), citations=("c1",))


def codes(plan, question="orders by status", scope=SCOPE):
    return set(authorize(question, plan, scope, frozenset({"c1"})).codes)


def test_base_plan_is_approved_and_hashed():
    verdict = authorize("Write SQL to  orders, by STATUS!", base(), SCOPE, frozenset({"c1"}))
    assert verdict.approved and len(verdict.approved.plan_hash) == 64
    other = authorize("orders by status", replace(base(), limit=3), SCOPE, frozenset({"c1"}))
    assert other.approved.plan_hash != verdict.approved.plan_hash and other.approved.scope_hash == verdict.approved.scope_hash


MUTATIONS = [
    ("objective_mismatch", {"objective": "something else"}),
    ("malformed_identifier", {"groups": (Ref("orders", "o_orderstatus; drop"),)}),
    ("alias_shadows_restricted_column", {"aggregates": (Aggregate("COUNT", "C_NAME"),), "outputs": ("o_orderstatus", "c_name")}),
    ("table_out_of_scope", {"tables": ("orders", "lineitem", "secrets")}),
    ("row_level_not_allowed", {"row_level": True}),
    ("undeclared_plan_table", {"groups": (Ref("part", "p_type"),), "outputs": ("p_type", "n", "price")}),
    ("column_out_of_scope", {"groups": (Ref("orders", "o_ghost"),), "outputs": ("o_ghost", "n", "price")}),
    ("unsafe_projection", {"groups": (Ref("orders", "o_custkey"),), "outputs": ("o_custkey", "n", "price")}),
    ("time_bucket_unsafe_column", {"buckets": (Bucket(Ref("orders", "o_custkey"), "DAY", "d"),), "outputs": ("o_orderstatus", "n", "price", "d")}),
    ("time_bucket_not_temporal", {"buckets": (Bucket(Ref("orders", "o_totalprice"), "DAY", "d"),), "outputs": ("o_orderstatus", "n", "price", "d")}),
    ("duplicate_output_alias", {"aggregates": (COUNT, Aggregate("COUNT", "N"))}),
    ("order_by_unknown_alias", {"order": Order("ghost")}),
    ("unsafe_aggregation", {"tables": ("orders", "lineitem", "events"), "aggregates": (Aggregate("COUNT", "n", Ref("events", "props")),)}),
    ("identifier_usage", {"aggregates": (Aggregate("MAX", "n", Ref("orders", "o_custkey")),)}),
    ("unsafe_filter", {"filters": (Filter(Ref("orders", "o_custkey"), "=", ("p",)),)}),
    ("duplicate_parameter", {"parameters": (Parameter("p", "STRING", "a"), Parameter("P", "STRING", "b"))}),
    ("undeclared_parameter", {"parameters": ()}),
    ("unused_parameter", {"parameters": (Parameter("p", "STRING", "a"), Parameter("q", "STRING", "b"))}),
    ("parameter_type_mismatch", {"parameters": (Parameter("p", "INT64", 1),)}),
    ("unsafe_join", {"joins": (Join(Ref("orders", "o_orderstatus"), Ref("lineitem", "l_linestatus")),)}),
    ("citation_out_of_scope", {"citations": ("c9",)}),
    ("output_shape_mismatch", {"outputs": ("n",)}),
]


@pytest.mark.parametrize(("code", "change"), MUTATIONS)
def test_mutation_gives_its_code(code, change):
    assert code in codes(replace(base(), **change))


def test_scope_limits_and_guidance():
    assert {"too_many_tables", "too_many_joins"} <= codes(base(), scope=Scope(star_catalogue(), max_tables=1, max_joins=0))
    same = QueryPlan("x", ("a", "b"), (COUNT,), groups=(Ref("a", "k"), Ref("b", "k")), outputs=("k", "n"))
    cat = Catalogue(tuple(TableEvidence(t, (ColumnEvidence("k", "STRING", "safe_aggregate"),)) for t in "ab"))
    assert "duplicate_output_name" in codes(same, "x", Scope(cat))
    verdict = authorize("other", replace(base(), row_level=True), SCOPE)
    lines = guidance(verdict.violations)
    assert len(lines) == len(set(lines)) and GUIDANCE["row_level_not_allowed"] in lines
    assert {code for code, _ in MUTATIONS} <= set(GUIDANCE)


@pytest.mark.parametrize("make", [
    lambda: Filter(Ref("a", "b"), "BETWEEN", ("x",)), lambda: Filter(Ref("a", "b"), "IN", ("x",)), lambda: Aggregate("SUM", "s"), lambda: Aggregate("COUNT", "1bad"), lambda: Bucket(Ref("a", "b"), "HOUR", "h"),
    lambda: Join(Ref("a", "b"), Ref("c", "d"), "FULL"), lambda: QueryPlan("x", (), (COUNT,)), lambda: QueryPlan("x", ("a",), ()), lambda: QueryPlan("x", ("a",), (COUNT,), limit=1001), lambda: QueryPlan("x", ("a",) * 5, (COUNT,)), lambda: ColumnEvidence("a", None, "open"),
])
def test_impossible_plans_do_not_exist(make):
    with pytest.raises(PlanError):
        make()


def approved(plan):
    return authorize(plan.objective, replace(plan, outputs=tuple(plan.output_names)), SCOPE).approved


def test_join_orders(spark, small):
    read = parquet_reader(spark, small)
    for joins, code in (((), "disconnected_table"), ((Join(Ref("orders", "o_orderkey"), Ref("lineitem", "l_orderkey")),) * 2, "ambiguous_join_order"), ((Join(Ref("lineitem", "l_orderkey"), Ref("part", "p_partkey")),), "join_without_base")):
        tables = ("orders", "lineitem", "part") if code == "join_without_base" else ("orders", "lineitem")
        with pytest.raises(PlanError) as error:
            compile_plan(approved(QueryPlan("x", tables, (COUNT,), joins=joins)), read)
        assert error.value.code == code


def test_filters_reach_the_scan_and_columns_are_pruned(spark, small):
    plan = QueryPlan("x", ("lineitem",), (COUNT,), groups=(Ref("lineitem", "l_returnflag"),), filters=(Filter(Ref("lineitem", "l_quantity"), ">", ("q",)),), parameters=(Parameter("q", "FLOAT64", 30.0),))
    text = compile_plan(approved(plan), parquet_reader(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,30.0)" in text and "l_shipdate" not in text


def test_results_are_checked_by_schema(spark, small):
    plan = QueryPlan("x", ("orders",), (COUNT,), groups=(Ref("orders", "o_orderstatus"),))
    frame = parquet_reader(spark, small)("orders")
    with pytest.raises(PlanError, match="restricted"):
        verify_result(frame.select("o_custkey"), plan, SCOPE.catalogue)
    with pytest.raises(PlanError, match="unmapped"):
        verify_result(frame.selectExpr("1 as other"), plan, SCOPE.catalogue)
    assert verify_result(frame.select("o_orderstatus").limit(0), plan, SCOPE.catalogue).count() == 0
    assert redact_result(frame.selectExpr("o_orderstatus", "1 as n", "o_custkey"), plan).columns == ["o_orderstatus", "n"]
    marked = with_safety(frame, SCOPE.catalogue.table("orders"))
    assert marked.schema["o_custkey"].metadata == {"safety": "identifier"}
