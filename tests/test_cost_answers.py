"""Cost approval, execution, citations and follow-ups."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sablequery.functions import answers as A
from sablequery.plans import cost
from sablequery.plans.authorize import authorize
from sablequery.plans.catalogue import star_catalogue
from sablequery.plans.compile import compile_plan, parquet_reader
from sablequery.plans.model import Aggregate, PlanError, QueryPlan, Ref, Scope

SECRET = b"s" * 32
PLAN = QueryPlan("x", ("lineitem",), (Aggregate("COUNT", "n"),), groups=(Ref("lineitem", "l_returnflag"),), outputs=("n", "l_returnflag"))


def approved(plan=PLAN, **scope):
    return authorize("x", plan, Scope(star_catalogue(), **scope)).approved


def test_estimate_counts_only_columns_read(spark, small):
    found = cost.estimate(compile_plan(approved(), parquet_reader(spark, small)), approved())
    whole = cost.footer_bytes(f"file://{small}/lineitem.parquet", frozenset(spark.read.parquet(f"{small}/lineitem.parquet").columns))
    assert found.error is None and 0 < found.scanned_bytes < whole / 4 and found.tables == ("lineitem",)


def test_gate_and_token(spark, small):
    limits = cost.CostLimits(10_000_000, 60, SECRET)
    plan, frame = approved(), compile_plan(approved(), parquet_reader(spark, small))
    found = cost.estimate(frame, plan)
    token = cost.approve(plan, found, limits, now=1000)
    cost.verify_token(token, plan.plan_hash, limits, now=1059)
    for bad, code, at in ((token, "token_expired", 1061), (token[:-1] + ("0" if token[-1] != "0" else "1"), "token_signature", 1000), ("v2.1.1.x", "malformed_token", 1000)):
        with pytest.raises(PlanError) as error:
            cost.verify_token(bad, plan.plan_hash, limits, now=at)
        assert error.value.code == code
    with pytest.raises(PlanError, match="token_signature"):
        cost.verify_token(token, "other", limits, now=1000)
    with pytest.raises(PlanError, match="token_ceiling"):
        cost.verify_token(token, plan.plan_hash, replace(limits, max_bytes=5), now=1000)
    rows = cost.execute(frame, plan, cost.approve(plan, found, limits), limits)
    assert len(rows) == 3


def test_gate_refusals():
    limits = cost.CostLimits(100, 60, SECRET)
    kinds = lambda *a: {v.code for v in cost.cost_violations(*a)}
    assert kinds(approved(), "zz", cost.Estimate(101, ("orders",)), limits) == {"plan_hash_mismatch", "max_bytes_exceeded", "referenced_tables_mismatch"}
    assert kinds(approved(), approved().plan_hash, cost.Estimate(None, (), "boom"), limits) == {"estimate_failed"}
    limited, strict = approved(replace(PLAN, limit=3)), approved(required_columns=("lineitem.l_shipdate", "orders.o_orderdate"))
    assert kinds(limited, limited.plan_hash, cost.Estimate(1, ("lineitem",)), limits) == {"limit_is_not_cost_control"}
    assert kinds(limited, limited.plan_hash, cost.Estimate(1, ("lineitem",)), replace(limits, limit_allowed=True)) == set()
    assert kinds(strict, strict.plan_hash, cost.Estimate(1, ("lineitem",)), limits) == {"partition_filter_required"}


def test_limits_fail_closed(monkeypatch):
    for bad in ((0, 60, SECRET), (1, 0, SECRET), (1, 3601, SECRET), (1, 60, b"short")):
        with pytest.raises(PlanError):
            cost.CostLimits(*bad)
    with pytest.raises(PlanError):
        cost.CostLimits.from_environment("NOT_SET_")
    for key, value in (("T_MAX_BYTES", "5"), ("T_APPROVAL_SECONDS", "9"), ("T_APPROVAL_SECRET", "x" * 32)):
        monkeypatch.setenv(key, value)
    assert cost.CostLimits.from_environment("T_").max_bytes == 5


def test_citations(spark):
    rows = [("Uses A_B [c1] , and more [c2, c3] but [note] stays [c1, x].", ["c1", "c2", "c3"])]
    frame = spark.createDataFrame(rows, "answer string, ids array<string>")
    answer, ids = F.col("answer"), F.col("ids")
    row = frame.select(A.cited(answer, ids).alias("c"), A.without_citations(answer, ids).alias("t"), A.numbered_citations(F.lit("a [c2] b [c1] [zz]"), ids).alias("n"), A.catalogue_names(answer).alias("k")).first()
    assert row["c"] == ["c1", "c2", "c3"] and row["t"] == "Uses A_B, and more but [note] stays [c1, x]."
    assert row["n"] == "a [2] b [1] [zz]" and row["k"] == ["A_B"]


def test_followups(spark):
    rows = [("Yes!", ["T"], [], "offered?"), ("what is in this table", ["PAT_ENC"], [], None), ("describe that column", ["A", "B"], ["X_ID"], ""), ("this table", ["A", "B"], [], None), ("yes", [], [], None)]
    frame = spark.createDataFrame(rows, "q string, t array<string>, c array<string>, o string")
    got = [r[0] for r in frame.select(A.resolve_followup(F.col("q"), F.col("t"), F.col("c"), F.col("o"), ["yes", "please do"])).collect()]
    assert got == ["offered?", "what is in the PAT_ENC table", "describe the X_ID column", "this table", "yes"]
    offers = spark.createDataFrame([("text\nSuggested query: how many? \nmore",), ("none",)], "a string").select(A.suggestion(F.col("a")).alias("s")).collect()
    assert [r["s"] for r in offers] == ["how many?", None]
