"""Event registry, redaction of payloads, budgets and evidence over trace events."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

# Events in workflow order with their domain and status; blocked ones stop a run on purpose.
EVENTS = (
    ("policy_gate.checked", "policy", "ok"),
    ("policy_gate.allowed", "policy", "ok"),
    ("followup.contextualized", "policy", "ok"),
    ("request.blocked", "policy", "blocked"),
    ("content.screened", "policy", "ok"),
    ("answer.blocked", "policy", "blocked"),
    ("result_safety.passed", "policy", "ok"),
    ("intent.started", "intent", "ok"),
    ("intent.classified", "intent", "ok"),
    ("intent.question_resolved", "intent", "ok"),
    ("intent.empty_question", "intent", "blocked"),
    ("intent.model_error", "intent", "error"),
    ("intent.clarification_requested", "intent", "ok"),
    ("intent.clarification_exhausted", "intent", "blocked"),
    ("retrieval_permission.checked", "retrieval", "ok"),
    ("retrieval.started", "retrieval", "ok"),
    ("retrieval.completed", "retrieval", "ok"),
    ("retrieval.error", "retrieval", "error"),
    ("retrieval.content_blocked", "retrieval", "blocked"),
    ("retrieval.chunk_blocked", "retrieval", "blocked"),
    ("context_gate.context_available", "retrieval", "ok"),
    ("context_gate.schema_snapshot_built", "retrieval", "ok"),
    ("context_gate.schema_build_error", "retrieval", "error"),
    ("context_gate.no_context_clarification", "retrieval", "ok"),
    ("context_gate.no_context_exhausted", "retrieval", "blocked"),
    ("context_gate.started", "retrieval", "ok"),
    ("context_gate.completed", "retrieval", "ok"),
    ("exploration.started", "retrieval", "ok"),
    ("exploration.completed", "retrieval", "ok"),
    ("exploration.truncated", "retrieval", "blocked"),
    ("exploration.stopped", "retrieval", "blocked"),
    ("exploration.error", "retrieval", "error"),
    ("exploration.tool_completed", "retrieval", "ok"),
    ("exploration.tool_content_blocked", "retrieval", "blocked"),
    ("exploration.fallback_retrieval", "retrieval", "ok"),
    ("exploration.fallback_error", "retrieval", "error"),
    ("exploration.fallback_content_blocked", "retrieval", "blocked"),
    ("query_plan.started", "sql", "ok"),
    ("query_plan.built", "sql", "ok"),
    ("query_plan.no_schema_snapshot", "sql", "blocked"),
    ("query_plan.error", "sql", "error"),
    ("query_plan.repair_attempted", "sql", "ok"),
    ("plan_safety.approved", "sql", "ok"),
    ("plan_safety.no_plan", "sql", "blocked"),
    ("plan_safety.rejected", "sql", "blocked"),
    ("generate_sql.completed", "sql", "ok"),
    ("generate_sql.no_plan", "sql", "blocked"),
    ("write_sql.compiler_unsupported", "sql", "blocked"),
    ("validate_sql.completed", "sql", "ok"),
    ("validate_sql.no_sql", "sql", "blocked"),
    ("validate_sql.failed_final", "sql", "blocked"),
    ("validate_sql.error", "sql", "error"),
    ("cost_execution_gate.missing_evidence", "sql", "blocked"),
    ("cost_execution_gate.config_error", "sql", "error"),
    ("cost_execution_gate.rejected", "sql", "blocked"),
    ("cost_execution_gate.approved", "sql", "ok"),
    ("execution_not_configured", "sql", "blocked"),
    ("output_safety.started", "operational", "ok"),
    ("output_safety.completed", "operational", "ok"),
    ("output_safety.skipped", "operational", "ok"),
    ("output_safety.error", "operational", "error"),
    ("output_safety.budget_exceeded", "operational", "error"),
    ("output_safety.invalid_response", "operational", "error"),
    ("output_safety.validation_error", "operational", "error"),
    ("model.usage", "operational", "ok"),
    ("general_answer.started", "lifecycle", "ok"),
    ("general_answer.completed", "lifecycle", "ok"),
    ("general_answer.budget_exceeded", "lifecycle", "blocked"),
    ("general_answer.error", "lifecycle", "error"),
    ("documentation_answer.started", "lifecycle", "ok"),
    ("documentation_answer.completed", "lifecycle", "ok"),
    ("documentation_answer.budget_exceeded", "lifecycle", "blocked"),
    ("documentation_answer.error", "lifecycle", "error"),
    ("answer.ready", "lifecycle", "ok"),
)
#: Payload keys whose values never reach a log, and patterns of keys that a viewer hides.
LOGGED_KEYS = frozenset(("question", "query", "messages", "response", "input", "result", "answer", "sql", "content"))
HIDDEN_KEYS = r"(?i)patient|ssn|mrn|dob|date.?of.?birth|address|phone|email|api.?key|token|secret|credential|password|authorization"
#: Default limits of a run.
BUDGETS = {"model_calls": 8, "tool_calls": 20, "calls_per_tool": 6, "rounds": 5, "seconds": 120.0}


def event_dimension(spark: SparkSession) -> DataFrame:
    """event, domain, status (ok, blocked, error)."""
    return spark.createDataFrame(list(EVENTS), "event string, domain string, status string")


def classified(traces: DataFrame) -> DataFrame:
    """Adds domain and status of every event, unknown for events that are not registered."""
    known = F.broadcast(event_dimension(traces.sparkSession))
    return traces.drop("domain", "status").join(known, "event", "left").na.fill("unknown", ["domain", "status"])


def redact_for_log(value: Any, key: bytes) -> Any:
    """Values of LOGGED_KEYS, at any depth, become their size and a keyed digest."""
    if isinstance(value, dict):
        return {k: _digest(v, key) if k in LOGGED_KEYS else redact_for_log(v, key) for k, v in value.items()}
    return [redact_for_log(v, key) for v in value] if isinstance(value, list) else value


def _digest(value: Any, key: bytes) -> dict[str, Any]:
    data = json.dumps(value, ensure_ascii=False, sort_keys=True).encode()
    counted = {"item_count": len(value)} if isinstance(value, list) else {}
    return {"redacted": True, "bytes": len(data), "digest": f"hmac-sha256:{hmac.new(key, data, hashlib.sha256).hexdigest()}"} | counted


def hide_for_view(value: Any) -> Any:
    """Values under keys that match HIDDEN_KEYS, at any depth, become a marker."""
    if isinstance(value, dict):
        return {k: "[REDACTED]" if re.search(HIDDEN_KEYS, k) else hide_for_view(v) for k, v in value.items()}
    return [hide_for_view(v) for v in value] if isinstance(value, list) else value


def _over_json(text: pd.Series, change: Any) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            return json.dumps(change(json.loads(t)), ensure_ascii=True)
        except ValueError:
            return None  # what is no JSON is not passed on

    return text.map(one)


def log_payload(payload: str, key: bytes) -> Column:
    @pandas_udf(StringType())
    def redact(text: pd.Series) -> pd.Series:
        return _over_json(text, lambda v: redact_for_log(v, key))

    return redact(payload)


def view_payload(payload: str) -> Column:
    @pandas_udf(StringType())
    def hide(text: pd.Series) -> pd.Series:
        return _over_json(text, hide_for_view)

    return hide(payload)


def budget_use(traces: DataFrame, budgets: dict[str, float] | None = None) -> DataFrame:
    """Per run: model calls, tool calls, calls of the busiest tool, rounds, seconds, and the limits it passed."""
    tool = F.when(F.col("event") == "exploration.tool_completed", F.coalesce(F.get_json_object("payload", "$.tool"), F.lit("")))
    by_tool = traces.withColumn("tool", tool).groupBy("run_id", "tool").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event") == "model.usage").alias("models"), F.count_if(F.col("event") == "exploration.started").alias("rounds"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    calls = F.when(F.col("tool").isNotNull(), F.col("n")).otherwise(0)
    used = by_tool.groupBy("run_id").agg(F.sum("models").alias("model_calls"), F.sum(calls).alias("tool_calls"), F.max(calls).alias("calls_per_tool"), F.sum("rounds").alias("rounds"), (F.max("b") - F.min("a")).alias("seconds"))
    passed = [F.when(F.col(k) > v, F.lit(k)) for k, v in (BUDGETS | (budgets or {})).items()]
    return used.withColumn("exceeded", F.array_compact(F.array(*passed)))


def accumulate_evidence(found: DataFrame, most: int = 15) -> DataFrame:
    """Chunks of a run's rounds, each at its first place with its last value. found: run_id, place, chunk_id, value."""
    once = found.groupBy("run_id", "chunk_id").agg(F.min("place").alias("place"), F.max_by("value", "place").alias("value"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy("place", "chunk_id")))
    return ranked.where(F.col("rank") <= most)
