"""Roll-ups of trace and audit logs. Traces: run_id, ts (seconds), seq, event. Audits: the fields of sources.jsonl.

Runs are keys everywhere, so windows hold one run's events; totals are partial aggregates.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stages in workflow order with the events that start and end them.
STAGES: list[tuple[str, list[str], list[str], list[str]]] = [
    ("Safety Screening", ["policy_gate.checked"], ["policy_gate.allowed"], ["request.blocked"]),
    ("Request Classification", ["intent.started"], ["intent.classified"], ["intent.empty_question", "intent.model_error"]),
    ("Evidence Retrieval", ["retrieval.started", "exploration.started"], ["retrieval.completed", "exploration.completed"], ["retrieval.error", "retrieval.content_blocked"]),
    ("Evidence Validation", ["context_gate.started"], ["context_gate.completed"], []),
    ("SQL Drafting", ["query_plan.started"], ["query_plan.built"], ["query_plan.no_schema_snapshot", "query_plan.error"]),
    ("Answer Creation", ["general_answer.started", "documentation_answer.started"], ["general_answer.completed", "documentation_answer.completed"],
     ["general_answer.budget_exceeded", "general_answer.error", "documentation_answer.budget_exceeded", "documentation_answer.error"]),
    ("Final Safety Review", ["output_safety.started"], ["output_safety.completed"],
     ["output_safety.error", "output_safety.budget_exceeded", "output_safety.invalid_response", "output_safety.validation_error"]),
]
#: The stage that a model call belongs to.
OPERATION_STAGE = {
    "intent_classification": "Request Classification", "schema_exploration": "Evidence Retrieval", "general_answer": "Answer Creation",
    "documentation_answer": "Answer Creation", "query_planning": "SQL Drafting", "output_safety": "Final Safety Review", "policy_check": "Safety Screening",
}
#: Days that a served view may cover, and how many it does unless told.
LEAST_DAYS, MOST_DAYS, SERVED_DAYS = 1, 365, 7
#: Dollars: per TiB scanned, and per million tokens read, written, and read from cache.
SCAN_PRICE, INPUT_PRICE, OUTPUT_PRICE, CACHED_PRICE = 6.25, 3.0, 15.0, 0.3


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def run_latency(traces: DataFrame) -> DataFrame:
    """run_id, latency_ms: last minus first timestamp, 0 with fewer than two."""
    span = (F.max("ts") - F.min("ts")) * 1000
    return traces.groupBy("run_id").agg(F.when(F.count("ts") >= 2, span).otherwise(F.lit(0.0)).alias("latency_ms"))


def usage_cost() -> Column:
    def tokens(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    scan = F.when(F.col("event_type") == "cost_gate", F.coalesce("bytes_processed", F.lit(0)) / F.lit(float(1 << 40)) * SCAN_PRICE)
    model = ((tokens("input_tokens") + tokens("cache_creation_input_tokens")) * INPUT_PRICE + tokens("output_tokens") * OUTPUT_PRICE + tokens("cache_read_input_tokens") * CACHED_PRICE) / 1e6
    return F.coalesce(scan, F.when(F.col("event_type") == "model_usage", model), F.lit(0.0))


def run_audit(audits: DataFrame) -> DataFrame:
    """Per run: tokens, cost, rejected, classified, first_timestamp, user. Order within a run: file and line."""
    place = F.struct("file", "line_no")
    return audits.groupBy("run_id").agg(
        F.sum(F.when(F.col("event_type") == "model_usage", F.coalesce("total_tokens", F.lit(0))).otherwise(0)).alias("tokens"),
        F.sum(usage_cost()).alias("cost"),
        F.coalesce(F.bool_or(F.col("decision") == "rejected"), F.lit(False)).alias("rejected"),
        F.coalesce(F.bool_or(F.col("event_type") == "intent_classified"), F.lit(False)).alias("classified"),
        F.min_by("timestamp", place).alias("first_timestamp"),
        F.min_by("user_id", place).alias("user_id"),
    )


def run_table(audits: DataFrame, traces: DataFrame) -> DataFrame:
    """One row per audited run with its trace figures; traces alone make the runs only if there are no audits."""
    success = F.get_json_object("payload", "$.allowed") == "true"
    checked = traces.where("event = 'validate_sql.completed'").groupBy("run_id").agg(F.min_by(F.coalesce(success, F.lit(False)), F.struct("file", "line_no")).alias("sql_success"))
    audited = run_audit(audits)
    if audits.limit(1).count() == 0:
        audited = traces.select("run_id").distinct().select(
            "run_id", F.lit(0).cast("long").alias("tokens"), F.lit(0.0).alias("cost"), F.lit(False).alias("rejected"), F.lit(False).alias("classified"),
            F.lit(None).cast("string").alias("first_timestamp"), F.lit(None).cast("string").alias("user_id"))
    return audited.join(run_latency(traces), "run_id", "left").join(checked, "run_id", "left").na.fill(0.0, ["latency_ms"])


def _rates() -> list[Column]:
    n = F.count(F.lit(1))
    attempts = F.count("sql_success")
    return [
        n.alias("queries"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum("latency_ms"), F.lit(0.0)).cast("long").alias("total_latency_ms"),
        ratio(F.coalesce(F.sum("latency_ms"), F.lit(0.0)), n).alias("avg_latency_ms"), ratio(F.count_if("rejected") * 100, n).alias("rejection_rate"),
        ratio(F.count_if("sql_success") * 100, attempts).alias("sql_success_rate"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        ratio(F.coalesce(F.sum("cost"), F.lit(0.0)), n).alias("avg_cost_per_query"), F.min("first_timestamp").alias("earliest"), F.max("first_timestamp").alias("latest"),
    ]


def summary(runs: DataFrame) -> DataFrame:
    return runs.agg(*_rates())


def by_date(runs: DataFrame) -> DataFrame:
    """Per day of a run's first audit event."""
    dated = runs.withColumn("date", F.substring("first_timestamp", 1, 10)).where("date is not null and date <> ''")
    return dated.groupBy("date").agg(*_rates())


def by_intent(runs: DataFrame, intent: Column | None = None) -> DataFrame:
    """Per intent of classified runs. Logs don't say which intent, so it is "general" unless a column is given."""
    named = runs.where("classified").withColumn("intent", F.lit("general") if intent is None else intent)
    n = F.count(F.lit(1))
    return named.groupBy("intent").agg(n.alias("count"), F.avg("latency_ms").alias("avg_latency_ms"), ratio(F.count_if("sql_success") * 100, n).alias("success_rate"), ratio(F.count_if("rejected") * 100, n).alias("rejection_rate"), F.floor(F.avg("tokens")).cast("long").alias("avg_tokens"))


def cutoff(start: str | None = None, days: int | None = None, now: datetime | None = None) -> str | None:
    """ISO text of the first moment that counts: ``start`` as given, else ``days`` before ``now`` (UTC); None takes all."""
    if start:
        datetime.fromisoformat(start)
        return start
    if days is None:
        return None
    if not LEAST_DAYS <= days <= MOST_DAYS:
        raise ValueError(f"days must be from {LEAST_DAYS} to {MOST_DAYS}")
    moment = now or datetime.now(timezone.utc)
    moment = moment.astimezone(timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment
    return (moment - timedelta(days=days)).isoformat()


def audits_since(audits: DataFrame, first: str | None) -> DataFrame:
    """Audit events from that moment on, compared as ISO text, as the logs write it; events without a time go."""
    return audits if first is None else audits.where(F.col("timestamp") >= first)


def traces_since(traces: DataFrame, first: str | None) -> DataFrame:
    """Trace events from that moment on (UTC)."""
    if first is None:
        return traces
    moment = datetime.fromisoformat(first)
    return traces.where(F.col("ts") >= (moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).timestamp())


def served(audits: DataFrame, traces: DataFrame, days: int = SERVED_DAYS, start: str | None = None, now: datetime | None = None) -> dict[str, DataFrame]:
    """The roll-ups over the last days: summary (one row, also without runs), by_date and by_intent."""
    first = cutoff(start, days, now)
    runs = run_table(audits_since(audits, first), traces_since(traces, first))
    return {"summary": summary(runs), "by_date": by_date(runs), "by_intent": by_intent(runs)}


def stage_dimension(spark: SparkSession) -> DataFrame:
    """event, stage, role (start, success, failure) and the stage's place."""
    rows = [(e, name, role, k) for k, (name, *lists) in enumerate(STAGES) for role, events in zip(("start", "success", "failure"), lists, strict=True) for e in events]
    return spark.createDataFrame(rows, "event string, stage string, role string, place int")


def fifo_pairs(events: DataFrame) -> DataFrame:
    """Pairs each end with the earliest unpaired start of its run and stage. Input: run_id, stage, role, ts, seq.

    With S and T the numbers of starts and ends so far, U = max(0, running maximum of T - S) ends are unpaired. An end
    at which U grows has no start; any other end pairs with start number T - U. Returns ends with started (or null).
    """
    order = Window.partitionBy("run_id", "stage").orderBy("ts", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumns({"__s": F.count_if(F.col("role") == "start").over(so_far), "__t": F.count_if(F.col("role") != "start").over(so_far)})
    unpaired = F.greatest(F.lit(0), F.max(F.col("__t") - F.col("__s")).over(so_far))
    counted = counted.withColumn("__u", unpaired).withColumn("__grew", F.col("__u") > F.coalesce(F.lag("__u").over(order), F.lit(0)))
    starts = counted.where("role = 'start'").select("run_id", "stage", F.col("__s").alias("__k"), F.col("ts").alias("started"))
    ends = counted.where("role <> 'start'").withColumn("__k", F.when(~F.col("__grew"), F.col("__t") - F.col("__u")))
    return ends.join(starts, ["run_id", "stage", "__k"], "left").drop("__s", "__t", "__u", "__grew", "__k")


def by_stage(traces: DataFrame, audits: DataFrame) -> DataFrame:
    """All stages in workflow order: ends, timed ends, latency, success, and tokens of their model calls."""
    spark = traces.sparkSession
    dimension = F.broadcast(stage_dimension(spark))
    ends = fifo_pairs(traces.join(dimension, "event").select("run_id", "stage", "role", "ts", "seq"))
    ms = F.when(F.col("ts") >= F.col("started"), (F.col("ts") - F.col("started")) * 1000)
    timed = ends.withColumn("ms", ms).groupBy("stage").agg(F.count(F.lit(1)).alias("ended"), F.count("ms").alias("timed_count"), F.avg("ms").alias("avg_latency_ms"), F.min("ms").alias("min_latency_ms"), F.max("ms").alias("max_latency_ms"), F.count_if(F.col("role") == "success").alias("success_count"), F.count_if(F.col("role") == "failure").alias("failure_count"))
    calls = spark.createDataFrame(list(OPERATION_STAGE.items()), "operation string, stage string")
    usage = audits.where("event_type = 'model_usage'").join(F.broadcast(calls), "operation")
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(a) for c, a in (("total_tokens", "total_tokens"), ("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"), ("cache_creation_input_tokens", "cache_creation_tokens"), ("cache_read_input_tokens", "cache_read_tokens"))]
    tokens = usage.groupBy("stage").agg(*sums)
    only_usage = usage.select("stage", "run_id").distinct().join(ends.select("stage", "run_id").distinct(), ["stage", "run_id"], "left_anti").groupBy("stage").agg(F.count(F.lit(1)).alias("untraced"))
    every = spark.createDataFrame([(k, s[0]) for k, s in enumerate(STAGES)], "place int, stage string")
    joined = every.join(timed, "stage", "left").join(tokens, "stage", "left").join(only_usage, "stage", "left").na.fill(0)
    count = F.col("ended") + F.col("untraced")
    whole = F.when(F.col("success_count") + F.col("failure_count") > 0, F.col("success_count") + F.col("failure_count")).otherwise(count)
    return joined.withColumns({"count": count, "success_rate": ratio(F.col("success_count") * 100, whole)}).drop("ended", "untraced")


def event_durations(traces: DataFrame) -> DataFrame:
    """Adds next_event, duration (to the next event of the run, 4 places) and is_last."""
    order = Window.partitionBy("run_id").orderBy("ts", "seq")
    after = F.lead("ts").over(order)
    known = (F.coalesce(F.col("ts"), F.lit(0.0)) != 0) & (F.coalesce(after, F.lit(0.0)) != 0)
    return traces.withColumns({"next_event": F.lead("event").over(order), "duration": F.when(known, F.round(after - F.col("ts"), 4)), "is_last": F.lead(F.lit(1)).over(order).isNull()})


def run_edges(traces: DataFrame) -> DataFrame:
    """run_id, source, target, n: transitions between consecutive events."""
    return event_durations(traces).where("not is_last").groupBy("run_id", F.col("event").alias("source"), F.col("next_event").alias("target")).agg(F.count(F.lit(1)).alias("n"))


#: The status that a run's last event gives it.
LAST_EVENT_STATUS = {"answer.ready": "success", "request.blocked": "blocked", "request.error": "error"}


def run_status(traces: DataFrame, statuses: dict[str, str] | None = None) -> DataFrame:
    """run_id, first_ts, last_event, status (unknown for other last events), in order of first_ts for readers that sort."""
    last = traces.groupBy("run_id").agg(F.min("ts").alias("first_ts"), F.max_by("event", F.struct("ts", "seq")).alias("last_event"))
    cases = [(F.col("last_event") == e, F.lit(s)) for e, s in (statuses or LAST_EVENT_STATUS).items()]
    return last.withColumn("status", F.coalesce(*[F.when(c, s) for c, s in cases], F.lit("unknown")))


def decision_table(audits: DataFrame) -> DataFrame:
    """Per run and event type: allowed, rejected, error counts, zero-filled."""
    counts = [F.count_if(F.col("decision") == d).alias(d) for d in ("allowed", "rejected", "error")]
    return audits.groupBy("run_id", "event_type").agg(*counts)


def audit_summary(audits: DataFrame, start: str | None = None, end: str | None = None, user: str | None = None) -> DataFrame:
    """Per run: header of its first event and the last decision of each event type, within the filters."""
    for condition in ([F.col("timestamp") >= start] if start else []) + ([F.col("timestamp") <= end] if end else []) + ([F.col("user_id") == user] if user else []):
        audits = audits.where(condition)
    place = F.struct("file", "line_no")
    last = audits.groupBy("run_id", "event_type").agg(F.max_by("decision", place).alias("decision"), F.min_by("timestamp", place).alias("ts"), F.min_by("user_id", place).alias("user_id"), F.min(place).alias("place"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "decision"))))
    return last.groupBy("run_id").agg(F.min_by("ts", "place").alias("timestamp"), F.min_by("user_id", "place").alias("user_id"), entries.alias("decisions"))


def redacted(payload: str, sensitive: str = r"(?i)(prompt|question|answer|text|sql|token|secret|password|api_?key)") -> Column:
    """A flat JSON object's text with the values of sensitive keys replaced."""
    fields = F.from_json(payload, "map<string,string>")
    return F.to_json(F.transform_values(fields, lambda k, v: F.when(k.rlike(sensitive), F.lit("[REDACTED]")).otherwise(v)))
