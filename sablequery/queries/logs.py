"""Log roll-ups over ``events``: user_id is the run, event_type the event, props carries the payload."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs, memory, traces as T
from .registry import query, table

def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.select(F.col("user_id").cast("string").alias("run_id"), seconds.alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"), F.col("props").alias("payload"), F.lit("events").alias("file"), F.col("event_id").alias("line_no"))


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are model calls (value x 100 tokens), purchases scans, errors rejections, signups classifications."""
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    tokens = F.floor(F.coalesce("value", F.lit(0.0)) * 100).cast("long")
    return events.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("user_id").cast("string").alias("run_id"), F.col("user_id").cast("string").alias("user_id"),
        F.when(kind == "click", "model_usage").when(kind == "purchase", "cost_gate").when(kind == "signup", "intent_classified").otherwise("policy_gate").alias("event_type"),
        F.when(kind == "error", "rejected").otherwise("allowed").alias("decision"),
        F.when(kind == "purchase", tokens * 1000000).alias("bytes_processed"), F.lit("query_planning").alias("operation"),
        F.when(kind == "click", tokens).alias("input_tokens"), F.when(kind == "click", F.floor(tokens / 2).cast("long")).alias("output_tokens"),
        F.when(kind == "click", F.lit(0).cast("long")).alias("cache_creation_input_tokens"), F.when(kind == "click", F.floor(tokens / 4).cast("long")).alias("cache_read_input_tokens"),
        F.when(kind == "click", tokens).alias("total_tokens"), F.lit("events").alias("file"), F.col("event_id").alias("line_no"))


def _rounded(frame: DataFrame, places: int = 4) -> DataFrame:
    return frame.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in frame.dtypes])


#: The same two relations in DuckDB.
TRACE_SQL = "t AS (SELECT CAST(user_id AS VARCHAR) AS run_id, epoch_us(ts) / 1e6 AS ts, event_id AS seq, event_type AS event, props AS payload FROM events)"
AUDIT_SQL = """v AS (SELECT *, CAST(floor(coalesce(value, 0) * 100) AS BIGINT) AS k FROM events),
a AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, CAST(user_id AS VARCHAR) AS run_id, event_id AS line_no,
 CASE event_type WHEN 'click' THEN 'model_usage' WHEN 'purchase' THEN 'cost_gate' WHEN 'signup' THEN 'intent_classified' ELSE 'policy_gate' END AS event_type,
 CASE event_type WHEN 'error' THEN 'rejected' ELSE 'allowed' END AS decision,
 CASE WHEN event_type = 'click' THEN k ELSE 0 END AS tokens,
 CASE event_type WHEN 'purchase' THEN k * 1000000 / 1099511627776.0 * 6.25
  WHEN 'click' THEN (k * 3.0 + floor(k / 2) * 15.0 + floor(k / 4) * 0.3) / 1e6 ELSE 0 END AS cost FROM v)"""
RUN_SQL = f"""{TRACE_SQL}, {AUDIT_SQL},
l AS (SELECT run_id, CASE WHEN count(ts) >= 2 THEN (max(ts) - min(ts)) * 1000 ELSE 0 END AS latency_ms FROM t GROUP BY 1),
r AS (SELECT run_id, sum(tokens) AS tokens, sum(cost) AS cost, bool_or(decision = 'rejected') AS rejected, bool_or(event_type = 'intent_classified') AS classified, min_by(timestamp, line_no) AS first_timestamp FROM a GROUP BY 1),
j AS (SELECT r.*, coalesce(l.latency_ms, 0) AS latency_ms FROM r LEFT JOIN l USING (run_id))"""


@query(f"WITH {TRACE_SQL} SELECT run_id, round(CASE WHEN count(ts) >= 2 THEN (max(ts) - min(ts)) * 1000 ELSE 0 END, 1) AS latency_ms FROM t GROUP BY 1")
def log_run_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(logs.run_latency(traces(spark, sf_dir)), 1)


@query(f"WITH {RUN_SQL} SELECT run_id, CAST(tokens AS BIGINT) AS tokens, round(cost, 6) AS cost FROM r")
def log_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(logs.run_audit(audits(spark, sf_dir)).select("run_id", "tokens", "cost"), 6)


_FIGURES = """count(*) AS queries, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(avg(latency_ms) / 1000, 1) AS avg_latency_s, round(count(*) FILTER (rejected) * 100.0 / count(*), 4) AS rejection_rate,
 0.0::DOUBLE AS sql_success_rate, round(sum(cost), 4) AS cost, round(sum(cost) / count(*), 6) AS avg_cost_per_query, min(first_timestamp) AS earliest, max(first_timestamp) AS latest"""


def _figures(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.select(*keys, "queries", "total_tokens", F.round(F.col("avg_latency_ms") / 1000, 1).alias("avg_latency_s"), F.round("rejection_rate", 4).alias("rejection_rate"), "sql_success_rate", F.round("cost", 4).alias("cost"), F.round("avg_cost_per_query", 6).alias("avg_cost_per_query"), "earliest", "latest")


@query(f"WITH {RUN_SQL} SELECT {_FIGURES} FROM j")
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _figures(logs.summary(logs.run_table(audits(spark, sf_dir), traces(spark, sf_dir))))


@query(f"WITH {RUN_SQL} SELECT first_timestamp[1:10] AS date, {_FIGURES} FROM j GROUP BY 1")
def log_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _figures(logs.by_date(logs.run_table(audits(spark, sf_dir), traces(spark, sf_dir))), "date")


@query(f"WITH {RUN_SQL} SELECT 'general' AS intent, count(*) AS count, round(avg(latency_ms) / 1000, 1) AS avg_latency_s, round(count(*) FILTER (rejected) * 100.0 / count(*), 4) AS rejection_rate, CAST(floor(avg(tokens)) AS BIGINT) AS avg_tokens FROM j WHERE classified GROUP BY 1")
def log_by_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logs.by_intent(logs.run_table(audits(spark, sf_dir), traces(spark, sf_dir)))
    return found.select("intent", "count", F.round(F.col("avg_latency_ms") / 1000, 1).alias("avg_latency_s"), F.round("rejection_rate", 4).alias("rejection_rate"), "avg_tokens")


def served_week(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The views of the seven days before the last event of all."""
    last = table(spark, sf_dir, "events").agg(F.date_trunc("second", F.max("ts").cast("timestamp")).alias("last"))
    now = last.select(F.unix_seconds("last").alias("now")).first()["now"]
    return logs.served(audits(spark, sf_dir), traces(spark, sf_dir), now=datetime.fromtimestamp(now or 0, timezone.utc))


#: The relations above over those days.
_WEEK = "recent AS (SELECT * FROM events WHERE ts >= (SELECT date_trunc('second', max(ts)) - INTERVAL 7 DAY FROM events)), " + RUN_SQL.replace("FROM events", "FROM recent")


@query(f"WITH {_WEEK} SELECT {_FIGURES} FROM j")
def served_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _figures(served_week(spark, sf_dir)["summary"])


@query(f"WITH {_WEEK} SELECT first_timestamp[1:10] AS date, {_FIGURES} FROM j GROUP BY 1")
def served_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _figures(served_week(spark, sf_dir)["by_date"], "date")


@query(f"WITH {_WEEK} SELECT 'general' AS intent, count(*) AS count, round(count(*) FILTER (rejected) * 100.0 / count(*), 4) AS rejection_rate, CAST(floor(avg(tokens)) AS BIGINT) AS avg_tokens FROM j WHERE classified GROUP BY 1")
def served_by_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return served_week(spark, sf_dir)["by_intent"].select("intent", "count", F.round("rejection_rate", 4).alias("rejection_rate"), "avg_tokens")


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, min_by(event_type, event_id) AS first_event, min(event_id) AS line_no FROM events GROUP BY 1")
def log_first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).groupBy("run_id").agg(F.min_by("event", "line_no").alias("first_event"), F.min("line_no").alias("line_no"))


@query(f"WITH {AUDIT_SQL} SELECT run_id, event_type, count(*) FILTER (decision = 'allowed') AS allowed, count(*) FILTER (decision = 'rejected') AS rejected, count(*) FILTER (decision = 'error') AS error FROM a GROUP BY 1, 2")
def log_decision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.decision_table(audits(spark, sf_dir))


@query(f"""WITH {AUDIT_SQL}, f AS (SELECT * FROM a WHERE timestamp >= (SELECT min(timestamp)[1:10] FROM a)),
d AS (SELECT run_id, event_type, max_by(decision, line_no) AS decision FROM f GROUP BY 1, 2),
h AS (SELECT run_id, min_by(timestamp, line_no) AS timestamp FROM f GROUP BY 1)
SELECT run_id, timestamp, string_agg(event_type || '=' || decision, ',' ORDER BY event_type) AS decisions FROM d JOIN h USING (run_id) GROUP BY 1, 2""")
def log_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audits(spark, sf_dir)
    start = found.agg(F.substring(F.min("timestamp"), 1, 10)).first()[0]
    entries = F.transform(F.array_sort(F.map_entries("decisions")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return logs.audit_summary(found, start=start).select("run_id", "timestamp", F.array_join(entries, ",").alias("decisions"))


@query(f"WITH {AUDIT_SQL} SELECT count(*) AS n, count(DISTINCT run_id) AS runs FROM a WHERE timestamp >= '2024-01-05'")
def log_date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = logs.audits_since(audits(spark, sf_dir), logs.cutoff("2024-01-05", 7))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("runs"))


_PAIR_SQL = f"""WITH {TRACE_SQL}, e AS (SELECT *, event IN ('view', 'click') AS opens FROM t WHERE event IN ('view', 'click', 'purchase', 'error')),
c AS (SELECT *, count(*) FILTER (opens) OVER w AS s, count(*) FILTER (NOT opens) OVER w AS k FROM e WINDOW w AS (PARTITION BY run_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
u AS (SELECT *, greatest(0, max(k - s) OVER (PARTITION BY run_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)) AS un FROM c),
g AS (SELECT *, un > coalesce(lag(un) OVER (PARTITION BY run_id ORDER BY ts, seq), 0) AS grew FROM u)
SELECT x.run_id, x.seq, x.event, round(x.ts - y.ts, 3) AS waited FROM g x LEFT JOIN g y ON y.opens AND y.run_id = x.run_id AND y.s = x.k - x.un AND NOT x.grew WHERE NOT x.opens"""


@query(_PAIR_SQL)
def log_fifo_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("event")
    roles = F.when(role.isin("view", "click"), "start").when(role == "purchase", "success").when(role == "error", "failure")
    staged = traces(spark, sf_dir).withColumns({"role": roles, "stage": F.lit("all")}).where("role is not null")
    return logs.fifo_pairs(staged).select("run_id", "seq", "event", F.round(F.col("ts") - F.col("started"), 3).alias("waited"))


@query(f"""WITH {TRACE_SQL}, x AS (SELECT *, lead(ts) OVER w AS after, lead(event) OVER w AS next_event FROM t WINDOW w AS (PARTITION BY run_id ORDER BY ts, seq))
SELECT run_id, seq, event, next_event, round(after - ts, 4) AS duration, next_event IS NULL AS is_last FROM x""")
def log_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.event_durations(traces(spark, sf_dir)).select("run_id", "seq", "event", "next_event", "duration", "is_last")


@query(f"""WITH {TRACE_SQL}, x AS (SELECT *, lead(event) OVER (PARTITION BY run_id ORDER BY ts, seq) AS target FROM t)
SELECT run_id, event AS source, target, count(*) AS n FROM x WHERE target IS NOT NULL GROUP BY ALL""")
def log_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.run_edges(traces(spark, sf_dir))


@query(f"""WITH {TRACE_SQL} SELECT run_id, max_by(event, (ts, seq)) AS last_event, CASE max_by(event, (ts, seq)) WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error' ELSE 'unknown' END AS status FROM t GROUP BY 1""")
def log_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.run_status(traces(spark, sf_dir), {"purchase": "success", "error": "error"}).select("run_id", "last_event", "status")


@query()
def log_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage roll-up with the workflow's own event names dealt to the event types; tests compare it with a loop."""
    names = F.create_map(*[F.lit(x) for pair in (("view", "query_plan.started"), ("click", "intent.started"), ("purchase", "query_plan.built"), ("error", "query_plan.error"), ("signup", "intent.classified")) for x in pair])
    renamed = traces(spark, sf_dir).withColumn("event", names[F.col("event")])
    return logs.by_stage(renamed, audits(spark, sf_dir))


@query()
def redact_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", logs.redacted("props", r"(?i)(page|ref|token)").alias("props"))


@query("""SELECT CAST(user_id AS VARCHAR) AS run_id, CASE event_type WHEN 'view' THEN 'sql' WHEN 'purchase' THEN 'lifecycle' WHEN 'error' THEN 'sql' ELSE 'unknown' END AS domain,
 CASE event_type WHEN 'view' THEN 'ok' WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'error' ELSE 'unknown' END AS status, count(*) AS n FROM events GROUP BY ALL""")
def log_event_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains and statuses of the events once views, purchases and errors have registered names."""
    names = F.create_map(*[F.lit(x) for pair in (("view", "query_plan.started"), ("purchase", "answer.ready"), ("error", "query_plan.error")) for x in pair])
    renamed = traces(spark, sf_dir).withColumn("event", F.coalesce(names[F.col("event")], F.col("event")))
    return T.classified(renamed).groupBy("run_id", "domain", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) FILTER (event_type = 'click') AS model_calls, count(*) FILTER (event_type = 'view') AS tool_calls FROM events GROUP BY 1)
SELECT run_id, model_calls, tool_calls, model_calls > 8 AS models_over, tool_calls > 20 AS tools_over FROM r""")
def log_budget_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as model calls and views as tool calls against a run's limits."""
    names = F.create_map(*[F.lit(x) for pair in (("click", "model.usage"), ("view", "exploration.tool_completed")) for x in pair])
    renamed = traces(spark, sf_dir).withColumn("event", F.coalesce(names[F.col("event")], F.col("event")))
    used = T.budget_use(renamed)
    return used.select("run_id", "model_calls", "tool_calls", F.array_contains("exceeded", "model_calls").alias("models_over"), F.array_contains("exceeded", "tool_calls").alias("tools_over"))


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS chunk_id, min(event_id) AS place, max_by(value, event_id) AS value FROM events GROUP BY 1, 2)
SELECT run_id, chunk_id, value, row_number() OVER (PARTITION BY run_id ORDER BY place, chunk_id) AS rank FROM e QUALIFY rank <= 3""")
def log_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as evidence: first place, last value, three a run."""
    found = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("place"), F.col("event_type").alias("chunk_id"), "value")
    return T.accumulate_evidence(found, 3).select("run_id", "chunk_id", "value", F.col("rank").cast("long").alias("rank"))


def user_turns(events: DataFrame) -> DataFrame:
    """Every user's events as the turns of a thread."""
    return events.select(F.col("user_id").alias("thread_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.concat_ws(":", "event_type", "event_id").alias("turn"))


_SESSIONS = """t AS (SELECT user_id, epoch_us(ts) AS us, event_id, concat_ws(':', event_type, event_id) AS turn FROM events),
s AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < 1800000000 THEN 0 ELSE 1 END AS f FROM t),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)"""


@query(f"WITH {_SESSIONS} SELECT event_id, concat_ws(',', lag(turn, 2) OVER w, lag(turn) OVER w) AS held FROM g WINDOW w AS (PARTITION BY user_id, session ORDER BY us, event_id)")
def memory_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's thread remembers as an event comes."""
    return memory.remembered(user_turns(table(spark, sf_dir, "events"))).select(F.col("seq").alias("event_id"), F.array_join("held", ",").alias("held"))


@query(f"""WITH {_SESSIONS}, m AS (SELECT max(us) AS now FROM t), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS place, max(session) OVER (PARTITION BY user_id) AS latest,
 max(us) OVER (PARTITION BY user_id) AS last FROM g) SELECT user_id, string_agg(turn, ',' ORDER BY us, event_id) AS held FROM l, m WHERE place <= 2 AND session = latest AND now - last < 1800000000 GROUP BY 1""")
def memory_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What threads remember at the time of the last event of all."""
    turns = user_turns(table(spark, sf_dir, "events"))
    now = F.lit(turns.agg(F.max("ts")).first()[0]).cast("timestamp")
    return memory.memory_at(turns, now).select(F.col("thread_id").alias("user_id"), F.array_join("held", ",").alias("held"))
