"""Log sources and roll-ups against loops."""

import json
import random
from collections import defaultdict

import pytest

from sablequery.operators import logs
from sablequery.sources import jsonl


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def test_trace_lines_with_warnings(spark, tmp_path):
    write(tmp_path / "one.jsonl", [{"run_id": "r1", "ts": 1.5, "event": "a", "extra": {"k": 1}}, "", "{broken", "[1, 2]", {"ts": 2.0, "event": "b"}])
    write(tmp_path / "two.jsonl", [{"run_id": "r1", "ts": 3.0, "event": "c"}])
    rows = jsonl.read_traces(spark, str(tmp_path)).collect()
    assert sorted((r["run_id"], r["event"], r["line_no"]) for r in rows) == [("one", "b", 5), ("r1", "a", 1), ("r1", "c", 1)]
    assert sorted((r["line_no"], r["warning"]) for r in jsonl.trace_warnings(spark, str(tmp_path)).collect()) == [(3, "malformed"), (4, "not_object"), (5, "missing_run_id")]
    assert [r["event"] for r in jsonl.read_traces(spark, str(tmp_path), since=2.5).collect()] == ["c"]


def test_audit_round_trip_and_faults(spark, tmp_path):
    write(tmp_path / "a.jsonl", [
        {"timestamp": "2024-01-01T00:00:00", "run_id": "r", "event_type": "policy_gate", "decision": "rejected", "reason": "x", "user_id": "u"},
        {"timestamp": "2024-01-02T00:00:00", "run_id": "r", "event_type": "policy_gate", "decision": "rejected"},
        {"timestamp": "2024-01-03T00:00:00", "run_id": "r", "event_type": "model_usage", "decision": "allowed", "total_tokens": 5},
        {"timestamp": "2024-01-04T00:00:00", "run_id": "r", "event_type": "model_usage", "decision": "allowed", "provider": "p", "operation": "o", "model": "m", "total_tokens": -1},
    ])
    events = jsonl.read_audit(spark, str(tmp_path))
    assert [r["fault"] for r in jsonl.audit_faults(events).orderBy("timestamp").collect()] == ["missing_reason", "incomplete_usage", "negative_tokens"]
    assert jsonl.read_audit(spark, str(tmp_path), since="2024-01-03").count() == 2
    jsonl.append_audit(events, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    table = {(r["run_id"], r["event_type"]): (r["allowed"], r["rejected"], r["error"]) for r in logs.decision_table(events).collect()}
    assert table == {("r", "policy_gate"): (0, 2, 0), ("r", "model_usage"): (2, 0, 0)}
    summary = logs.audit_summary(events, end="2024-01-03T12:00:00", user="u").first()
    assert summary["decisions"] == {"policy_gate": "rejected"} and summary["user_id"] == "u"


def loop_stages(events):
    """Stage figures by a queue per run and stage."""
    waiting, out = defaultdict(list), defaultdict(lambda: [0, 0, 0, []])
    for run, ts, _, stage, role in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        if role == "start":
            waiting[run, stage].append(ts)
            continue
        found = out[stage]
        found[0] += 1
        found[1 if role == "success" else 2] += 1
        if waiting[run, stage]:
            started = waiting[run, stage].pop(0)
            found[3].append((ts - started) * 1000)
    return out


def test_stages_match_a_queue(spark):
    rng = random.Random(5)
    names = {e: (stage, role) for stage, *lists in logs.STAGES for role, events in zip(("start", "success", "failure"), lists, strict=True) for e in events}
    rows = [(f"r{rng.randrange(12)}", float(rng.randrange(60)), k, rng.choice([*names, "other"])) for k in range(3000)]
    frame = spark.createDataFrame(rows, "run_id string, ts double, seq long, event string").selectExpr("*", "'' as payload", "'f' as file", "seq as line_no")
    usage = [("r1", "model_usage", "query_planning", 7, 3, 4, 0, 0), ("zz", "model_usage", "query_planning", 1, 1, 0, 0, 0), ("zz", "model_usage", "elsewhere", 9, 9, 0, 0, 0)]
    audits = spark.createDataFrame(usage, "run_id string, event_type string, operation string, total_tokens long, input_tokens long, output_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long")
    wanted = loop_stages([(r, t, s, *names[e]) for r, t, s, e in rows if e in names])
    got = {r["stage"]: r for r in logs.by_stage(frame, audits).collect()}
    assert sorted(got, key=lambda s: got[s]["place"]) == [s[0] for s in logs.STAGES]
    for stage, (count, good, bad, times) in wanted.items():
        r = got[stage]
        extra = stage == "SQL Drafting"  # one run has usage but no end
        assert (r["count"], r["success_count"], r["failure_count"], r["timed_count"]) == (count + extra, good, bad, len(times))
        assert abs(r["avg_latency_ms"] - sum(times) / len(times)) < 1e-6 and r["max_latency_ms"] == max(times)
    assert got["SQL Drafting"]["total_tokens"] == 8


def test_summary_without_audits_uses_traces(spark):
    traces = spark.createDataFrame([("a", 1.0, 0, "x", '{"allowed": true}', "f", 1), ("a", 3.0, 1, "validate_sql.completed", '{"allowed": true}', "f", 2), ("b", None, 0, "x", "{}", "f", 3)], "run_id string, ts double, seq long, event string, payload string, file string, line_no long")
    audits = spark.createDataFrame([], jsonl.AUDIT + ", file string, line_no long")
    row = logs.summary(logs.run_table(audits, traces)).first()
    assert (row["queries"], row["total_latency_ms"], row["sql_success_rate"], row["rejection_rate"]) == (2, 2000, 100.0, 0.0)
    empty = logs.summary(logs.run_table(audits, traces.where("false"))).first()
    assert (empty["queries"], empty["avg_latency_ms"], empty["cost"]) == (0, 0.0, 0.0)


def test_redaction_keeps_other_keys(spark):
    row = spark.createDataFrame([('{"prompt": "secret", "n": 3}',)], "p string").select(logs.redacted("p").alias("p")).first()
    assert json.loads(row["p"]) == {"prompt": "[REDACTED]", "n": "3"}


def test_expansion_corpus(spark, tmp_path):
    import pytest

    write(tmp_path / "good.jsonl", [{"chunk_id": "a", "generated_queries": ["x", "y"]}, {"chunk_id": "b", "generated_queries": ["z"]}])
    assert {r["chunk_id"]: r["queries"] for r in jsonl.read_expansions(spark, str(tmp_path / "good.jsonl")).collect()} == {"a": "x\ny", "b": "z"}
    write(tmp_path / "bad.jsonl", [{"chunk_id": "a", "generated_queries": ["x"]}, "", {"chunk_id": "a", "generated_queries": ["y"]}])
    with pytest.raises(ValueError):
        jsonl.read_expansions(spark, str(tmp_path / "bad.jsonl"))
    assert {r["chunk_id"]: r["queries"] for r in jsonl.read_expansions_leniently(spark, str(tmp_path / "bad.jsonl")).collect()} == {"a": "y"}


def test_registry_and_redaction(spark):
    from sablequery.operators import traces as T

    names = [r["event"] for r in T.event_dimension(spark).collect()]
    assert len(names) == len(set(names)) == 74
    staged = {e for _, *lists in logs.STAGES for events in lists for e in events}
    assert staged <= set(names)
    payload = json.dumps({"question": "q", "meta": {"answer": [1, 2], "n": 3}, "list": [{"sql": "x"}], "Patient-Name": "p", "ok": {"my_token": 1}})
    row = spark.createDataFrame([(payload,), ("no json",), (None,)], "p string").select(T.log_payload("p", b"k").alias("a"), T.view_payload("p").alias("b")).collect()
    logged, viewed = json.loads(row[0]["a"]), json.loads(row[0]["b"])
    assert logged["question"]["redacted"] and logged["question"]["bytes"] == 3 and logged["meta"]["answer"]["item_count"] == 2 and logged["meta"]["n"] == 3
    assert logged["list"][0]["sql"]["digest"].startswith("hmac-sha256:")
    assert viewed["Patient-Name"] == "[REDACTED]" and viewed["ok"] == {"my_token": "[REDACTED]"} and viewed["question"] == "q"
    assert row[1]["a"] is None and row[2]["b"] is None


def test_appended_traces_are_numbered_and_redacted(spark, tmp_path):
    import pytest

    from sablequery.operators import traces as T

    path = str(tmp_path / "traces")
    rows = [("r", 1.0, "a", '{"sql": "x"}'), ("r", 2.0, "b", "{}"), ("s", 1.0, "a", "{}")]
    frame = spark.createDataFrame(rows, "run_id string, ts double, event string, payload string")
    jsonl.append_traces(frame, path, T.log_payload("payload", b"k"))
    jsonl.append_traces(frame.where("run_id = 'r'"), path, T.log_payload("payload", b"k"))
    back = spark.read.json(path).collect()
    assert sorted((r["run_id"], r["seq"]) for r in back) == [("r", 0), ("r", 1), ("r", 2), ("r", 3), ("s", 0)]
    assert all('"x"' not in r["payload"] for r in back)
    with pytest.raises(ValueError):
        jsonl.append_traces(frame.selectExpr("run_id", "-1d as ts", "event", "payload"), path, T.log_payload("payload", b"k"))


def test_markdown_report_is_whole_or_refused(spark):
    from sablequery.sources.artifacts import report_markdown

    lines = report_markdown(spark.range(3).selectExpr("id", "id / 3 as share"), "Shares", most=3).splitlines()
    assert lines[:4] == ["# Shares", "", "| id | share |", "|---|---|"] and len(lines) == 7 and lines[-1] == "| 2 | 0.67 |"
    with pytest.raises(ValueError, match="more than 2 rows"):
        report_markdown(spark.range(3), "Shares", most=2)


def test_date_window_and_served_views(spark):
    from datetime import datetime, timezone

    now = datetime(2024, 3, 10, 12, tzinfo=timezone.utc)
    assert logs.cutoff("2024-03-01", 3, now) == "2024-03-01" and logs.cutoff() is None
    assert logs.cutoff(days=1, now=now) == "2024-03-09T12:00:00"
    for bad in (0, 366, -1):
        with pytest.raises(ValueError):
            logs.cutoff(days=bad)
    with pytest.raises(ValueError):
        logs.cutoff("yesterday")
    stamps = ["2024-03-09T11:59:59", "2024-03-09T12:00:00", "2024-03-10T01:00:00", None]
    rows = [(t, f"r{k}", "u", "intent_classified", "allowed", None, None, None, None, None, None, "f", k) for k, t in enumerate(stamps)]
    audits = spark.createDataFrame(rows, "timestamp string, run_id string, user_id string, event_type string, decision string, bytes_processed long, input_tokens long, output_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long, total_tokens long, file string, line_no int")
    epoch = [datetime.fromisoformat(t).replace(tzinfo=timezone.utc).timestamp() for t in stamps[:3]]
    traces = spark.createDataFrame([(f"r{k}", t + d, k, "e", None, "f", k) for k, t in enumerate(epoch) for d in (0.0, 2.0)], "run_id string, ts double, seq long, event string, payload string, file string, line_no int")
    views = logs.served(audits, traces, 1, now=now)
    one = views["summary"].first()
    assert (one["queries"], one["total_latency_ms"], one["earliest"]) == (2, 4000, "2024-03-09T12:00:00")
    assert {r["date"]: r["queries"] for r in views["by_date"].collect()} == {"2024-03-09": 1, "2024-03-10": 1}
    assert views["by_intent"].first()["count"] == 2
    assert logs.served(audits, traces, start="2024-03-09", now=now)["summary"].first()["queries"] == 3
    assert logs.served(audits, traces, start="2025-01-01")["summary"].first()["queries"] == 0
