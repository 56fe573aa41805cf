"""Readers and writers for append-only JSONL logs and corpora."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fields that every trace line may have; the whole line is kept beside them, since payloads are open.
TRACE = "ts double, seq long, run_id string, event string, domain string"
AUDIT = (
    "timestamp string, run_id string, user_id string, event_type string, decision string, reason string, sql string, bytes_processed long, "
    "referenced_tables array<string>, provider string, operation string, model string, input_tokens long, output_tokens long, "
    "cache_creation_input_tokens long, cache_read_input_tokens long, total_tokens long"
)
CORPUS = "chunk_id string, generated_queries array<string>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), line. Files are read whole so that numbers hold; log files are one run or day each."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path, wholetext=True)
    lines = F.posexplode(F.split("value", "\n")).alias("at", "line")
    return whole.select(F.input_file_name().alias("file"), lines).select("file", (F.col("at") + 1).alias("line_no"), F.trim(F.regexp_replace("line", "\r$", "")).alias("line")).where("line <> ''")


def parsed(lines: DataFrame, schema: str, required: str) -> DataFrame:
    """Adds record (a struct) and warning: malformed, not_object or missing_<required>; null if the line is good."""
    kind = F.get_json_object("line", "$")
    valid = F.try_parse_json("line").isNotNull()
    is_object = kind.isNotNull() & F.col("line").startswith("{")
    record = F.from_json(F.when(valid & is_object, F.col("line")), schema, {"mode": "PERMISSIVE"})
    marked = lines.withColumn("record", record)
    warning = F.when(~valid, "malformed").when(~is_object, "not_object").when(F.coalesce(F.col(f"record.{required}"), F.lit("")) == "", f"missing_{required}")
    return marked.withColumn("warning", warning)


def read_traces(spark: SparkSession, path: str, since: float | None = None) -> DataFrame:
    """Good trace lines with file and line_no; run_id falls back to the file's stem. ``since``: least ts in seconds."""
    rows = parsed(numbered_lines(spark, path), TRACE, "run_id").where("warning is null or warning = 'missing_run_id'")
    stem = F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)
    found = rows.select("file", "line_no", F.col("line").alias("payload"), "record.*").withColumn("run_id", F.coalesce("run_id", stem))
    return found if since is None else found.where(F.col("ts") >= since)


def trace_warnings(spark: SparkSession, path: str) -> DataFrame:
    return parsed(numbered_lines(spark, path), TRACE, "run_id").where("warning is not null").select("file", "line_no", "warning")


def read_audit(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Good audit lines with file and line_no. ``since``: least ISO timestamp, compared as text."""
    rows = parsed(numbered_lines(spark, path), AUDIT, "run_id").where("warning is null")
    found = rows.select("file", "line_no", "record.*")
    return found if since is None else found.where(F.col("timestamp") >= since)


def audit_faults(events: DataFrame) -> DataFrame:
    """Events that break the log's rules, with the rule: for quarantine before they are counted."""
    usage = F.col("event_type") == "model_usage"
    lacks = F.col("provider").isNull() | F.col("operation").isNull() | F.col("model").isNull() | F.col("total_tokens").isNull()
    empty = F.lit(False)
    for name in ("timestamp", "run_id", "event_type", "decision"):
        empty = empty | (F.coalesce(F.col(name), F.lit("")) == "")
    rule = F.when(empty, "missing_field").when(F.col("decision").isin("rejected", "error") & F.col("reason").isNull(), "missing_reason").when(usage & lacks, "incomplete_usage")
    negative = F.lit(False)
    for name in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "total_tokens"):
        negative = negative | (F.coalesce(F.col(name), F.lit(0)) < 0)
    return events.withColumn("fault", F.coalesce(rule, F.when(negative, "negative_tokens"))).where("fault is not null")


def append_audit(events: DataFrame, path: str) -> None:
    """Append as JSON, one folder per run."""
    events.withColumn("run", F.col("run_id")).write.mode("append").partitionBy("run").json(path)


def read_expansions(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id and its queries joined by line feeds. Blank ids, missing queries and repeated ids are errors."""
    rows = spark.read.schema(CORPUS).json(path)
    bad = rows.where("chunk_id is null or trim(chunk_id) = '' or generated_queries is null or size(generated_queries) = 0")
    twice = rows.groupBy("chunk_id").count().where("count > 1")
    if bad.limit(1).count() or twice.limit(1).count():
        raise ValueError("expansion corpus has blank, empty or repeated entries")
    return rows.select("chunk_id", F.array_join("generated_queries", "\n").alias("queries"))


def read_expansions_leniently(spark: SparkSession, path: str) -> DataFrame:
    """Like :func:`read_expansions`, but blank lines are skipped and the last of repeated ids counts."""
    rows = numbered_lines(spark, path).select("file", "line_no", F.from_json("line", CORPUS).alias("r")).where("r.chunk_id is not null")
    return rows.groupBy("r.chunk_id").agg(F.max_by(F.array_join("r.generated_queries", "\n"), F.struct("file", "line_no")).alias("queries"))


def append_traces(events: DataFrame, path: str, redacted: Column) -> None:
    """Append ts, run_id, event and the redacted payload as JSON. seq continues each run's numbers from what is there."""
    spark = events.sparkSession
    try:
        before = spark.read.json(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("__before"))
    except AnalysisException:  # nothing there yet
        before = spark.createDataFrame([], "run_id string, __before long")
    order = Window.partitionBy("run_id").orderBy("ts", "event")
    numbered = events.join(before, "run_id", "left").withColumn("seq", F.coalesce("__before", F.lit(0)) + F.row_number().over(order) - 1)
    bad = numbered.where("ts is null or ts < 0 or coalesce(run_id, '') = '' or coalesce(event, '') = ''")
    if bad.limit(1).count():
        raise ValueError("events break the trace contract")
    numbered.select("ts", "seq", "run_id", "event", redacted.alias("payload"), F.col("run_id").alias("run")).write.mode("append").partitionBy("run").json(path)
