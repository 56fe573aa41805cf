"""Cost approval before execution: an estimate of bytes scanned, a gate, a signed approval, a bounded run.

The estimate adds up the compressed column chunks that the plan's scans will read, from Parquet footers; only footers
are read. Approval is bound to the plan's hash, the byte ceiling and an expiry time.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import threading
import time
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Row

from .authorize import Approved, Violation
from .model import PlanError

LONGEST_LIFE, SHORTEST_SECRET = 3600, 32


@dataclass(frozen=True)
class CostLimits:
    max_bytes: int
    lifetime: int
    secret: bytes
    limit_allowed: bool = False  # whether a plan with a LIMIT may be approved; LIMIT never counts as evidence

    def __post_init__(self) -> None:
        if self.max_bytes <= 0 or not 1 <= self.lifetime <= LONGEST_LIFE or len(self.secret) < SHORTEST_SECRET:
            raise PlanError("invalid_cost_limits")

    @staticmethod
    def from_environment(prefix: str = "QUERY_") -> CostLimits:
        """Missing or malformed settings are errors: nothing is approved by default."""
        try:
            return CostLimits(int(os.environ[f"{prefix}MAX_BYTES"]), int(os.environ[f"{prefix}APPROVAL_SECONDS"]), os.environ[f"{prefix}APPROVAL_SECRET"].encode())
        except (KeyError, ValueError) as error:
            raise PlanError("invalid_cost_limits", str(error)) from error


@dataclass(frozen=True)
class Estimate:
    scanned_bytes: int | None
    tables: tuple[str, ...]
    error: str | None = None


def _scans(plan: object) -> list:
    found = [plan] if plan.getClass().getSimpleName() == "LogicalRelation" else []
    children = plan.children()
    return found + [x for k in range(children.size()) for x in _scans(children.apply(k))]


def estimate(frame: DataFrame, approved: Approved) -> Estimate:
    """Bytes of the column chunks that the optimised plan reads; a plan that can't be analysed is an error estimate."""
    try:
        total = 0
        spark = frame.sparkSession
        for scan in _scans(frame._jdf.queryExecution().optimizedPlan()):
            output = scan.output()
            # the relation lists all columns; the projection above it was pruned to what is used
            used = {output.apply(k).name() for k in range(output.size())}
            files = list(scan.relation().location().inputFiles())
            wanted = used & _used_columns(frame)
            total += sum(spark.sparkContext.parallelize(files, min(len(files), 64)).map(lambda f, c=frozenset(wanted): footer_bytes(f, c)).collect()) if len(files) > 64 else sum(footer_bytes(f, frozenset(wanted)) for f in files)
        return Estimate(total, tuple(t.casefold() for t in approved.plan.tables))
    except Exception as error:  # noqa: BLE001  whatever fails, the gate refuses
        return Estimate(None, (), str(error)[:300])


def _used_columns(frame: DataFrame) -> set[str]:
    """Columns that scans read, from the physical plan's read schemas."""
    import re

    text = frame._jdf.queryExecution().executedPlan().toString()
    return {name for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text) for name in re.findall(r"(\w+):", schema)}


def footer_bytes(path: str, columns: frozenset[str]) -> int:
    """Compressed bytes of the columns in one file."""
    fs, place = pa.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    with fs.open_input_file(place) as source:
        meta = pq.ParquetFile(source).metadata
    return sum(c.total_compressed_size for g in range(meta.num_row_groups) for c in (meta.row_group(g).column(k) for k in range(meta.num_columns)) if c.path_in_schema.split(".")[0] in columns)


def cost_violations(approved: Approved, plan_hash: str, found: Estimate, limits: CostLimits) -> list[Violation]:
    plan = approved.plan
    out = [Violation("plan_hash_mismatch")] * (plan_hash != approved.plan_hash)
    if found.error is not None or found.scanned_bytes is None:
        out.append(Violation("estimate_failed", (found.error or "",)))
    elif found.scanned_bytes > limits.max_bytes:
        out.append(Violation("max_bytes_exceeded", (str(found.scanned_bytes), str(limits.max_bytes))))
    if found.error is None and set(found.tables) != {t.casefold() for t in plan.tables}:
        out.append(Violation("referenced_tables_mismatch", found.tables))
    if plan.limit is not None and not limits.limit_allowed:
        out.append(Violation("limit_is_not_cost_control"))
    filtered = {str(f.column).casefold() for f in plan.all_filters}
    tables = {t.casefold() for t in plan.tables}
    for required in approved.scope.required_columns:
        if required.partition(".")[0].casefold() in tables and required.casefold() not in filtered:
            out.append(Violation("partition_filter_required", (required,)))
    return out


def _signature(plan_hash: str, expiry: int, ceiling: int, secret: bytes) -> str:
    return hmac.new(secret, f"{plan_hash}.{expiry}.{ceiling}".encode(), hashlib.sha256).hexdigest()


def approve(approved: Approved, found: Estimate, limits: CostLimits, now: float | None = None) -> str:
    """v1.expiry.bytes.signature, or an error that names all violations."""
    if violations := cost_violations(approved, approved.plan_hash, found, limits):
        raise PlanError("cost_rejected", ", ".join(v.code for v in violations))
    expiry = int(time.time() if now is None else now) + limits.lifetime
    return f"v1.{expiry}.{limits.max_bytes}.{_signature(approved.plan_hash, expiry, limits.max_bytes, limits.secret)}"


def verify_token(token: str, plan_hash: str, limits: CostLimits, now: float | None = None) -> None:
    parts = token.split(".")
    if len(parts) != 4 or parts[0] != "v1" or not parts[1].isdigit() or not parts[2].isdigit():
        raise PlanError("malformed_token")
    expiry, ceiling = int(parts[1]), int(parts[2])
    if not hmac.compare_digest(parts[3], _signature(plan_hash, expiry, ceiling, limits.secret)):
        raise PlanError("token_signature")
    if ceiling > limits.max_bytes:
        raise PlanError("token_ceiling")
    if expiry < (time.time() if now is None else now):
        raise PlanError("token_expired")


def execute(frame: DataFrame, approved: Approved, token: str, limits: CostLimits, *, seconds: float = 30.0, label: str = "query") -> list[Row]:
    """Collect the approved aggregate within the time; its jobs carry a tag by which they are interrupted."""
    verify_token(token, approved.plan_hash, limits)
    spark, tag = frame.sparkSession, f"{label[:40]}-{approved.plan_hash[:16]}"
    timer = threading.Timer(seconds, spark.interruptTag, [tag])
    spark.addTag(tag)
    timer.start()
    try:
        return frame.collect()
    finally:
        timer.cancel()
        spark.removeTag(tag)
