"""Checks on a result's schema before anyone sees rows. Nothing here scans data."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .model import Catalogue, PlanError, QueryPlan


def _allowed(plan: QueryPlan) -> set[str]:
    """Names a result may hold. Time buckets count: their columns were authorised as safe."""
    return {n.casefold() for n in plan.output_names}


def verify_result(result: DataFrame, plan: QueryPlan, catalogue: Catalogue) -> DataFrame:
    """The result itself, or an error that names restricted or unmapped columns."""
    safety = {c.name.casefold(): c.safety for t in catalogue.tables for c in t.columns}
    declared = {t.casefold() for t in plan.tables}
    for t in catalogue.tables:  # the plan's own tables decide for names that several tables have
        if t.name.casefold() in declared:
            safety |= {c.name.casefold(): c.safety for c in t.columns}
    aliases = {a.casefold() for a in plan.aliases}
    for name in result.columns:
        key = name.casefold()
        if key in aliases:
            continue
        found = safety.get(key)
        if found in ("identifier", "sensitive"):
            raise PlanError("restricted_result_column", name)
        if found != "safe_aggregate":
            raise PlanError("unmapped_result_column", name)
    return result


def redact_result(result: DataFrame, plan: QueryPlan) -> DataFrame:
    """Only the outputs the plan declares."""
    allowed = _allowed(plan)
    return result.select(*[c for c in result.columns if c.casefold() in allowed])
