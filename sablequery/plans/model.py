"""Typed aggregate query plans and the catalogue evidence they are checked against."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass

SAFETY = ("identifier", "sensitive", "safe_aggregate", "unknown")
OPERATORS = ("=", "!=", "<", "<=", ">", ">=", "BETWEEN")
FUNCTIONS = ("COUNT", "COUNT_DISTINCT", "SUM", "AVG", "MIN", "MAX")
GRAINS = ("DAY", "WEEK", "MONTH", "QUARTER", "YEAR")
PARAMETER_TYPES = ("STRING", "INT64", "FLOAT64", "BOOL", "DATE", "DATETIME", "TIMESTAMP")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
MOST_ROWS = 1000


class PlanError(ValueError):
    """A plan that cannot be built or compiled; ``code`` says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def _check(ok: bool, code: str, detail: str = "") -> None:
    if not ok:
        raise PlanError(code, detail)


@dataclass(frozen=True)
class ColumnEvidence:
    name: str
    data_type: str | None = None
    safety: str = "unknown"

    def __post_init__(self) -> None:
        _check(self.safety in SAFETY, "invalid_safety", self.safety)

    @property
    def base_type(self) -> str:
        return (self.data_type or "").upper().partition("(")[0].strip()


@dataclass(frozen=True)
class TableEvidence:
    name: str
    columns: tuple[ColumnEvidence, ...] = ()

    def column(self, name: str) -> ColumnEvidence | None:
        return next((c for c in self.columns if c.name.casefold() == name.casefold()), None)


@dataclass(frozen=True)
class Catalogue:
    tables: tuple[TableEvidence, ...] = ()
    version: str = "unknown"

    def table(self, name: str) -> TableEvidence | None:
        return next((t for t in self.tables if t.name.lower() == name.lower()), None)

    def column(self, ref: Ref) -> ColumnEvidence | None:
        table = self.table(ref.table)
        return table.column(ref.column) if table else None


@dataclass(frozen=True)
class Ref:
    table: str
    column: str

    def __str__(self) -> str:
        return f"{self.table}.{self.column}"


@dataclass(frozen=True)
class Filter:
    column: Ref
    operator: str
    parameters: tuple[str, ...]

    def __post_init__(self) -> None:
        _check(self.operator in OPERATORS, "invalid_operator", self.operator)
        _check(len(self.parameters) == (2 if self.operator == "BETWEEN" else 1), "parameter_arity", self.operator)


@dataclass(frozen=True)
class Join:
    left: Ref
    right: Ref
    kind: str = "INNER"

    def __post_init__(self) -> None:
        _check(self.kind in ("INNER", "LEFT"), "invalid_join", self.kind)


@dataclass(frozen=True)
class Aggregate:
    function: str
    alias: str
    column: Ref | None = None

    def __post_init__(self) -> None:
        _check(self.function in FUNCTIONS, "invalid_function", self.function)
        _check(self.column is not None or self.function == "COUNT", "missing_column", self.function)
        _check(bool(NAME.fullmatch(self.alias)), "invalid_alias", self.alias)


@dataclass(frozen=True)
class Bucket:
    column: Ref
    grain: str
    alias: str

    def __post_init__(self) -> None:
        _check(self.grain in GRAINS, "invalid_grain", self.grain)
        _check(bool(NAME.fullmatch(self.alias)), "invalid_alias", self.alias)


@dataclass(frozen=True)
class Order:
    alias: str
    direction: str = "DESC"

    def __post_init__(self) -> None:
        _check(self.direction in ("ASC", "DESC"), "invalid_direction", self.direction)


@dataclass(frozen=True)
class Parameter:
    name: str
    type: str
    value: object

    def __post_init__(self) -> None:
        _check(bool(NAME.fullmatch(self.name)), "invalid_parameter", self.name)
        _check(self.type in PARAMETER_TYPES, "invalid_parameter_type", self.type)


@dataclass(frozen=True)
class QueryPlan:
    objective: str
    tables: tuple[str, ...]
    aggregates: tuple[Aggregate, ...]
    columns: tuple[Ref, ...] = ()
    filters: tuple[Filter, ...] = ()
    time_filters: tuple[Filter, ...] = ()
    joins: tuple[Join, ...] = ()
    groups: tuple[Ref, ...] = ()
    buckets: tuple[Bucket, ...] = ()
    order: Order | None = None
    limit: int | None = None
    outputs: tuple[str, ...] = ()
    parameters: tuple[Parameter, ...] = ()
    citations: tuple[str, ...] = ()
    row_level: bool = False

    def __post_init__(self) -> None:
        _check(1 <= len(self.tables) <= 4, "table_count")
        _check(len(self.joins) <= 3, "join_count")
        _check(len(self.aggregates) >= 1, "aggregate_count")
        _check(len(self.buckets) <= 2, "bucket_count")
        _check(self.limit is None or 1 <= self.limit <= MOST_ROWS, "limit_range")

    @property
    def all_filters(self) -> tuple[Filter, ...]:
        return self.filters + self.time_filters

    @property
    def references(self) -> list[Ref]:
        found = [*self.columns, *self.groups, *(b.column for b in self.buckets), *(f.column for f in self.all_filters)]
        found += [end for j in self.joins for end in (j.left, j.right)]
        return found + [a.column for a in self.aggregates if a.column]

    @property
    def aliases(self) -> list[str]:
        return [a.alias for a in self.aggregates] + [b.alias for b in self.buckets]

    @property
    def output_names(self) -> list[str]:
        return [b.alias for b in self.buckets] + [g.column for g in self.groups] + [a.alias for a in self.aggregates]


@dataclass(frozen=True)
class Scope:
    catalogue: Catalogue
    max_tables: int = 4
    max_joins: int = 3
    aggregate_only: bool = True
    required_columns: tuple[str, ...] = ()


def digest(value: object) -> str:
    """SHA-256 of a dataclass as JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(asdict(value), sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
