"""Plan authorisation: structural rules, each yielding coded violations. All rules run; none raises."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from .model import Catalogue, ColumnEvidence, Filter, QueryPlan, Ref, Scope, digest

TEMPORAL = {"DATE", "DATETIME", "TIMESTAMP"}
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,255}")
#: Parameter type by evidenced column type.
PARAMETER_TYPE = {
    "STRING": "STRING", "VARCHAR": "STRING", "INT64": "INT64", "INTEGER": "INT64", "FLOAT64": "FLOAT64", "FLOAT": "FLOAT64",
    "BOOL": "BOOL", "BOOLEAN": "BOOL", "DATE": "DATE", "DATETIME": "DATETIME", "TIMESTAMP": "TIMESTAMP",
}


@dataclass(frozen=True)
class Violation:
    code: str
    evidence: tuple[str, ...] = ()


@dataclass(frozen=True)
class Approved:
    plan: QueryPlan
    scope: Scope
    plan_hash: str
    scope_hash: str


@dataclass(frozen=True)
class Verdict:
    violations: tuple[Violation, ...]
    approved: Approved | None

    @property
    def codes(self) -> list[str]:
        return [v.code for v in self.violations]


def plain_objective(text: str) -> str:
    """Without a leading request to write SQL, punctuation and case."""
    bare = re.sub(r"^\s*(?:please\s+)?(?:write|generate|create)\s+(?:an?\s+)?(?:sql|query|sql\s+query)\s+(?:to|for|that)\s+", "", text, flags=re.I)
    return " ".join(re.findall(r"\w+", bare.casefold()))


@dataclass(frozen=True)
class _Request:
    plan: QueryPlan
    scope: Scope
    question: str
    citations: frozenset[str]

    @property
    def catalogue(self) -> Catalogue:
        return self.scope.catalogue

    def known(self, ref: Ref | None) -> ColumnEvidence | None:
        return self.catalogue.column(ref) if ref else None

    def filters(self) -> Iterator[tuple[Filter, ColumnEvidence]]:
        for f in self.plan.all_filters:
            if column := self.known(f.column):
                yield f, column


def _names(r: _Request) -> Iterator[Violation]:
    if plain_objective(r.plan.objective) != plain_objective(r.question):
        yield Violation("objective_mismatch", (r.plan.objective, r.question))
    names = {*r.plan.tables, *(x.table for x in r.plan.references), *(x.column for x in r.plan.references)}
    if bad := sorted(n for n in names if not IDENTIFIER.fullmatch(n)):
        yield Violation("malformed_identifier", tuple(bad))
    restricted = {c.name.casefold() for t in r.catalogue.tables for c in t.columns if c.safety != "safe_aggregate"}
    if shadows := sorted(a for a in r.plan.aliases if a.casefold() in restricted):
        yield Violation("alias_shadows_restricted_column", tuple(shadows))
    if len({a.casefold() for a in r.plan.aliases}) < len(r.plan.aliases):
        yield Violation("duplicate_output_alias")


def _extent(r: _Request) -> Iterator[Violation]:
    declared = {t.casefold() for t in r.plan.tables}
    if len(declared) > r.scope.max_tables:
        yield Violation("too_many_tables")
    if unknown := sorted(t for t in declared if r.catalogue.table(t) is None):
        yield Violation("table_out_of_scope", tuple(unknown))
    if len(r.plan.joins) > r.scope.max_joins:
        yield Violation("too_many_joins")
    if r.scope.aggregate_only and r.plan.row_level:
        yield Violation("row_level_not_allowed")
    for ref in r.plan.references:
        if ref.table.casefold() not in declared:
            yield Violation("undeclared_plan_table", (ref.table,))
        if r.known(ref) is None:
            yield Violation("column_out_of_scope", (str(ref),))


def _uses(r: _Request) -> Iterator[Violation]:
    for ref in (*r.plan.columns, *r.plan.groups):
        if (column := r.known(ref)) and column.safety != "safe_aggregate":
            yield Violation("unsafe_projection", (str(ref),))
    for bucket in r.plan.buckets:
        if column := r.known(bucket.column):
            if column.safety != "safe_aggregate":
                yield Violation("time_bucket_unsafe_column", (str(bucket.column),))
            if column.base_type not in TEMPORAL:
                yield Violation("time_bucket_not_temporal", (str(bucket.column),))
    for item in r.plan.aggregates:
        if column := r.known(item.column):
            if column.safety in ("sensitive", "unknown"):
                yield Violation("unsafe_aggregation", (str(item.column),))
            if column.safety == "identifier" and not item.function.startswith("COUNT"):
                yield Violation("identifier_usage", (str(item.column),))
    for f, column in r.filters():
        if column.safety != "safe_aggregate":
            yield Violation("unsafe_filter", (str(f.column),))
    for join in r.plan.joins:
        ends = [r.known(join.left), r.known(join.right)]
        if all(ends) and any(c.safety != "identifier" for c in ends if c):
            yield Violation("unsafe_join", (str(join.left), str(join.right)))


def _parameters(r: _Request) -> Iterator[Violation]:
    declared = [p.name.casefold() for p in r.plan.parameters]
    used = {name.casefold() for f in r.plan.all_filters for name in f.parameters}
    if len(set(declared)) < len(declared):
        yield Violation("duplicate_parameter")
    if missing := sorted(used - set(declared)):
        yield Violation("undeclared_parameter", tuple(missing))
    if idle := sorted(set(declared) - used):
        yield Violation("unused_parameter", tuple(idle))
    given = {p.name.casefold(): p for p in r.plan.parameters}
    for f, column in r.filters():
        wanted = PARAMETER_TYPE.get(column.base_type)
        for name in f.parameters:
            found = given.get(name.casefold())
            if wanted and found and found.type != wanted:
                yield Violation("parameter_type_mismatch", (found.name, wanted, found.type))


def _outputs(r: _Request) -> Iterator[Violation]:
    names = {n.casefold() for n in r.plan.output_names}
    if r.plan.order and r.plan.order.alias.casefold() not in names:
        yield Violation("order_by_unknown_alias", (r.plan.order.alias,))
    if absent := sorted(set(r.plan.citations) - r.citations):
        yield Violation("citation_out_of_scope", tuple(absent))
    if {o.casefold() for o in r.plan.outputs} != names:
        yield Violation("output_shape_mismatch", tuple(sorted(names)))
    grouped = [g.column.casefold() for g in r.plan.groups]
    if len(set(grouped)) < len(grouped):  # stricter than needed for SQL text: two output columns of one name
        yield Violation("duplicate_output_name")


RULES: tuple[Callable[[_Request], Iterator[Violation]], ...] = (_names, _extent, _uses, _parameters, _outputs)


def authorize(question: str, plan: QueryPlan, scope: Scope, citations: frozenset[str] = frozenset()) -> Verdict:
    request = _Request(plan, scope, question, citations)
    violations = tuple(v for rule in RULES for v in rule(request))
    approved = None if violations else Approved(plan, scope, digest(plan), digest(scope))
    return Verdict(violations, approved)


#: What to change, by code; {0} is the first piece of evidence.
GUIDANCE = {
    "objective_mismatch": "Keep the objective equal to the question.",
    "malformed_identifier": "Use plain names; {0} is not one.",
    "alias_shadows_restricted_column": "Rename the output {0}; a restricted column has that name.",
    "too_many_tables": "Use fewer tables.",
    "table_out_of_scope": "Use only documented tables; {0} is not one.",
    "too_many_joins": "Use fewer joins.",
    "row_level_not_allowed": "Ask for aggregates instead of rows.",
    "undeclared_plan_table": "Declare table {0}.",
    "column_out_of_scope": "Use only documented columns; {0} is not one.",
    "unsafe_projection": "Do not select or group by {0}.",
    "time_bucket_unsafe_column": "Do not bucket {0}.",
    "time_bucket_not_temporal": "Bucket a date or time column; {0} is not one.",
    "duplicate_output_alias": "Give each output its own name.",
    "duplicate_output_name": "Group by columns of different names.",
    "order_by_unknown_alias": "Order by an output; {0} is not one.",
    "unsafe_aggregation": "Do not aggregate {0}.",
    "identifier_usage": "Only count {0}.",
    "unsafe_filter": "Do not filter on {0}.",
    "duplicate_parameter": "Give each parameter its own name.",
    "undeclared_parameter": "Declare parameter {0}.",
    "unused_parameter": "Drop parameter {0}.",
    "parameter_type_mismatch": "Give parameter {0} the type {1}.",
    "unsafe_join": "Join on identifiers; {0} = {1} is not such a join.",
    "citation_out_of_scope": "Cite only what was retrieved; {0} was not.",
    "output_shape_mismatch": "Declare exactly the outputs the plan makes.",
}


def guidance(violations: tuple[Violation, ...]) -> list[str]:
    """One sentence per distinct violation, in order."""
    return list(dict.fromkeys(GUIDANCE[v.code].format(*v.evidence) for v in violations))
