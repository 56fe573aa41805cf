"""Checks on SQL text with Spark's own parser: aggregate-only, read-only, approved tables and columns.

The text is parsed by the session, and its analyzer resolves it over empty tables of the catalogue: unknown and ambiguous
columns and ungrouped projections are its findings. This module only looks at the nodes of the parsed plan. The first
rule that fails gives the reason. Named parameters may be written @name or :name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .model import Catalogue

#: Functions that aggregate queries may call besides operators.
FUNCTIONS = frozenset(
    (
    "count", "sum", "avg", "min", "max", "count_if", "countif", "any_value", "median", "percentile", "stddev", "variance", "round", "abs", "coalesce", "nullif", "if",
    "greatest", "least", "lower", "upper", "trim", "length", "substring", "substr", "concat", "date", "trunc", "date_trunc", "year", "quarter", "month", "day", "dayofweek",
    "extract", "cast", "datediff", "date_add", "date_sub", "floor", "ceil",
)
)
AGGREGATES = frozenset(("count", "sum", "avg", "min", "max", "count_if", "countif", "any_value", "median", "percentile", "stddev", "variance"))
READ_NODES = frozenset(
    (
    "Project", "Aggregate", "Filter", "Join", "UnresolvedRelation", "SubqueryAlias", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "Union", "Intersect", "Except",
    "UnresolvedHaving", "UnresolvedWith", "WithCTE", "CTERelationDef", "OneRowRelation", "UnresolvedOrdinal",
)
)


@dataclass(frozen=True)
class SqlVerdict:
    reason: str | None

    @property
    def allowed(self) -> bool:
        return self.reason is None


def bind_markers(sql: str) -> str:
    """@name to :name outside quotes; @@name stays and is refused later."""
    parts = re.split(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`)", sql)
    return "".join(p if k % 2 else re.sub(r"(?<!@)@([A-Za-z_]\w*)", r":\1", p) for k, p in enumerate(parts))


def _seq(scala: object) -> list:
    return [scala.apply(k) for k in range(scala.size())]


def _name(node: object) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _nodes(plan: object) -> Iterator[object]:
    yield plan
    if _name(plan) == "UnresolvedWith":
        for pair in _seq(plan.cteRelations()):
            yield from _nodes(pair._2())
    for child in _seq(plan.children()):
        yield from _nodes(child)


def _expressions(node: object) -> Iterator[object]:
    for expression in _seq(node.expressions()):
        yield from _below(expression)


def _below(expression: object) -> Iterator[object]:
    yield expression
    for child in _seq(expression.children()):
        yield from _below(child)


def _function(expression: object) -> str:
    return ".".join(_seq(expression.nameParts())).lower()


def _subplans(expression: object) -> Iterator[object]:
    if hasattr(expression, "plan") and _name(expression) in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery"):
        yield expression.plan()


def _columns(expression: object) -> Iterator[str]:
    if _name(expression) == "UnresolvedAttribute":
        yield ".".join(_seq(expression.nameParts()))


def _outputs(plan: object) -> Iterator[object]:
    """The nodes that make output rows: one per branch of a set operation."""
    name = _name(plan)
    if name in ("Union", "Intersect", "Except"):
        for child in _seq(plan.children()):
            yield from _outputs(child)
    elif name == "UnresolvedWith":
        yield from _outputs(plan.child())
    elif name in ("Project", "Aggregate"):
        yield plan
    else:
        for child in _seq(plan.children()):
            yield from _outputs(child)


def _join_is_plain(join: object) -> bool:
    """Equalities of columns joined by AND, or USING."""
    kind = join.joinType()
    if _name(kind) == "UsingJoin":
        return True
    if _name(kind) == "NaturalJoin" or join.condition().isEmpty():
        return False
    waiting = [join.condition().get()]
    while waiting:
        part = waiting.pop()
        if _name(part) == "And":
            waiting += _seq(part.children())
        elif _name(part) != "EqualTo" or not all(_name(c) == "UnresolvedAttribute" for c in _seq(part.children())):
            return False
    return True


def validate_sql(spark: SparkSession, sql: str, catalogue: Catalogue, declared: list[str]) -> SqlVerdict:
    return SqlVerdict(next(_problems(spark, sql, catalogue, declared), None))


def _problems(spark: SparkSession, sql: str, catalogue: Catalogue, declared: list[str]) -> Iterator[str]:
    names = [d.casefold() for d in declared]
    if not names or len(set(names)) < len(names):
        yield "invalid_table_declaration"
        return
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";")
    if ";" in bare:
        yield "multiple_statement_sql"
        return
    if "@@" in bare:
        yield "unsafe_system_variable"
        return
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(bind_markers(sql.strip().rstrip(";")))
    except Py4JJavaError:
        yield "invalid_sql_syntax"
        return
    except Exception as error:  # the session turns parse errors into its own type
        if "PARSE" not in str(error) and "ParseException" not in type(error).__name__:
            raise
        yield "invalid_sql_syntax"
        return
    if re.search(r"(?i)\bwith\s+recursive\b", bare):
        yield "recursive_cte_not_allowed"
        return
    nodes = list(_nodes(plan))
    for node in list(nodes):
        for expression in _expressions(node):
            for sub in _subplans(expression):
                nodes += list(_nodes(sub))
    kinds = {_name(n) for n in nodes}
    if any("Command" in k or "Insert" in k or "Create" in k or "Drop" in k or "Merge" in k or "Update" in k or "Delete" in k or "Set" == k for k in kinds):
        yield "non_read_only_sql"
    if "UnresolvedTableValuedFunction" in kinds or "Generate" in kinds or "LateralJoin" in kinds:
        yield "unapproved_table_source"
    if unknown := kinds - READ_NODES - {"Join"}:
        yield f"unsafe_sql_operation:{sorted(unknown)[0]}"
    expressions = [e for n in nodes for e in _expressions(n)]
    if any(_name(e) in ("UnresolvedWindowExpression", "WindowExpression", "WindowSpecDefinition") for e in expressions):
        yield "window_function_not_allowed"
    functions = [e for e in expressions if _name(e) == "UnresolvedFunction"]
    if bad := [f for f in map(_function, functions) if f not in FUNCTIONS]:
        yield f"unsafe_sql_function:{bad[0]}"
    if any(_name(n) == "Join" and not _join_is_plain(n) for n in nodes):
        yield "unsafe_join"
    counted = {id(c) for f in functions if _function(f) == "count" for c in _seq(f.children())}
    stars = [e for n in nodes for top in _seq(n.expressions()) for e in _below(top) if _name(e) == "UnresolvedStar" and id(e) not in counted]
    if stars and not all(_function(f) == "count" for f in functions if any(_name(c) == "UnresolvedStar" for c in _seq(f.children()))) or any(_name(e) == "UnresolvedStar" for n in nodes for e in _seq(n.expressions())):
        yield "select_star_sql"
    ctes = {pair._1() for n in nodes if _name(n) == "UnresolvedWith" for pair in _seq(n.cteRelations())}
    tables = [".".join(_seq(n.multipartIdentifier())) for n in nodes if _name(n) == "UnresolvedRelation"]
    used = {t.casefold() for t in tables if t not in ctes}
    if not used:
        yield "missing_approved_table"
    if any("*" in t for t in used):
        yield "wildcard_table_scan"
    if any("." in t for t in used):
        yield "qualified_table_not_allowed"
    if any(catalogue.table(t) is None for t in used):
        yield "unknown_table"
    if used != set(names):
        yield "declared_tables_mismatch"
    columns = _Columns(catalogue, used, nodes, {e.name().casefold() for e in expressions if _name(e) == "Alias"})
    for n in nodes:
        in_join = _name(n) == "Join"
        if in_join and _name(n.joinType()) == "UsingJoin":
            yield from _using_problems(_seq(n.joinType().usingColumns()), columns)
        for top in _seq(n.expressions()):
            yield from _column_problems(top, columns, in_join, False)
    for output in _outputs(plan):
        own = [e for top in _seq(output.aggregateExpressions() if _name(output) == "Aggregate" else output.projectList()) for e in _below(top)]
        if not any(_name(e) == "UnresolvedFunction" and _function(e) in AGGREGATES for e in own):
            yield "aggregate_only_sql"
    empty = {t: spark.createDataFrame([], ", ".join(f"`{c.name}` {SPARK_TYPES.get(c.base_type, 'string')}" for c in catalogue.table(t).columns)) for t in used}
    try:
        markers = {m: None for m in re.findall(r"(?<!:):([A-Za-z_]\w*)", bind_markers(sql))}
        _with_views(spark, _runnable(sql), empty, markers)
    except AnalysisException as error:
        condition = error.getCondition() or ""
        yield next((reason for start, reason in ANALYSIS_REASONS.items() if condition.startswith(start)), "invalid_sql_syntax")


#: Spark types of the catalogue's types; others are strings.
SPARK_TYPES = {"INT64": "bigint", "INTEGER": "bigint", "FLOAT64": "double", "FLOAT": "double", "NUMERIC": "double", "BOOL": "boolean", "BOOLEAN": "boolean", "DATE": "date", "DATETIME": "timestamp", "TIMESTAMP": "timestamp"}
ANALYSIS_REASONS = {"MISSING_AGGREGATION": "ungrouped_projection", "MISSING_GROUP_BY": "ungrouped_projection", "AMBIGUOUS_REFERENCE": "unknown_or_ambiguous_column", "UNRESOLVED_COLUMN": "unknown_or_ambiguous_column"}
STRICTEST = ("sensitive", "unknown", "identifier", "safe_aggregate")


class _Columns:
    """Safety of column names: by table or alias where one is written, else the strictest of all tables that have it."""

    def __init__(self, catalogue: Catalogue, used: set[str], nodes: list[object], outputs: set[str]):
        self.tables = {t: {c.name.casefold(): c.safety for c in found.columns} for t in used if (found := catalogue.table(t))}
        self.outputs, self.scopes = outputs, {t: {t} for t in self.tables}
        for n in nodes:
            if _name(n) == "SubqueryAlias":
                child = n.child()
                named = ".".join(_seq(child.multipartIdentifier())).casefold() if _name(child) == "UnresolvedRelation" else None
                # one alias may be written in several places, and a derived table may show columns of any
                self.scopes.setdefault(n.identifier().name().casefold(), set()).update({named} if named in self.tables else self.tables)

    def labels(self, parts: list[str]) -> set[str]:
        *scope, column = [p.casefold() for p in parts]
        found = {self.tables[t][column] for t in (self.scopes.get(scope[-1], set()) if scope else self.tables) if column in self.tables[t]}
        return found or ({"safe_aggregate"} if column in self.outputs else set())

    def safety(self, parts: list[str]) -> str | None:
        labels = self.labels(parts)
        return next((label for label in STRICTEST if label in labels), None)


def _using_problems(names: list[str], columns: _Columns) -> Iterator[str]:
    """USING compares the column of both sides: identifiers only with identifiers, nothing that may not be read."""
    for name in names:
        column, labels = name.casefold(), columns.labels([name])
        if not labels:
            yield f"unknown_column:{column}"
        elif found := labels & {"sensitive", "unknown"}:
            yield f"{min(found)}_column:{column}"
        elif "identifier" in labels and len(labels) > 1:
            yield f"identifier_usage:{column}"


def _column_problems(expression: object, columns: _Columns, in_join: bool, in_count: bool) -> Iterator[str]:
    if _name(expression) == "UnresolvedAttribute":
        parts = _seq(expression.nameParts())
        column, found = parts[-1].casefold(), columns.safety(parts)
        if found is None:
            yield f"unknown_column:{column}"
        elif found in ("sensitive", "unknown"):
            yield f"{found}_column:{column}"
        elif found == "identifier" and not (in_join or in_count):
            yield f"identifier_usage:{column}"
        return
    if in_join and _name(expression) == "EqualTo":  # a key may only be compared with a key
        in_join = all(_name(c) == "UnresolvedAttribute" and columns.safety(_seq(c.nameParts())) == "identifier" for c in _seq(expression.children()))
    counts = in_count or (_name(expression) == "UnresolvedFunction" and _function(expression) == "count")
    for child in _seq(expression.children()):
        yield from _column_problems(child, columns, in_join, counts)


def _runnable(sql: str) -> str:
    return re.sub(r"(?i)\bcountif\b", "count_if", bind_markers(sql.strip().rstrip(";")))


def _with_views(spark: SparkSession, sql: str, tables: dict[str, DataFrame], parameters: dict[str, object]) -> DataFrame:
    """The text over ``tables`` as views; the session's own views of these names are there again afterwards."""
    before = {t: spark.table(t) for t in tables if spark.catalog.tableExists(t) and spark.catalog.getTable(t).isTemporary}
    try:
        for name, frame in tables.items():
            frame.createOrReplaceTempView(name)
        return spark.sql(sql, args=parameters)  # resolved here, so views are no longer needed
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
        for name, frame in before.items():
            frame.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sql: str, catalogue: Catalogue, tables: dict[str, DataFrame], parameters: dict[str, object] | None = None) -> DataFrame:
    """Validate, then run over the given tables with bound parameters."""
    verdict = validate_sql(spark, sql, catalogue, list(tables))
    if not verdict.allowed:
        raise ValueError(verdict.reason)
    return _with_views(spark, _runnable(sql), tables, parameters or {})
