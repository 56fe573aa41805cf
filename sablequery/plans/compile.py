"""Approved plans to DataFrames. No SQL text: the plan becomes DataFrame operators and Catalyst does the rest.

The base is the first table. A join adds its right table, or its left one if the right is already there; the join kind
is kept as declared, so in that case the declared left side is the one that LEFT makes nullable. Filters apply after
all joins, as in WHERE.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .authorize import TEMPORAL, Approved
from .model import Aggregate, Bucket, Filter, Parameter, PlanError, Ref

SPARK_TYPE = {"STRING": "string", "INT64": "bigint", "FLOAT64": "double", "BOOL": "boolean", "DATE": "date", "DATETIME": "timestamp_ntz", "TIMESTAMP": "timestamp"}
COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__,
}
FUNCTION: dict[str, Callable[[Column], Column]] = {
    "COUNT": F.count, "COUNT_DISTINCT": F.count_distinct, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max,
}


def literal(parameter: Parameter) -> Column:
    value = parameter.value.isoformat() if isinstance(parameter.value, dt.date) else parameter.value
    return F.lit(value).cast(SPARK_TYPE[parameter.type])


def bucket_start(column: Column, grain: str, data_type: str, week_start: str = "SUNDAY") -> Column:
    """First instant of the calendar bucket, in the column's own type. Weeks begin on Sunday unless told otherwise."""
    if data_type not in TEMPORAL:
        raise PlanError("time_bucket_untruncatable_type", data_type)
    kind = {"DATE": "date", "DATETIME": "timestamp_ntz", "TIMESTAMP": "timestamp"}[data_type]
    if grain == "WEEK" and week_start == "SUNDAY":
        day = F.to_date(column)
        return F.date_sub(day, F.dayofweek(day) - 1).cast(kind)
    return F.date_trunc(grain.lower(), column).cast(kind)


class PlanCompiler:
    def __init__(self, approved: Approved, read: Callable[[str], DataFrame], week_start: str = "SUNDAY"):
        self.approved, self.plan, self.week_start = approved, approved.plan, week_start
        self.read = read
        self.given = {p.name.casefold(): p for p in self.plan.parameters}

    def column(self, ref: Ref) -> Column:
        return F.col(f"`{ref.table.casefold()}`.`{ref.column}`")

    def table(self, name: str) -> DataFrame:
        return self.read(name).alias(name.casefold())

    def joined(self) -> DataFrame:
        frame, present = self.table(self.plan.tables[0]), {self.plan.tables[0].casefold()}
        for join in self.plan.joins:
            ends = [join.right.table.casefold(), join.left.table.casefold()]
            added = next((t for t in ends if t not in present), None)
            if added is None:
                raise PlanError("ambiguous_join_order", f"{join.left} = {join.right}")
            if not present & set(ends):
                raise PlanError("join_without_base", f"{join.left} = {join.right}")
            frame = frame.join(self.table(added), self.column(join.left) == self.column(join.right), join.kind.lower())
            present.add(added)
        if present != {t.casefold() for t in self.plan.tables}:
            raise PlanError("disconnected_table")
        return frame

    def predicate(self, item: Filter) -> Column:
        values = [literal(self.given[name.casefold()]) for name in item.parameters]
        column = self.column(item.column)
        return column.between(*values) if item.operator == "BETWEEN" else COMPARE[item.operator](column, values[0])

    def bucket(self, item: Bucket) -> Column:
        evidence = self.approved.scope.catalogue.column(item.column)
        return bucket_start(self.column(item.column), item.grain, evidence.base_type if evidence else "", self.week_start).alias(item.alias)

    def aggregate(self, item: Aggregate) -> Column:
        return FUNCTION[item.function](self.column(item.column) if item.column else F.lit(1)).alias(item.alias)

    def frame(self) -> DataFrame:
        plan, rows = self.plan, self.joined()
        if plan.all_filters:
            rows = rows.where(reduce(Column.__and__, map(self.predicate, plan.all_filters)))
        keys = [self.bucket(b) for b in plan.buckets] + [self.column(g).alias(g.column) for g in plan.groups]
        made = [self.aggregate(a) for a in plan.aggregates]
        result = rows.groupBy(*keys).agg(*made) if keys else rows.agg(*made)
        if plan.order:
            result = result.orderBy(F.col(plan.order.alias).desc() if plan.order.direction == "DESC" else F.col(plan.order.alias).asc())
        return result.limit(plan.limit) if plan.limit is not None else result


def compile_plan(approved: Approved, read: Callable[[str], DataFrame], week_start: str = "SUNDAY") -> DataFrame:
    return PlanCompiler(approved, read, week_start).frame()


def parquet_reader(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{folder}/{name.lower()}.parquet")
