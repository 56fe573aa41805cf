"""Catalogue evidence for the star-schema tables, and the same labels as Spark column metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import Catalogue, ColumnEvidence, TableEvidence

#: table: column, type, safety.
STAR = {
    "region": [("r_regionkey", "INT64", "identifier"), ("r_name", "STRING", "safe_aggregate")],
    "nation": [("n_nationkey", "INT64", "identifier"), ("n_regionkey", "INT64", "identifier"), ("n_name", "STRING", "safe_aggregate")],
    "customer": [("c_custkey", "INT64", "identifier"), ("c_nationkey", "INT64", "identifier"), ("c_name", "STRING", "sensitive"), ("c_acctbal", "FLOAT64", "safe_aggregate"), ("c_mktsegment", "STRING", "safe_aggregate")],
    "supplier": [("s_suppkey", "INT64", "identifier"), ("s_nationkey", "INT64", "identifier"), ("s_name", "STRING", "sensitive"), ("s_acctbal", "FLOAT64", "safe_aggregate")],
    "part": [("p_partkey", "INT64", "identifier"), ("p_name", "STRING", "safe_aggregate"), ("p_brand", "STRING", "safe_aggregate"), ("p_type", "STRING", "safe_aggregate"), ("p_size", "INT64", "safe_aggregate"), ("p_retailprice", "FLOAT64", "safe_aggregate")],
    "orders": [("o_orderkey", "INT64", "identifier"), ("o_custkey", "INT64", "identifier"), ("o_orderstatus", "STRING", "safe_aggregate"), ("o_totalprice", "FLOAT64", "safe_aggregate"), ("o_orderdate", "DATETIME", "safe_aggregate"), ("o_orderpriority", "STRING", "safe_aggregate")],
    "lineitem": [("l_orderkey", "INT64", "identifier"), ("l_partkey", "INT64", "identifier"), ("l_suppkey", "INT64", "identifier"), ("l_linenumber", "INT64", "safe_aggregate"), ("l_quantity", "FLOAT64", "safe_aggregate"), ("l_extendedprice", "FLOAT64", "safe_aggregate"), ("l_discount", "FLOAT64", "safe_aggregate"), ("l_tax", "FLOAT64", "safe_aggregate"), ("l_returnflag", "STRING", "safe_aggregate"), ("l_linestatus", "STRING", "safe_aggregate"), ("l_shipdate", "DATETIME", "safe_aggregate")],
    "events": [("event_id", "INT64", "identifier"), ("user_id", "INT64", "identifier"), ("ts", "DATETIME", "safe_aggregate"), ("event_type", "STRING", "safe_aggregate"), ("value", "FLOAT64", "safe_aggregate"), ("props", None, "unknown")],
}


def star_catalogue() -> Catalogue:
    return Catalogue(tuple(TableEvidence(t, tuple(ColumnEvidence(*c) for c in columns)) for t, columns in STAR.items()), "star-1")


def with_safety(frame: DataFrame, table: TableEvidence) -> DataFrame:
    """The safety label of each known column as its metadata."""
    known = {c.name.lower(): c for c in table.columns}
    return frame.select(*[F.col(n).alias(n, metadata={"safety": known[n.lower()].safety}) if n.lower() in known else F.col(n).alias(n, metadata={"safety": "unknown"}) for n in frame.columns])
