"""Answer texts: citations, follow-up questions, suggestions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BRACKETS = r"\[([^\[\]]+)\]"
#: Forms that point back to a table or column, catalogue names, and offers in an answer.
THIS_TABLE, THIS_COLUMN = r"(?i)\b(?:this|that|the)\s+table\b", r"(?i)\b(?:this|that|the)\s+column\b"
CATALOGUE_NAME = r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b"
SUGGESTION = r"(?m)^Suggested query:\s*(.+?)\s*$"
LONGEST_SUGGESTION, MOST_TABLES = 300, 5


def _ids(bracket: Column) -> Column:
    return F.transform(F.split(bracket, ","), lambda x: F.trim(x))


def cited(answer: Column, available: Column) -> Column:
    """Available ids named in brackets, in order, each once."""
    named = F.flatten(F.transform(F.regexp_extract_all(answer, F.lit(BRACKETS), 1), _ids))
    return F.array_distinct(F.filter(named, lambda x: F.array_contains(available, x)))


def without_citations(answer: Column, available: Column) -> Column:
    """The answer without brackets that hold only available ids, with the spaces they leave tidied."""
    whole = F.filter(F.regexp_extract_all(answer, F.lit(BRACKETS), 1), lambda b: F.forall(_ids(b), lambda x: F.array_contains(available, x)))
    bare = F.aggregate(whole, answer, lambda text, b: F.call_function("replace", text, F.concat(F.lit("["), b, F.lit("]")), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r" +([.,;:])", "$1"), " {2,}", " "))


def numbered_citations(answer: Column, ids: Column) -> Column:
    """[id] to [n], n being the id's place in ``ids``."""
    places = F.transform(ids, lambda x, i: F.struct(x.alias("id"), (i + 1).cast("string").alias("n")))
    return F.aggregate(places, answer, lambda text, p: F.call_function("replace", text, F.concat(F.lit("["), p["id"], F.lit("]")), F.concat(F.lit("["), p["n"], F.lit("]"))))


def catalogue_names(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CATALOGUE_NAME), 0))


def suggestion(answer: Column) -> Column:
    """The last offered query, cut to a bounded length; null if there is none."""
    offers = F.regexp_extract_all(answer, F.lit(SUGGESTION), 1)
    return F.when(F.size(offers) > 0, F.substring(F.element_at(offers, -1), 1, LONGEST_SUGGESTION))


def resolve_followup(question: Column, tables: Column, columns: Column, offered: Column, acceptance: list[str]) -> Column:
    """An acceptance becomes the offered question; "this table" becomes the one table of the last turn, if it is one."""
    plain = F.rtrim(F.lower(F.trim(F.regexp_replace(question, r"\s+", " "))), F.lit(".!?"))
    with_table = F.when(F.size(tables) == 1, F.regexp_replace(question, F.lit(THIS_TABLE), F.concat(F.lit("the "), F.element_at(tables, 1), F.lit(" table")))).otherwise(question)
    with_column = F.when(F.size(columns) == 1, F.regexp_replace(with_table, F.lit(THIS_COLUMN), F.concat(F.lit("the "), F.element_at(columns, 1), F.lit(" column")))).otherwise(with_table)
    return F.when(plain.isin(*acceptance) & (F.coalesce(offered, F.lit("")) != ""), offered).otherwise(with_column)
