"""Scalar text functions: column expressions where Spark has them, small Arrow-batched functions where it has not."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import IntegerType, StringType

#: Query words that never narrow a search.
STOPWORDS = frozenset(
    (
    "a", "about", "an", "and", "are", "at", "can", "could", "do", "does", "document", "documentation", "documents", "find", "for", "hold", "holds", "i", "info", "information",
    "is", "look", "looking", "mean", "means", "me", "of", "on", "or", "please", "represent", "represents", "say", "says", "show", "tell", "table", "tables", "the", "to", "use",
    "used", "what", "which", "would",
)
)
#: Short domain terms that are searched exactly.
SHORT_TERMS = frozenset({"dx", "ed", "er", "ip", "or", "rx"})
LEAST_TOKEN, PREVIEW = 3, 300
ZERO_WIDTH = "[​‌‍⁠﻿]"


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


#: For str.translate: ASCII letters to lower case, digits as they are, all other ASCII to spaces.
_PLAIN = "".join(c.lower() if c.isalnum() else " " for c in map(chr, range(128)))
_OTHERS = re.compile("[^a-z0-9]+")


def plain_words(text: str) -> str:
    """NFKC, lower case, other than a-z and 0-9 (zero-width characters too) to single spaces."""
    text = unicodedata.normalize("NFKC", text)
    return " ".join(text.translate(_PLAIN).split()) if text.isascii() else _OTHERS.sub(" ", text.lower()).strip()


#: Texts that are Python strings at once in a worker; all others of a batch stay in Arrow.
TEXTS_AT_ONCE = 100


@arrow_udf(StringType())
def _plain_words(text: pa.Array) -> pa.Array:
    parts = [text.slice(at, TEXTS_AT_ONCE) for at in range(0, len(text), TEXTS_AT_ONCE)]
    return pa.chunked_array([pa.array([None if t is None else plain_words(t) for t in part.to_pylist()], pa.string()) for part in parts], pa.string()).combine_chunks()


def normal_prompt(text: Column) -> Column:
    """:func:`plain_words` of a column; batches of texts in Python, where one table lookup replaces thousands of matches."""
    return _plain_words(text)


def compact_prompt(text: Column) -> Column:
    """Letters and digits only; zero-width characters do not separate."""
    return F.regexp_replace(F.lower(F.regexp_replace(nfkc(text), ZERO_WIDTH, "")), "[^a-z0-9]+", "")


def unleet(text: Column) -> Column:
    """Digits and signs that stand for letters."""
    return F.translate(text, "013457@$", "oieastas")


def holds_phrase(text: Column, phrase: str) -> Column:
    """Whole-word containment in normal text."""
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {phrase} ")


def spaced_pattern(term: str) -> str:
    """For normal text between two spaces: the term's letters with or without breaks, starting and ending with words."""
    return " " + " ?".join(c for c in term.lower() if c.isascii() and c.isalnum()) + " "


def any_of(terms: Sequence[str], broken: bool = False) -> str:
    """One pattern for all terms between two spaces, common beginnings once. With ``broken``, as in :func:`spaced_pattern`."""
    tree: dict = {}
    for term in terms:
        at = tree
        for sign in (c for c in term.lower() if not broken or (c.isascii() and c.isalnum())):
            at = at.setdefault(sign, {})
        at[" end"] = {}

    def written(at: dict, first: bool) -> str:
        parts = [" " if sign == " end" else (" ?" if broken and not first else "") + re.escape(sign) + written(below, False) for sign, below in at.items()]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return f" {written(tree, True)}"


def matches_term(normal: Column, plain: Column, term: str) -> Column:
    """In normal text, broken up or not, or as whole words in ``plain``, the normal text without digits for letters."""
    return F.concat(F.lit(" "), normal, F.lit(" ")).rlike(spaced_pattern(term)) | holds_phrase(plain, term)


def osa_distance(a: str, b: str) -> int:
    """Edits to turn a into b: insert, delete, replace, swap neighbours; no part is edited twice."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        before, last = last, now
    return last[-1]


@pandas_udf(IntegerType())
def osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def most_edits(term: Column) -> Column:
    n = F.length(term)
    return F.when(n <= 4, 0).when(n <= 7, 1).otherwise(2)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def identifier_slug(text: Column) -> Column:
    """Upper case, runs of other than letters and digits to one underscore; UNNAMED if nothing is left."""
    slug = F.upper(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(F.coalesce(slug, F.lit("")) == "", "UNNAMED").otherwise(slug)


def is_identifier(token: str) -> bool:
    return "_" in token or (any(c.isdigit() for c in token) and any(c.isalpha() for c in token))


def is_exact(token: str) -> bool:
    """Searched as it is; other tokens are searched as prefixes."""
    return is_identifier(token) or token.isdigit() or token in SHORT_TERMS


def query_token(raw: str) -> str | None:
    """The searchable form of a word, or None. Upper-case OR is a term, lower-case or is not."""
    token, kept = raw.casefold(), raw == "OR"
    if not kept and token in STOPWORDS:
        return None
    if len(token) < LEAST_TOKEN and not is_identifier(token) and token not in SHORT_TERMS:
        return None
    if token.isalpha() and len(token) > 4 and token[-1] == "s" and token[-2:] not in ("is", "ss", "us"):
        token = token[:-1]
    return None if token in STOPWORDS and not kept else token


def overlap_tokens(text: Column) -> Column:
    """Words of two or more letters or digits that narrow a search, with their singulars."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda w: (F.length(w) >= 2) & ~w.isin(*sorted(STOPWORDS)))
    plural = F.filter(words, lambda w: w.rlike("^[a-z]{4,}s$") & ~w.rlike("(is|ss|us)$"))
    return F.array_union(words, F.transform(plural, lambda w: F.substring(w, F.lit(1), F.length(w) - 1)))


#: What a question names a document by, and words in capitals that name none.
CAPITAL_NAME, NAME_OF_TABLE = r"\b[A-Z][A-Z0-9_]{2,}\b", r"\b([A-Za-z][A-Za-z0-9_]*)\s+table\b"
NO_NAMES = ("EHI", "ETL", "INI", "SQL")


def document_hint(question: Column) -> Column:
    """The longest name in capitals, those with an underscore first, or the word before "table"."""
    capitals = F.filter(F.regexp_extract_all(question, F.lit(CAPITAL_NAME), 0), lambda c: ~c.isin(*NO_NAMES))
    named = F.upper(F.regexp_extract(question, NAME_OF_TABLE, 1))
    every = F.when(named != "", F.array_append(capitals, named)).otherwise(capitals)
    ranked = F.transform(every, lambda c, i: F.struct(c.contains("_").alias("u"), F.length(c).alias("n"), (-i).alias("i"), c.alias("c")))
    return F.array_max(ranked)["c"]


#: Column names that restrict, and suffixes that release, in order of use.
IDENTIFIER_NAME = r"(^|_)(ID|MRN|CSN|EPI|ACCT|ACCOUNT)$"
SENSITIVE_NAME = r"(^|_)(SSN|DOB|BIRTH|NAME|FNAME|LNAME|ADDR|ADDRESS|PHONE|EMAIL|ZIP|POSTAL)($|_)"
SENSITIVE_PROSE = ("sensitive", "phi", "protected health", "do not expose", "identifiable", "restricted")
SAFE_SUFFIX = r"_(DATE|DATETIME|STATUS|TYPE|FLAG|CODE|COUNT|QTY|AMOUNT|YEAR|MONTH|DAY|DEPT|C|YN|DT|DTTM|TIME|AMT|CNT|TM|DAYS)$"
#: Type names looked for in prose, first found wins.
PROSE_TYPES = ("VARCHAR", "STRING", "INTEGER", "INT64", "DATE", "DATETIME", "TIMESTAMP", "FLOAT", "FLOAT64", "BOOLEAN", "BOOL", "NUMERIC")


def infer_safety(name: Column, prose: Column) -> Column:
    """Deny by default: prose can only restrict, only a name's suffix can release."""
    upper, text = F.upper(name), F.lower(F.coalesce(prose, F.lit("")))
    marked = F.lit(False)
    for marker in SENSITIVE_PROSE:
        marked = marked | text.contains(marker)
    return F.when(upper.rlike(IDENTIFIER_NAME), "identifier").when(upper.rlike(SENSITIVE_NAME) | marked, "sensitive").when(upper.rlike(SAFE_SUFFIX), "safe_aggregate").otherwise("unknown")


def infer_type(prose: Column, whole_words: bool = False) -> Column:
    """First type name found anywhere in the prose; with ``whole_words`` the longest one that stands alone."""
    if whole_words:
        found = F.regexp_extract(F.upper(prose), rf"\b({'|'.join(sorted(PROSE_TYPES, key=len, reverse=True))})\b", 1)
        return F.when(found != "", found)
    return F.coalesce(*[F.when(F.lower(prose).contains(t.lower()), F.lit(t)) for t in PROSE_TYPES])


def table_of_path(path: Column) -> Column:
    """Upper-case file stem; none for index, home and overview pages."""
    stem = F.upper(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1))
    return F.when(~stem.isin("INDEX", "HOME", "OVERVIEW") & (stem != ""), stem)


def column_of_heading(heading: Column) -> Column:
    """Last part of a heading path of two parts or more, upper-case."""
    parts = F.split(heading, ">")
    return F.when(F.size(parts) >= 2, F.upper(F.trim(F.element_at(parts, -1))))
