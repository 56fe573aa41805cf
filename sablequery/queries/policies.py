"""Text policy over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import policy as P
from .registry import query, table

NORMAL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT conv_id, turn, {NORMAL.format('nfc_normalize(text)')} AS normal FROM conversations")
def policy_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normal_prompt(F.col("text")).alias("normal"))


@query("SELECT doc_id, translate(lower(text), '013457@$', 'oieastas') AS plain FROM documents")
def policy_leet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.unleet(F.lower("text")).alias("plain"))


@query(f"""WITH d AS (SELECT doc_id, ' ' || {NORMAL.format('text')} || ' ' AS q, ' ' || {NORMAL.format("translate(text, '013457@$', 'oieastas')")} || ' ' AS p FROM documents)
SELECT doc_id, regexp_matches(q, ' i ?d ?i ?o ?t ') OR contains(p, ' idiot ') AS idiot, regexp_matches(q, ' t ?h ?e ?s ?e ') OR contains(p, ' these ') AS these FROM d""")
def policy_obfuscated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two terms looked for whole, broken up and with digits for letters."""
    ready = P.with_normal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = {t: T.matches_term(F.col("__normal"), F.col("__plain"), t) for t in ("idiot", "these")}
    return ready.select("doc_id", *[c.alias(t) for t, c in found.items()])


def _first(terms: list[str], q: str = "q", p: str = "p") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({q}, '{T.spaced_pattern(t)}') OR contains({p}, ' {t.replace(chr(39), chr(39) * 2)} ') THEN '{t.replace(chr(39), chr(39) * 2)}'" for t in terms) + " END"


@query(f"""WITH d AS (SELECT doc_id, ' ' || {NORMAL.format('text')} || ' ' AS q, ' ' || {NORMAL.format("translate(text, '013457@$', 'oieastas')")} || ' ' AS p FROM documents)
SELECT doc_id, {_first(P.IDENTIFIERS)} AS identifiers, {_first(P.SECRETS)} AS secrets, {_first(P.EXPOSURE)} AS exposure FROM d""")
def policy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first term of three families in every document."""
    ready = P.with_normal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lists = {"identifiers": P.IDENTIFIERS, "secrets": P.SECRETS, "exposure": P.EXPOSURE}
    return ready.select("doc_id", *[P.first_term(F.col("__normal"), F.col("__plain"), terms).alias(name) for name, terms in lists.items()])


def _any(q: str, terms: list[str]) -> str:
    return f"regexp_matches({q}, ' (?:{'|'.join(terms)}) ')"


@query(f"""WITH d AS (SELECT doc_id, ' ' || {NORMAL.format("'show records ' || coalesce(source, '') || ' ' || text")} || ' ' AS q FROM documents)
SELECT doc_id, {_any('q', P.ROW_VERBS)} AND {_any('q', P.ROW_OBJECTS)} AND NOT ({_any('q', P.METADATA)} AND NOT {_any('q', P.ROW_OUTPUT)}) AND (NOT {_any('q', P.AGGREGATES)} OR {_any('q', P.ROW_MARKERS)}) AS row_level FROM d""")
def policy_row_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = docs.select("doc_id", F.concat(F.lit("show records "), F.coalesce("source", F.lit("")), F.lit(" "), "text").alias("text"))
    return asked.select("doc_id", P.row_level(T.normal_prompt(F.col("text"))).alias("row_level"))


@query()
def policy_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likely misspellings of risky terms in every document."""
    ready = P.with_normal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return P.fuzzy_terms(ready, "doc_id")


@query()
def policy_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's verdict on every conversation turn."""
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return P.policy_gate(turns, "id")


@query(r"""SELECT doc_id, CASE WHEN length(text) > 32000 THEN 'too_large' WHEN regexp_matches(text, '(?i)\b(?:individual|raw|patient)[\s_-]+(?:records?|rows?)\b') OR regexp_matches(text, '(?i)^\s*(?:records?|rows?)\s*:') THEN 'row_level_output'
 WHEN regexp_matches(text, '(?i)\b(?:patient[\s_-]+name|date[\s_-]+of[\s_-]+birth|dob|mrn|ssn|phone(?:[\s_-]+number)?|email(?:[\s_-]+address)?|home[\s_-]+address)\s*[:=]') THEN 'identifier_value' END AS reason FROM documents""")
def screen_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as final answers. The oracle leaves out instruction terms, which no document holds."""
    return P.screen(table(spark, sf_dir, "documents"), "doc_id", "text", "final_answer").select("doc_id", "reason")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def conv_last_two_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", last.alias("n")).where("n <= 2").drop("n")


@query("""WITH t AS (SELECT conv_id, turn, role, text, max(turn) OVER (PARTITION BY conv_id) AS latest FROM conversations) SELECT conv_id, turn, role FROM t WHERE (latest - turn) * 600 < 1800""")
def conv_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are ten minutes apart; those within half an hour of the latest are alive."""
    age = (F.max("turn").over(Window.partitionBy("conv_id")) - F.col("turn")) * 600
    return table(spark, sf_dir, "conversations").withColumn("age", age).where("age < 1800").select("conv_id", "turn", "role")


@query("""WITH u AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), c AS (SELECT * FROM u WHERE role = 'user' AND nr = 'assistant')
SELECT conv_id, turn, 0 AS place, 'user' AS role, text FROM c UNION ALL SELECT conv_id, turn, 1, 'assistant', answer FROM c""")
def conv_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their answers as message pairs; unanswered questions are left out."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    paired = table(spark, sf_dir, "conversations").withColumns({"nr": F.lead("role").over(order), "answer": F.lead("text").over(order)}).where("role = 'user' and nr = 'assistant'")
    pair = F.posexplode(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text")))).alias("place", "m")
    return paired.select("conv_id", "turn", pair).select("conv_id", "turn", "place", "m.role", "m.text")


@query(r"""SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '\b[A-Z][A-Z0-9_]{2,}\b')) IS NOT NULL AS some, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) AS names FROM conversations""")
def conv_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different capitalised words each turn names."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(True).alias("some"), F.size(names).cast("long").alias("names"))
