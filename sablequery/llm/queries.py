"""The registered queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrow_ids, centroids, curve_packing, hmm_lm, line_dedup, mixing, ogg, piece_counts, shared_search, simhash, toxicity_mil, virtual_slots, winnowing
from .common import read_table


def op1_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_mil.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_documents(read_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_arrow_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return arrow_ids.encode_and_read_back(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(read_table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 9) for c in ("weight", "epochs")}).withColumn("places", F.array_join("places", ","))


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_features(ogg.store_media(read_table(spark, sf_dir, "documents")))


def op8_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.count_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual_slots.shard_documents(read_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return found.withColumn("removed_lines", F.array_join("removed_lines", ","))


def op11_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op12_shared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_search.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_va_file_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_toxicity_mil, op2_hmm_language_model, op3_simhash, op4_winnowing, op5_arrow_token_ids, op6_temperature_mixing, op7_ogg_media, op8_piece_counts,
        op9_virtual_slot_sharding, op10_line_dedup, op11_curve_packing, op12_shared_search, op13_va_file_centroids,
    ]
    return {f.__name__: f for f in found}


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, w[i:i + n - 1] AS win, n FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""

MIXING = r"""
WITH RECURSIVE k AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':17') AS m FROM documents),
s AS (SELECT source, sum(n_tokens)::DOUBLE AS t FROM k GROUP BY 1), sh AS (SELECT source, t, t / (SELECT sum(t) FROM s) AS p FROM s),
bis AS (SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high UNION ALL
 SELECT step + 1, CASE WHEN e > 2.0 THEN (low + high) / 2 ELSE low END, CASE WHEN e > 2.0 THEN high ELSE (low + high) / 2 END
 FROM (SELECT step, low, high, (SELECT max(pow(p, (low + high) / 2) / p) / min(pow(p, (low + high) / 2) / p) FROM sh) AS e FROM bis WHERE step < 30)),
a AS (SELECT (low + high) / 2 AS a FROM bis WHERE step = 30), r AS (SELECT source, t, pow(p, a) AS r FROM sh, a), z AS (SELECT sum(r) AS z, max(t / r) AS most FROM r),
w AS (SELECT source, t, r / z AS weight, round(r / z * (z * most), 6) AS quota FROM r, z),
e AS (SELECT *, quota / t AS epochs, CAST(floor(quota / t + 1e-9) AS INTEGER) AS whole, greatest(1, least(65536, CAST(ceil(t / 262144) AS BIGINT))) AS blocks FROM w),
n AS (SELECT k.doc_id, k.source, k.n_tokens, e.*  EXCLUDE (source), ('0x' || m[1:13])::BIGINT % blocks AS block, m[14:] AS draw FROM k JOIN e USING (source)),
bl AS (SELECT source, block, any_value(whole) AS wh, sum(n_tokens) AS bt, any_value(quota - whole * t) AS l FROM n GROUP BY ALL),
bb AS (SELECT *, coalesce(sum(bt) OVER (PARTITION BY source ORDER BY md5(concat_ws(':', coalesce(source, chr(0)), block, wh, 18)), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bl),
q AS (SELECT n.*, before, bt, l, sum(n_tokens) OVER (PARTITION BY n.source, n.block ORDER BY draw, doc_id) AS upto FROM n JOIN bb USING (source, block)),
c AS (SELECT *, whole + CASE WHEN l <= before THEN 0 WHEN before + bt <= l THEN 1 WHEN before + upto <= l THEN 1 ELSE 0 END AS copies FROM q)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, round(epochs, 9) AS epochs, block, copies,
 array_to_string(list_transform(range(0, copies), lambda e: CAST(floor((e + ('0x' || md5(concat_ws(':', coalesce(source, chr(0)), block, e, 18))[1:13])::BIGINT / pow(2.0, 52)) / greatest(epochs, copies::DOUBLE) * 1000000) AS BIGINT)), ',') AS places FROM c"""

LINES = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents),
s AS (SELECT doc_id, k, line, list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM l),
t AS (SELECT doc_id, k, len(w) AS n, unnest(w) AS x FROM s WHERE len(w) > 0), f AS (SELECT x, count(*) AS c FROM t GROUP BY 1),
p AS (SELECT doc_id, k, n, x FROM (SELECT t.*, row_number() OVER (PARTITION BY doc_id, k ORDER BY c, t.x) AS place FROM t JOIN f USING (x)) WHERE place <= n - ceil(0.8 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.doc_id, a.k, b.doc_id AS e, b.k AS ek FROM p a JOIN p b ON a.x = b.x AND (b.doc_id, b.k) < (a.doc_id, a.k) AND least(a.n, b.n) >= greatest(a.n, b.n) * 0.8 - 1e-9),
g AS (SELECT DISTINCT c.doc_id, c.k FROM c JOIN s x ON x.doc_id = c.doc_id AND x.k = c.k JOIN s y ON y.doc_id = e AND y.k = ek
 WHERE len(list_intersect(x.w, y.w)) >= (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) * 0.8 - 1e-9)
SELECT doc_id, count(*) AS n_lines, count(g.k) AS n_removed, coalesce(string_agg(CAST(g.k AS VARCHAR), ',' ORDER BY l.k), '') AS removed_lines,
 sha256(coalesce(string_agg(CASE WHEN g.k IS NULL THEN line END, chr(10) ORDER BY l.k), '')) AS kept_sha256
FROM l LEFT JOIN g USING (doc_id, k) GROUP BY doc_id"""


SEARCH = r"""
WITH t AS (SELECT rid, doc_id, term, count(*) AS tf FROM (SELECT row_number() OVER () AS rid, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM documents),
 LATERAL (SELECT translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term) GROUP BY ALL),
d AS (SELECT rid, sum(tf)::BIGINT AS n FROM t GROUP BY 1), s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM d), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
q AS (SELECT DISTINCT item_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM benchmark WHERE item_id IS NOT NULL)),
p AS (SELECT rid, doc_id, term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)::DOUBLE)) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))) AS part FROM t JOIN d USING (rid) JOIN f USING (term), s WHERE term IN (SELECT term FROM q)),
r AS (SELECT item_id, doc_id, rid, sum(part)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, rid) AS INTEGER) AS rank, doc_id, score FROM r QUALIFY rank <= 10"""


def clustering_sql(k: int = centroids.CENTROIDS, rounds: int = centroids.ROUNDS) -> str:
    """Every round as two relations: nearest centroids, then means rounded down."""
    parts = [
        """x AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS m FROM x QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (SELECT * FROM (SELECT rid, vec_id, v, c, CAST(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance FROM x, c{r})
 QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, c) = 1)""")
        if r < rounds:
            parts.append(f"""u{r} AS (SELECT c, list(mean ORDER BY i) AS m FROM (SELECT c, i, CAST(floor(sum(e) / count(*)::DOUBLE) AS BIGINT) AS mean FROM (SELECT c, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c),
c{r + 1} AS (SELECT c, coalesce(u{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN u{r} USING (c))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""


def oracle_sql() -> dict[str, str]:
    """The other queries learn models, use XXH64 or read files back: no SQL form; tests compare them with brute force."""
    return {"op4_winnowing": CONTAMINATION, "op6_temperature_mixing": MIXING, "op10_line_dedup": LINES, "op12_shared_search": SEARCH, "op13_va_file_centroids": clustering_sql()}
