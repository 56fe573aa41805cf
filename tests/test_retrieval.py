"""Retrieval against SQLite's full-text index and loops."""

import math
import random
import sqlite3
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sablequery.functions import text as T
from sablequery.operators import retrieval as R

ROWS = [
    ("c1", "enc/PAT_ENC.html", "PAT_ENC - Encounters", "table_data", "PAT_ENC > Columns", "The patient encounter records visits café and status codes", "who visited"),
    ("c2", "ORDERS.html", "ORDERS - Orders", "metadata", "ORDERS", "Orders placed during a patient encounter; pat enc id links them", ""),
    ("c3", "ORDERS.html", "ORDERS - Orders", "column_info", "ORDERS > STATUS_C", "Status of the order, a category code. Status status.", "what is the status"),
    ("c4", "MISC.html", "MISC", "document", "MISC", "Nothing of note here, only visitors and cafes", None),
]
NAMES = ["chunk_id", "source_path", "title", "category", "heading_path", "text", "generated_queries"]


def frames(spark):
    return spark.createDataFrame(ROWS, ", ".join(f"{n} string" for n in NAMES))


def test_bm25_equals_sqlite(spark):
    db = sqlite3.connect(":memory:")
    db.execute(f"create virtual table f using fts5({', '.join(NAMES)})")
    db.executemany(f"insert into f values ({','.join('?' * 7)})", [[x or "" for x in r] for r in ROWS])
    posted = R.postings(frames(spark))
    fields = R.indexed_fields(frames(spark))
    sizes, vocab = R.field_sizes(fields), R.field_vocabulary(fields)
    assert sorted(sizes.collect()) == sorted(R.chunk_sizes(posted).collect()) and sorted(vocab.collect()) == sorted(R.vocabulary(posted).collect())
    for terms in ([("status", True)], [("status", True), ("visit", False)], [("cafe", False), ("patient", True), ("order", False)]):
        match = " OR ".join(f'"{t}"' + ("" if exact else "*") for t, exact in terms)
        wanted = dict(db.execute(f"select chunk_id, bm25(f, {','.join(str(w) for w in R.WEIGHTS.values())}) from f where f match ?", (match,)).fetchall())
        asked = spark.createDataFrame([(1, t, exact) for t, exact in terms], "query_id int, token string, exact boolean")
        got = {r["chunk_id"]: r["score"] for r in R.bm25(R.token_hits(posted, asked, vocab), sizes).collect()}
        assert got == pytest.approx(wanted, abs=1e-9)


def test_phrases_and_volumes(spark):
    posted = R.postings(frames(spark))
    parts = R.token_words(spark.createDataFrame([("pat_enc",), ("links_id",)], "token string"), "token")
    assert {(r["token"], r["chunk_id"]) for r in R.phrase_starts(posted, parts, "token").collect()} == {("pat_enc", "c1"), ("pat_enc", "c2")}
    questions = spark.createDataFrame([(1, "visits nothere STATUS pat_enc"), (2, "or OR 1234")], "query_id int, question string")
    asked = R.asked_tokens(questions)
    assert [(r["token"], r["exact"]) for r in asked.where("query_id = 1").orderBy("place").collect()] == [("visit", False), ("nothere", False), ("status", False), ("pat_enc", True)]
    volumes = R.token_volumes(asked, posted, R.vocabulary(posted))
    assert {r["token"]: r["volume"] for r in volumes.collect()} == {"pat_enc": 2, "visit": 3, "status": 2}  # a chunk counts once a term
    kept = R.select_tokens(asked, volumes, 2).orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["token"]) for r in kept] == [(1, "status"), (1, "pat_enc")]


@pytest.mark.parametrize(("raw", "token"), [("Visits", "visit"), ("status", "status"), ("class", "class"), ("this", "this"), ("or", None), ("OR", "or"), ("ed", "ed"), ("ab", None), ("a1", "a1"), ("TABLES", None), ("x_y", "x_y"), ("is", None)])
def test_query_tokens(raw, token):
    assert T.query_token(raw) == token


def loop_diversity(ranked, k, cap, exempt):
    kept, rest, seen = [], [], {}
    for chunk, doc in ranked:
        if doc == exempt or seen.get(doc, 0) < cap:
            seen[doc] = seen.get(doc, 0) + 1
            kept.append(chunk)
        else:
            rest.append(chunk)
    return (kept + rest)[:k]


def test_diversity_matches_a_loop(spark):
    rng = random.Random(2)
    rows, wanted = [], {}
    for q in range(30):
        ranked = [(f"q{q}c{k}", f"d{rng.randrange(4)}") for k in range(rng.randrange(1, 20))]
        rows += [(q, c, d, k + 1) for k, (c, d) in enumerate(ranked)]
        wanted[q] = loop_diversity(ranked, 8, 3, "d1")
    frame = spark.createDataFrame(rows, "query_id int, chunk_id string, source_path string, rank int")
    got = {}
    for r in R.diverse(frame, 8, exempt=frame["source_path"] == "d1").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == wanted
    assert R.diverse(frame, 2, cap=0).count() == frame.where("rank <= 2").count()


def test_hint_and_fusion(spark):
    hints = [r["h"] for r in spark.createDataFrame([("what is in PAT_ENC and ORDERS",), ("the orders table",), ("SQL and nothing",)], "q string").select(T.document_hint(R.F.col("q")).alias("h")).collect()]
    assert hints == ["PAT_ENC", "ORDERS", None]
    boosted = R.with_hint(spark.createDataFrame([(1, "c1", -1.0), (1, "c3", -9.0)], "query_id int, chunk_id string, score double"), frames(spark), spark.createDataFrame([(1, "PAT_ENC")], "query_id int, hint string"))
    assert [r["chunk_id"] for r in R.ranked(boosted, 2, R.F.col("document_rank").asc(), R.F.col("score").asc()).orderBy("rank").collect()] == ["c1", "c3"]
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, chunk_id string, rank int")
    fused = R.fuse(a, b, k=2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in fused] == ["y", "x"] and fused[0]["score"] == pytest.approx(1 / 62 + 1 / 61)
    with pytest.raises(SparkRuntimeException, match="a hit is missing from the index: x"):  # as the query runs
        R.hydrate(a.where("chunk_id = 'x'"), frames(spark)).collect()
    assert R.hydrate(a, frames(spark), strict=False).count() == 0


def test_expansion_takes_the_best_edge(spark):
    edges = spark.createDataFrame([("r1", "A", "B", "A", "B", "B_ID", "ID", 2), ("r2", "A", "B", "A", "B", "VISIT_ID", "ID", None), ("r3", "C", "A", "C", "A", "A_ID", "ID", 1), ("r4", "A", None, "A", "Z", "Z_ID", "ID", 1), ("r5", "A", "A", "A", "A", "UP", "ID", 1)], "relationship_id string, source_doc_id string, target_doc_id string, source_table string, target_table string, source_column string, target_column string, ordinal int")
    seeds = spark.createDataFrame([(1, "A", 1)], "query_id int, doc_id string, seed_rank int")
    plain = [(r["neighbour"], r["relationship_id"], r["direction"]) for r in R.expand_one_hop(seeds, edges).orderBy("rank").collect()]
    assert plain == [("C", "r3", "inbound"), ("B", "r1", "outbound")]
    asked = [(r["neighbour"], r["relationship_id"]) for r in R.expand_one_hop(seeds, edges, R.F.lit("which visits")).orderBy("rank").collect()]
    assert asked == [("B", "r2"), ("C", "r3")]


def test_search_end_to_end(spark):
    chunks = frames(spark).selectExpr("*", "upper(substring_index(source_path, '/', -1)) as doc_id", "0 as chunk_index")
    posted = R.postings(frames(spark))
    questions = spark.createDataFrame([(1, "what does the status column of the ORDERS table mean"), (2, "cafes")], "query_id int, question string")
    found, none = R.search(questions, chunks, posted, 2)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert none is None and set(got[1]) <= {"c2", "c3"} and got[1][0] == "c3" and "c4" in got[2]
    edges = spark.createDataFrame([("r1", "ORDERS.HTML", "PAT_ENC.HTML", "ORDERS", "PAT_ENC", "ENC_ID", "ID", 1)], "relationship_id string, source_doc_id string, target_doc_id string, source_table string, target_table string, source_column string, target_column string, ordinal int")
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "query_id int, query array<float>")
    both, near = R.search(questions, chunks, posted, 2, vectors=vectors, vector_queries=asked, relationships=edges)
    assert both.where("query_id = 1 and chunk_id = 'c2'").count() == 1
    assert {(r["query_id"], r["neighbour"]) for r in near.collect()} == {(2, "ORDERS.HTML")}  # query 1 has both documents already


def test_search_finds_a_token_of_two_words_as_a_phrase(spark):
    more = [("c5", "OTHER.html", "OTHER", "document", "OTHER", "pat pat pat enc pat enc", ""), ("c6", "PAT.html", "PAT - Patients", "document", "PAT", "one pat and one enc, enc pat", "pat")]
    rows = ROWS + more
    db = sqlite3.connect(":memory:")
    db.execute(f"create virtual table f using fts5({', '.join(NAMES)})")
    db.executemany(f"insert into f values ({','.join('?' * 7)})", [[x or "" for x in r] for r in rows])
    match = 'select chunk_id, bm25(f, {}) from f where f match ?'.format(",".join(str(w) for w in R.WEIGHTS.values()))
    wanted = {1: dict(db.execute(match, ('"pat_enc"',)).fetchall()), 2: dict(db.execute(match, ('"pat_enc" OR visit*',)).fetchall()), 3: dict(db.execute(match, ('"pat_pat"',)).fetchall())}
    assert set(wanted[1]) == {"c1", "c2", "c5"}
    chunks = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in NAMES))
    posted = R.postings(chunks)
    questions = spark.createDataFrame([(1, "what is pat_enc"), (2, "pat_enc visits"), (3, "pat_pat")], "query_id int, question string")
    found, _ = R.search(questions, chunks, posted, 10)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == {q: sorted(s, key=lambda c: (s[c], c)) for q, s in wanted.items()}
    vocab = R.vocabulary(posted)
    scores = R.bm25(R.token_hits(posted, R.asked_tokens(questions), vocab), R.chunk_sizes(posted)).collect()
    for q, own in wanted.items():
        assert {r["chunk_id"]: r["score"] for r in scores if r["query_id"] == q} == pytest.approx(own, abs=1e-9)
    kept = R.indexed_fields(chunks)
    assert sorted(R.field_postings(kept).collect()) == sorted(posted.collect()) and sorted(R.field_vocabulary(kept).collect()) == sorted(vocab.collect())


def loop_search(docs, items, vectors, k):
    """chunk ids of every query in order: lexical arm, and both arms fused, document by document."""
    fields = {str(d): {"source_path": R.fold(source).split(), "title": R.fold(lang).split(), "text": R.fold(text).split()} for d, source, lang, text in docs}
    source = {str(d): s for d, s, _, _ in docs}
    size = {c: sum(map(len, f.values())) for c, f in fields.items()}
    terms = {c: {w for f in own.values() for w in f} for c, own in fields.items()}
    chunks = Counter(w for own in terms.values() for w in own)
    mean = sum(size.values()) / len(size)

    def frequency(token, words):
        own = R.fold(token).split()
        if T.is_exact(token):
            return sum(words[i : i + len(own)] == own for i in range(len(words)))
        return sum(w.startswith(token) for w in words)

    def lexical(question, depth):
        tf = defaultdict(dict)
        found = R.query_tokens(question)
        for token in found:
            for c, own in fields.items():
                f = sum(R.WEIGHTS[col] * frequency(token, words) for col, words in own.items())
                if f:
                    tf[token][c] = f
        volume = {t: len(tf[t]) if T.is_exact(t) else sum(n for w, n in chunks.items() if w.startswith(t)) for t in found}
        alive = [t for t in found if volume[t]]
        chosen = sorted(alive, key=lambda t: (not T.is_identifier(t), 0 if T.is_identifier(t) else volume[t], found.index(t)))[:8]
        score = Counter()
        for token in chosen:
            idf = max(1e-6, math.log((len(size) - len(tf[token]) + 0.5) / (len(tf[token]) + 0.5)))
            for c, f in tf[token].items():
                score[c] -= idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[c] / mean))
        pool = sorted(score, key=lambda c: (round(score[c], 9), c))[: 4 * depth]
        return loop_diversity([(c, source[c]) for c in pool], depth, 3, None)

    def both(query, question):
        arms = [lexical(question, 2 * k)]
        if (asked := vectors.get(20 * query % len(vectors))) is not None:
            arms.append(sorted((c for c in map(str, vectors) if c in fields), key=lambda c: (-sum(x * y for x, y in zip(vectors[int(c)], asked, strict=True)), c))[: 2 * k])
        score = Counter()
        for arm in arms:
            for rank, c in enumerate(arm, 1):
                score[c] += 1 / (60 + rank)
        return [c for c in sorted(score, key=lambda c: (-round(score[c], 12), c))[:k]]

    return {q: lexical(t, k) for q, t in items}, {q: both(q, t) for q, t in items}


def test_whole_questions_are_searched(spark, tmp_path):
    from sablequery import queries as library

    rng = random.Random(7)
    vocabulary = ["red", "reds", "redder", "blue", "ink", "inks", "café", "cafes", "pat", "enc", "is", "a1", "ab", "gravel", "gravelly", "of", "oak", "oaken", "elm", "ash", "fir", "yew", "longestword"]
    docs = [(d, f"SRC{d % 3}", rng.choice(["en", "de"]), " ".join(rng.choices(vocabulary, k=rng.randrange(1, 25)))) for d in range(70)]
    items = [(q, " ".join(rng.choices([*vocabulary, "pat_enc", "nosuch"], k=rng.randrange(1, 15)))) for q in range(6)] + [(6, "red ink"), (7, "pat_enc")]
    vectors = {v: [float(rng.randrange(-4, 5)) for _ in range(4)] for v in range(90)}
    for name, rows, schema in (("documents", docs, "doc_id long, source string, lang string, text string"), ("benchmark", items, "item_id long, text string"), ("embeddings", list(vectors.items()), "vec_id long, embedding array<float>")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, wanted in zip(("fts_search", "hybrid_search"), loop_search(docs, items, vectors, 5), strict=True):
        got = defaultdict(list)
        for r in library.QUERIES[name](spark, str(tmp_path)).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append(r["chunk_id"])
        assert got == {q: own for q, own in wanted.items() if own}


def test_lookups(spark):
    docs = spark.createDataFrame([("d1", "enc/PAT_ENC.html", "PAT_ENC - Encounters"), ("d2", "ORDERS.html", "Orders"), ("d3", "x.html", "ORDERS - old")], "doc_id string, source_path string, title string")
    assert {r["doc_id"] for r in R.find_documents(docs, "orders").collect()} == {"d2", "d3"}
    assert {r["doc_id"] for r in R.find_documents(docs, "pat enc").collect()} == {"d1"}
    chunks = spark.createDataFrame([("d1", "c1", 1, "PAT_ENC > Primary Key", "k"), ("d1", "c0", 0, "PAT_ENC > Primary Key", "k"), ("d1", "c2", 2, "PAT_ENC > Other", "column_info")], "doc_id string, chunk_id string, chunk_index int, heading_path string, category string")
    assert [r["chunk_id"] for r in R.named_section(chunks, docs, "PAT_ENC", "primary key").collect()] == ["c0", "c1"]
    hits = spark.createDataFrame([(1, "c0", 1), (1, "c2", 2)], "query_id int, chunk_id string, rank int")
    assert [(r["chunk_id"], r["rank"]) for r in R.of_category(hits, chunks, "column_info", 5).collect()] == [("c2", 1)]
    evidence = spark.createDataFrame([("T", "B", "DATE", "safe_aggregate"), ("T", "A", None, "safe_aggregate"), ("T", "K", "INT64", "identifier"), ("T", "S", None, "sensitive")], "table string, column string, data_type string, safety string")
    assert tuple(R.column_summary(evidence).first()) == ("T", "A, B (DATE)", "K (INT64)")


def test_vector_index_is_checked(spark, tmp_path):
    from sablequery.sources import artifacts

    good = spark.createDataFrame([(0, "a", [1.0], "m"), (1, "b", [0.5], "m")], "position int, chunk_id string, embedding array<float>, model string")
    good.write.parquet(str(tmp_path / "good"))
    assert artifacts.read_vectors(spark, str(tmp_path / "good"), "m").count() == 2
    good.where("position = 1").write.parquet(str(tmp_path / "gap"))
    for path, model in (("good", "other"), ("gap", None)):
        with pytest.raises(ValueError):
            artifacts.read_vectors(spark, str(tmp_path / path), model)


def test_quality_and_unit_vectors(spark):
    results = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query_id int, chunk_id string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "z"), (2, "q"), (3, "q")], "query_id int, chunk_id string")
    got = {r["query_id"]: (r["hit"], r["recall"], r["reciprocal_rank"]) for r in R.retrieval_quality(results, relevant).collect()}
    assert got == {1: (1, 0.5, 0.5), 2: (0, 0.0, 0.0), 3: (0, 0.0, 0.0)}
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],)], "v array<float>").select(R.unit("v").alias("u")).collect()
    assert rows[0]["u"] == pytest.approx([0.6, 0.8]) and rows[1]["u"] is None and rows[2]["u"] is None


def slow_osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_osa_distance(a, b):
    assert T.osa_distance(a, b) == slow_osa(a, b)


def test_siblings_are_the_first_children_of_the_parent(spark):
    rng = random.Random(5)
    nodes = [(f"n{k:03d}", f"p{k % 3}", rng.randrange(50), "d", "x") for k in range(200)]
    frame = spark.createDataFrame(nodes, "node_id string, parent_id string, position int, document_id string, name string")
    got = {}
    for r in R.siblings(frame, frame.where("position % 7 = 0").select("node_id"), 10).collect():
        got.setdefault(r["of_id"], {})[r["place"]] = r["node_id"]
    for node, parent, position, *_ in nodes:
        if position % 7 == 0:
            others = sorted((p, n) for n, q, p, *_ in nodes if q == parent and n != node)[:10]
            assert got[node] == {k: n for k, (_, n) in enumerate(others, 1)}


def test_dense_queries_in_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    vectors = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)], "chunk_id int, embedding array<float>")
    queries = vectors.where("chunk_id % 3 = 0").selectExpr("chunk_id as query_id", "embedding as query")
    whole = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in R.dense_top(vectors, queries, 5).collect())
    monkeypatch.setattr(R, "QUERIES_A_BLOCK", 6)
    assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in R.dense_top(vectors, queries, 5).collect()) == whole and len(whole) == 100


def test_dense_scores_are_ranked_as_they_are_rounded(spark):
    """Scores that differ after the sixth digit only are ties, which the smaller id wins, also across batches and at the edge of the k."""
    vectors = spark.createDataFrame([(k, [0.5 + (k % 5) * 6e-8, 0.0]) for k in range(20)] + [(20, [0.6, 0.0]), (21, [-0.7, 0.0])], "chunk_id int, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "query_id int, query array<double>")
    got = sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in R.dense_top(vectors, queries, 4, digits=6).collect())
    assert got == [(1, 1, 20, 0.6), (1, 2, 0, 0.5), (1, 3, 1, 0.5), (1, 4, 2, 0.5), (2, 1, 21, 0.7), (2, 2, 0, -0.5), (2, 3, 1, -0.5), (2, 4, 2, -0.5)]
    assert [r["chunk_id"] for r in R.dense_top(vectors, queries, 2).where("query_id = 1").orderBy("rank").collect()] == [20, 4]


def test_scan_without_an_index_scores_as_the_index_does(spark, tmp_path, monkeypatch):
    from sablequery.operators import lexical_index as L
    from sablequery.queries.registry import kept

    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)] + ["the"] * 30
    rows = [(f"c{k}", "t the", " ".join(rng.choices(words, k=rng.randrange(60))) or None) for k in range(120)] + [("none", None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, title string, text string").repartition(3)
    asked = spark.createDataFrame([(q, rng.choice(words)) for q in range(5) for _ in range(9)] + [(9, "nosuch")], "query_id int, term string")
    monkeypatch.setattr(L, "BLOCK_BYTES", 500)
    columns = ["title", "text"]
    index = L.refresh(spark, f"{tmp_path}/index", chunks, columns)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("chunks", "term"))
    chosen = asked.distinct().join(index.terms(), "term").withColumn("n", best).where("n <= 3").selectExpr("query_id", "term as token", "true as exact")
    wanted = {(r["query_id"], r["chunk_id"]): r["score"] for r in L.scores(index, kept(L.weighted_hits(index, kept(chosen), keep=kept))).collect()}
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in L.scanned_scores(chunks, columns, asked, 3, keep=kept).collect()}
    assert got == pytest.approx(wanted, abs=1e-12) and len(got) > 100
    monkeypatch.setattr(L, "SCANNED_TERMS", 5)
    assert L.scanned_scores(chunks, columns, asked, 3, keep=kept) is None


def test_blocks_of_the_index_hold_every_posting(spark, tmp_path, monkeypatch):
    """A row is a term of a block, not of a chunk; dead entries leave it when segments are merged, also without a broadcast."""
    from sablequery.operators import lexical_index as L

    monkeypatch.setattr(L, "BROADCAST_CHUNKS", 0)
    rows = [(f"c{k}", "x", f"x y x é{k % 3} only{k}") for k in range(30)] + [("empty", None, ""), ("null", None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, title string, text string").coalesce(1)
    index = L.refresh(spark, f"{tmp_path}/index", chunks, ["title", "text"])
    assert index.stored_blocks().where("term = 'x'").count() == 1 and index.stored_blocks().count() == 35

    def postings(found):
        return sorted((r["term"], r["chunk_id"], r["col"], r["tf"], r["size"], r["lead"], r["deltas"]) for r in found.postings().collect())

    def wanted(own):
        out = []
        for c, *texts in own:
            fields = [R.fold(t or "").split() for t in texts]
            for k, (col, words) in enumerate(zip(("title", "text"), fields, strict=True)):
                for w in set(words):
                    at = [i for i, x in enumerate(words) if x == w]
                    out.append((w, c, col, len(at), sum(map(len, fields)), int(not any(w in f for f in fields[:k])), [b - a for a, b in zip([0, *at], at, strict=False)]))
        return sorted(out)

    assert postings(index) == wanted(rows)
    edited = [(c, t, f"x new {x}") if c < "c2" else (c, t, x) for c, t, x in rows if c != "c7"]
    again = L.refresh(spark, f"{tmp_path}/index", spark.createDataFrame(edited, "chunk_id string, title string, text string"), ["title", "text"])
    merged = L.compact(again)
    assert postings(again) == postings(merged) == wanted(edited) and merged.segments == (3,)
    assert merged.stored_blocks().where("term = 'x'").count() == again.stored_blocks().where("term = 'x'").count() <= 10
    counts = Counter(t for t, *_, lead, _ in wanted(edited) if lead)
    assert {r["term"]: r["chunks"] for r in merged.terms().collect()} == counts == {r["term"]: r["chunks"] for r in again.terms().collect()}


def test_segments_are_merged_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Dead entries are filtered in their rows, so that postings are dealt by no key; chunks that left, came back, changed or lost
    their whole block are right, also if an update only removes chunks."""
    from sablequery.operators import lexical_index as L

    monkeypatch.setattr(L, "BLOCK_BYTES", 300)
    monkeypatch.setattr(L, "CUT_BYTES", 100, raising=False)
    shuffled, write = [], L._write_segment
    monkeypatch.setattr(L, "_write_segment", lambda rows, *a: (shuffled.append("ShuffledRowRDD" in rows.rdd.toDebugString().decode()), write(rows, *a)))

    def frame(rows):
        return spark.createDataFrame([(k, "a title", text) for k, text in rows.items()], "chunk_id int, title string, text string").coalesce(2)

    def held(index):
        found = index.postings().collect()
        return sorted((r["term"], r["chunk_id"], r["col"], r["tf"], r["size"], r["lead"], r["deltas"]) for r in found)

    def wanted(rows):
        out = []
        for k, text in rows.items():
            fields = [["a", "title"], (text or "").split()]
            for i, words in enumerate(fields):
                for w in set(words):
                    at = [n for n, x in enumerate(words) if x == w]
                    out.append((w, k, ("title", "text")[i], len(at), sum(map(len, fields)), int(not i or w not in fields[0]), [b - a for a, b in zip([0, *at], at, strict=False)]))
        return sorted(out)

    rng = random.Random(4)
    first = {k: " ".join(rng.choices("abcdefgh", k=12)) for k in range(40)} | {40: None}
    fewer = {k: t for k, t in first.items() if k % 5}
    edited = {k: f"new {t}" if k % 7 == 1 else t for k, t in first.items() if k % 10}
    rest = {k: t for k, t in edited.items() if k > 20}
    for rows in (first, fewer, edited, None, rest, None):
        index = L.refresh(spark, f"{tmp_path}/index", frame(rows), ["title", "text"]) if rows else L.compact(index)
        rows = rows or previous
        assert held(index) == wanted(rows)
        words = {k: f"a title {t or ''}".split() for k, t in rows.items()}
        assert {r["chunk_id"]: (r["tokens"], r["terms"]) for r in index.chunk_sums().collect()} == {k: (len(w), len(set(w))) for k, w in words.items()}
        counts = Counter(w for found in words.values() for w in set(found))
        assert {r["term"]: r["chunks"] for r in index.terms().collect()} == counts
        previous = rows
    assert index.segments == (6,) and shuffled == [False] * 4  # the first, the edited, the two merged
    stored = spark.read.parquet(f"{tmp_path}/index/postings/segment=6").agg(F.sum("chunks"), F.sum("occurrences")).first()
    assert tuple(stored) == (sum(counts.values()), sum(map(len, words.values())))


def test_an_index_is_not_shuffled_for_many_terms(spark, tmp_path, monkeypatch):
    """Also beyond the terms that are named in the scan, as long as they can be sent."""
    from sablequery.operators import lexical_index as L

    chunks = spark.createDataFrame([(f"c{k}", f"w{k % 7} w{k} x") for k in range(30)], "chunk_id string, text string")
    index = L.refresh(spark, f"{tmp_path}/index", chunks, ["text"])
    terms = spark.createDataFrame([(q, f"w{q}") for q in range(12)] + [(99, "nosuch")], "query_id int, term string")
    wanted = sorted((k % 7, f"c{k}") for k in range(30) if k >= 7) + sorted((k, f"c{k}") for k in range(12))
    for named, sent in ((5000, 5000), (3, 5000), (3, 3)):
        monkeypatch.setattr(L, "NAMED_TERMS", named)
        monkeypatch.setattr(L, "SENT_TERMS", sent, raising=False)
        found = index.postings(terms)
        assert sorted((r["query_id"], r["chunk_id"]) for r in found.collect()) == sorted(wanted)
        assert ("broadcast" in found._jdf.queryExecution().analyzed().toString()) == (sent == 5000)


def test_plain_words_of_a_batch_in_parts():
    texts = [None, "", "Ａｂ-c​d"] + [f"É{k}! Word" for k in range(2 * T.TEXTS_AT_ONCE)]
    assert T._plain_words.func(pa.array(texts)).to_pylist() == [None if t is None else T.plain_words(t) for t in texts]
    assert T._plain_words.func(pa.array([], pa.string())).to_pylist() == []
