"""Toxicity, SimHash and decontamination against brute force."""

import hashlib
import re
import time
import zlib

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sablequery.llm import components, simhash, toxicity_mil, winnowing

from .fixtures import ROWS, documents, empty, lower, words

FILLER = "river stone garden window table letter morning paper bridge summer winter market".split()


def toxic_rows(n=400):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(n):
        lines = [" ".join(rng.choice(FILLER, 8)) for _ in range(5)]
        bad = i % 4 == 0
        if bad:
            lines[int(rng.integers(5))] += " you " + str(rng.choice(["gronk", "blarg", "snarfly"]))
        rows.append((i, ". ".join(lines) + ".", "en", "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_learns_from_bags_and_locates(spark):
    rows, labels = toxic_rows()
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = {r["doc_id"]: r for r in toxicity_mil.toxicity(docs, marks).collect()}
    assert all(scored[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in labels)
    held = [(scored[i]["predicted"], t) for i, _, t in labels if scored[i]["held_out"]]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    model = toxicity_mil.train_model(docs, marks)
    found = {(r["doc_id"], r["sentence"]) for r in toxicity_mil.offending_sentences(docs, model).collect()}
    wanted = {(i, k) for i, text, _, _ in rows for k, s in enumerate(text.split(".")) if re.search("gronk|blarg|snarfly", s)}
    assert len(found & wanted) > 0.97 * len(wanted) and len(found - wanted) < 3
    kept = toxicity_mil.toxicity_stage(spark, docs, marks)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in scored.items() if r["score"] < 0.5}


def test_toxicity_cases(spark):
    marks = spark.createDataFrame([(0, 0, 1), (0, 0, None), (1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity_mil.toxicity(documents(spark), marks).collect()
    assert len(rows) == len(ROWS)
    assert all(r["score"] == 0.0 and r["n_sentences"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity_mil.toxicity(empty(spark), marks).count() == 0
    assert toxicity_mil.toxicity_stage(spark, documents(spark), marks.where("false")).count() == len(ROWS)


def test_long_clean_texts_stay_with_any_labels(spark):
    rows, labels = toxic_rows()
    long = [(1000 + k, " river stone garden.\n" * n, "en", "s") for k, n in enumerate((100, 1000, 5000))]
    docs = documents(spark, rows + long)
    for kept in (labels, [], [x for x in labels if x[2]], [x for x in labels if not x[2]], [(i, q, None) for i, q, _ in labels]):
        marks = spark.createDataFrame(kept, "doc_id long, quality int, toxic int")
        scored = {r["doc_id"]: r["score"] for r in toxicity_mil.toxicity(docs, marks).select("doc_id", "score").collect()}
        assert all(scored[i] < 0.5 for i, *_ in long)
        if kept is not labels:
            assert set(scored.values()) == {0.0} and toxicity_mil.toxicity_stage(spark, docs, marks).count() == len(rows) + 3


def test_score_is_the_noisy_or_of_its_sentences(spark):
    rows, labels = toxic_rows(120)
    rows += [(900, "Gronk! you snarfly? " + rows[1][1], "en", "s"), (901, None, "en", "s"), (None, "you blarg", "en", "s")]
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity_mil.train_model(docs, marks)
    weight = dict(zip(sorted(model.words, key=model.words.get), model.weights[:-1], strict=True))
    for r in toxicity_mil.score_documents(docs, model, ["doc_id"]).collect():
        text, clean = next(t for i, t, *_ in rows if i == r["doc_id"]), 1.0
        for sentence in re.split("[.!?\r\n]", lower(text)):
            own = {w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", sentence)}
            parts = [weight[f] for w in own for f in {w, w[:4] + b"*" if len(w) > 4 else w, w[:6] + b"*" if len(w) > 6 else w} if f in weight]
            if parts:
                clean *= 1 - 1 / (1 + np.exp(-(model.weights[-1] + sum(parts))))
        assert abs(r["score"] - (1 - clean)) < 1e-9


def test_gradient_is_the_likelihood_slope():
    rng = np.random.default_rng(0)
    toxic = np.array([1, 0, 1])
    bag, owner = np.array([0, 0, 1, 2]), np.array([0, 0, 1, 2, 3, 3])
    features, weights = np.array([0, 1, 2, 0, 2, 1]), rng.normal(size=4)

    def loss(w):
        z = w[-1] + np.bincount(owner, w[features], 4)
        clean = np.bincount(bag, -np.logaddexp(0, z), 3)
        return np.where(toxic > 0, np.log(-np.expm1(clean)), clean).sum()

    slope = [(loss(weights + 1e-6 * e) - loss(weights - 1e-6 * e)) / 2e-6 for e in np.eye(4)]
    assert np.allclose(toxicity_mil.bag_gradient(weights, toxic, bag, features, owner), slope, atol=1e-5)


def brute_fingerprint(text):
    own = words(text)
    parts = [" ".join(own[k : k + 4]) for k in range(max(len(own) - 3, 1))] if own else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_matches_brute_force(spark):
    rows = simhash.near_duplicates(documents(spark)).collect()
    assert len(rows) == len(ROWS)
    prints = [(i, brute_fingerprint(t)) for i, t, _, _ in ROWS]
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in rows) == sorted((str(i), f"{f:016x}") for i, f in prints)
    by = {}
    for r in rows:
        by.setdefault(r["fingerprint"], set()).add(r["component_id"])
    distinct = sorted({f for _, f in prints})
    found = brute_components([(a, b) for a in distinct for b in distinct if a < b and bin(a ^ b).count("1") <= 4], distinct)
    least = {}
    for i, f in prints:
        if i is not None:
            least[found[f]] = min(least.get(found[f], i), i)
    assert all(by[f"{f:016x}"] == {least.get(found[f])} for f in distinct)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_links_connect_dense_and_sparse_groups(spark):
    rng = np.random.default_rng(1)
    values = set(rng.integers(-(2**63), 2**63 - 1, 400).tolist())
    centre = int(rng.integers(2**62))
    for _ in range(600):  # a group far larger than a part
        values.add(centre ^ int(sum(1 << int(b) for b in rng.choice(62, int(rng.integers(0, 4)), replace=False))))
    chain = centre >> 1
    for step in range(0, 60, 4):
        chain ^= 0xF << step
        values.add(chain)
    values = sorted(values)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    arr = np.array(values, dtype="int64").view("uint64")
    pairs = [(values[i], values[j]) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 4) + i + 1]
    wanted = brute_components(pairs, values)
    for blocks, part, rekeyed in ((6, 64, 1 << 20), (7, 2048, 50), (8, 100, 10)):
        got = simhash.links(frame, blocks=blocks, part=part, rekeyed=rekeyed).collect()
        assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 4 for r in got)
        assert brute_components([(r["a"], r["b"]) for r in got], values) == wanted


def test_dedup_stage_keeps_one_of_each_group(spark):
    docs = documents(spark)
    kept = simhash.dedup_stage(docs)
    assert kept.columns == docs.columns
    groups = {}
    for r in simhash.near_duplicates(docs).collect():
        groups.setdefault(r["component_id"], []).append(r["doc_id"])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(min((i for i in g if i is not None), default=None)) for g in groups.values())
    assert simhash.dedup_stage(empty(spark)).count() == 0


def test_dedup_stage_with_repeated_ids_and_clashing_names(spark, monkeypatch):
    rows = [(1, "alpha beta gamma delta epsilon", "en", "a"), (1, "alpha beta gamma delta epsilon", "en", "b"), (1, "another text of the same id", "en", "a"), (2, "alpha beta gamma delta epsilon", "en", "a"), (None, "no id here at all", "en", "a"), (None, "no id here at all", "en", "a"), (3, None, "en", "a"), (4, " ", "en", "a")]
    docs = documents(spark, rows).selectExpr("*", "'t' as th", "0L as count", "1 as copies2")
    for most in (10, -1):
        monkeypatch.setattr(simhash, "BROADCAST_KEPT", most)
        kept = simhash.dedup_stage(docs)
        assert kept.columns == docs.columns
        assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == [("1", "alpha beta gamma delta epsilon"), ("1", "another text of the same id"), ("3", ""), ("None", "no id here at all")]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {300: 300, 301: 300}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_contamination(docs, items):
    windows = {}
    for i, text in items:
        own = WORD.findall(lower(text))
        n = min(10, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            windows.setdefault(tuple(own[k : k + n]), set()).add(str(i))
    out = []
    for i, text in docs:
        own, hit, names = WORD.findall(lower(text)), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(own) - n + 1):
                if found := windows.get(tuple(own[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        out.append((str(i), len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontamination_matches_brute_force(spark):
    span = " ".join(f"w{k}" for k in range(14))
    items = [(1, span), (2, span + " end"), (3, "short item words"), (4, None), (5, "..."), (6, "same same same same same same same same same same same"), (10, "three four five"), (None, span)]
    rows = [*ROWS, (20, f"before, {span.upper()}; after"), (21, " ".join(f"w{k}" for k in range(9))), (22, "x " + " ".join(f"w{k}" for k in range(3, 13))), (23, "same " * 40), (24, "SHORT-item words!"), (25, "w0 " * 30)]
    rows = [(*r, None, None)[:4] for r in rows]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'z' as key")
    got = winnowing.contamination(documents(spark, rows), bench).collect()
    assert sorted((str(r["doc_id"]), *r[1:]) for r in got) == brute_contamination([r[:2] for r in rows], [i for i in items if i[0] is not None])
    kept = winnowing.decontamination_stage(documents(spark, rows), bench)
    assert kept.columns == documents(spark, rows).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if not r["contaminated"])
    assert winnowing.contamination(empty(spark), bench).count() == 0
    assert not any(r["contaminated"] for r in winnowing.contamination(documents(spark), bench.where("false")).collect())


def test_decontamination_without_the_hash_filter(spark, monkeypatch):
    span = " ".join(f"w{k}" for k in range(12))
    rows, items = [(1, f"a {span} b", None, None), (2, "clean", None, None)], [(7, span)]
    monkeypatch.setattr(winnowing, "BROADCAST_HASHES", -1)
    monkeypatch.setattr(winnowing, "BROADCAST_DOCUMENTS", -1)
    got = winnowing.contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), *r[1:]) for r in got) == brute_contamination([r[:2] for r in rows], items)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60), st.lists(st.integers(0, 5), min_size=10, max_size=30))
def test_every_shared_window_is_found(document, item):
    own, other, table = b" ".join(b"%d" % x for x in document), [b"%d" % x for x in item], winnowing.WordHashes()
    places, size = winnowing.shared_windows(winnowing.Document(own, table), other, table)
    windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    assert size == 10 and places.tolist() == [j for j in range(len(document) - 9) if tuple(document[j : j + 10]) in windows]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=10, max_size=60), st.lists(st.integers(0, 3), min_size=10, max_size=30))
def test_winnowing_proposes_every_pair_that_shares_a_window(document, item):
    table = winnowing.WordHashes()
    own, other = (np.array([table[b"%d" % x] for x in xs], dtype="uint64") for xs in (document, item))
    shares = {tuple(document[k : k + 10]) for k in range(len(document) - 9)} & {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    assert not shares or set(winnowing.kept_hashes(own, []).tolist()) & set(winnowing.kept_hashes(other, []).tolist())


def test_repetitive_texts_take_linear_time():
    table, began = winnowing.WordHashes(), time.time()
    places, _ = winnowing.shared_windows(winnowing.Document(b"same " * 20_000, table), [b"same"] * 3_000, table)
    assert len(places) == 19_991 and time.time() - began < 0.5


def test_rows_of_one_id_are_checked_each_by_its_text(spark):
    span = " ".join(f"w{k}" for k in range(12))
    rows = [(None, span, None, None), (None, "clean words", None, None), (4, span, None, None), (4, "clean too", None, None), (4, None, None, None)]
    docs = documents(spark, rows).selectExpr("*", "'i' as items", "'d' as doc", "1 as n_words")
    bench = spark.createDataFrame([(1, span), (2, span), (2, span)], "item_id long, text string")
    got = winnowing.contamination(docs, bench).collect()
    assert sorted((str(r["doc_id"]), *r[1:]) for r in got) == brute_contamination([r[:2] for r in rows], [(1, span), (2, span)])
    kept = winnowing.decontamination_stage(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r["text"]) for r in kept.collect()) == ["None", "clean too", "clean words"]
