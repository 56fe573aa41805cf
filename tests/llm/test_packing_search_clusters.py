"""Curve packing, shared search and VA-file clustering against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sablequery.llm import centroids, curve_packing, shared_search

from .fixtures import ROWS, documents, empty

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def token_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids, curve_packing.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# -- packing


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), axis=-1).reshape(-1, dimensions)
    keys = curve_packing.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def checked_packing(rows, wanted, length):
    """Every id in one piece, offsets without gaps, full sequences but for the last."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append(r)
    left = Counter((str(i), tuple(token_ids(t))) for i, t in wanted)
    for (i, n), pieces in by_doc.items():
        for ids in [ids for (j, ids), _ in left.items() if j == i and len(ids) == n]:
            copies = left[i, ids]
            found = Counter((p["start"], p["length"], p["ids_crc32"]) for p in pieces)
            covered = sorted((p["start"], p["length"]) for p in pieces)
            assert sum(c for _, c in covered) == n * copies
            assert all(k == crc(ids[a : a + c]) for (a, c, k) in found)
            del left[i, ids]
    assert not left
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, own in by_sequence.items():
        own.sort()
        ends = [a + c for a, c in own]
        assert own[0][0] == 0 and [a for a, _ in own[1:]] == ends[:-1]
        assert ends[-1] == length or k == len(by_sequence) - 1


@pytest.mark.parametrize("length", [1024, 7])
def test_packing_cuts_every_document_without_gaps(spark, length):
    rows = curve_packing.pack(documents(spark).repartition(3), VOCABULARY, length=length).collect()
    checked_packing(rows, [(i, t) for i, t, *_ in ROWS], length)


def test_packed_sequences_hold_their_ids(spark):
    pieces = curve_packing.pack(documents(spark), VOCABULARY, length=64)
    total = sum(len(token_ids(t)) for _, t, *_ in ROWS)
    got = curve_packing.sequences(pieces).orderBy("sequence_id").collect()
    assert [len(r["ids"]) // 2 for r in got[:-1]] == [64] * (len(got) - 1) and sum(len(r["ids"]) // 2 for r in got) == total
    assert all(r["n_tokens"] == len(r["ids"]) // 2 for r in got)
    everything = Counter(np.frombuffer(b"".join(bytes(r["ids"]) for r in got), "<u2").tolist())
    assert everything == Counter(t for _, text, *_ in ROWS for t in token_ids(text))


def test_packing_of_nothing_and_of_one_text_many_times(spark):
    assert curve_packing.pack(empty(spark), VOCABULARY).count() == 0
    rows = [(k, "the same words again and again", "en", "s") for k in range(300)]
    docs = documents(spark, rows).repartition(6)
    checked_packing(curve_packing.pack(docs, VOCABULARY, length=100).collect(), [(i, t) for i, t, *_ in rows], 100)
    assert curve_packing.encoded_documents(docs, VOCABULARY).select(*curve_packing.AXES).distinct().count() == 1


def test_like_texts_are_neighbours_on_the_curve(spark):
    topics = ["engine piston valve gear brake clutch wheel axle", "flour butter sugar oven dough yeast cream whisk", "violin cello flute opera choir sonata tempo chord", "glacier river valley canyon desert island reef delta"]
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(rng.choice(topics[k % 4].split(), 60)), "en", "s") for k in range(200)]
    found = curve_packing.along_curve(curve_packing.stored(curve_packing.encoded_documents(documents(spark, rows).repartition(5), VOCABULARY), "t"))
    order = [r["doc_id"] % 4 for r in sorted(found.select("part", "at", "doc_id").collect())]
    assert sum(a == b for a, b in zip(order, order[1:], strict=False)) > 0.8 * len(order)  # a quarter by chance


# -- search


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def ranked(docs, items, top=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in asked.items():
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w in words if c[w])
            scores += [(-s, i is None, i)] if s > 0 else []
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


ITEMS = [(0, "The QUICK brown fox"), (1, "the quick dog"), (2, "lorem ipsum the quick"), (3, None), (4, "!!!"), (5, "zzz-not-there"), (5, "same"), (None, "fox"), (6, "ünïcode WÖRDS Same"), (7, "same"), (7, "same")]


def items_of(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 as doc_id", "'t' as term", "0 as score", "'x' as rank")


@pytest.mark.parametrize("block_terms", [shared_search.BLOCK_TERMS, 4])
def test_search_equals_scoring_every_document(spark, block_terms):
    found = shared_search.rank_documents(documents(spark).repartition(3), items_of(spark), block_terms=block_terms)
    assert sorted([tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()], key=str) == ranked([(i, t) for i, t, *_ in ROWS], ITEMS)


def test_search_with_ties_and_batches(spark, monkeypatch):
    monkeypatch.setattr(shared_search, "DOCUMENTS_AT_ONCE", 7)
    rows = [((97 * k) % 500, f"common word{k % 13} word{k % 5} " + "pad " * (k % 3), "en", "s") for k in range(500)]
    asked = [(k, f"common word{k % 13} word{k % 7} word{k % 3}") for k in range(40)]
    found = shared_search.rank_documents(documents(spark, rows).repartition(4), items_of(spark, asked))
    assert sorted([tuple(r) for r in found.collect()], key=str) == ranked([(i, t) for i, t, *_ in rows], asked)


def test_search_without_documents_or_items(spark):
    assert shared_search.rank_documents(empty(spark), items_of(spark)).count() == 0
    assert shared_search.rank_documents(documents(spark), items_of(spark).where("false")).count() == 0
    assert shared_search.rank_documents(documents(spark), items_of(spark, [(1, ""), (None, "same")])).count() == 0


@given(st.lists(st.sets(st.integers(0, 11), min_size=1), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_graph_sums_each_items_classes(own):
    by_term = {}
    for item, words in enumerate(own):
        for w in words:
            by_term.setdefault(w, []).append(item)
    members = sorted({tuple(v) for v in by_term.values()}, key=lambda v: (-len(v), v))
    graph = shared_search.SharingGraph([list(m) for m in members], len(own))
    base = np.array([[3**c] for c in range(len(members))])
    wanted = [sum(3**c for c, m in enumerate(members) if item in m) for item in range(len(own))]
    assert graph.evaluate(base)[:, 0].tolist() == wanted
    assert graph.nodes - len(members) <= sum(sum(item in m for m in members) - 1 for item in range(len(own)))


def test_equal_parts_of_items_are_one_node():
    graph = shared_search.SharingGraph([[0, 1, 2], [0, 1, 2], [0, 1], [0, 1], [2]], 3)
    assert graph.roots[0] == graph.roots[1] != graph.roots[2]
    assert graph.nodes == 9  # (0 1) once for three items, (2 3) and the four together once for two, (0 1 4)


# -- clusters


def clustered(rows, k=16, rounds=3):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [max(-centroids.LARGEST, min(centroids.LARGEST, math.floor(64 * float(np.float32(x))))) for x in e]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    middle = [v for _, v in first]

    def assign():
        return [min(((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(middle))) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(middle)):
            own = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == j]
            middle[j] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else middle[j]
    found = assign()
    inertia = Counter()
    for d, c in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, found, strict=True)), key=str)


def vector_rows(n, seed=3, spread=0.05):
    rng = np.random.default_rng(seed)
    groups = rng.normal(0, 0.12, (9, 64))
    return [(k, [float(x) for x in groups[k % 9] + rng.normal(0, spread, 64)]) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'c' as cluster", "0 as distance", "'r' as row", "1 as v", "2 as cells")


AWKWARD = [(5000, None), (5001, [0.5] * 63), (5002, [float("nan")] * 64), (5003, [float("inf")] + [0.0] * 63), (5004, [None] + [0.0] * 63), (None, [0.25] * 64), (7, [0.1] * 64), (7, [0.1] * 64), (5005, []), (5006, [-0.0] * 64)]


@pytest.mark.parametrize("spread", [0.05, 0.4])
def test_clusters_equal_plain_rounds(spark, spread):
    rows = vector_rows(250, spread=spread) + AWKWARD
    found = centroids.cluster_vectors(frame(spark, rows).repartition(3))
    assert sorted([tuple(r) for r in found.collect()], key=str) == clustered(rows)


def test_clusters_of_few_equal_and_large_vectors(spark):
    assert centroids.cluster_vectors(frame(spark, []).where("false")).count() == 0
    few = vector_rows(5)
    assert sorted([tuple(r) for r in centroids.cluster_vectors(frame(spark, few)).collect()], key=str) == clustered(few)
    equal = [(k, [0.125] * 64) for k in range(40)] + [(99, [1e30] + [-3e38] * 63), (100, [-1e30] * 64)]
    assert sorted([tuple(r) for r in centroids.cluster_vectors(frame(spark, equal)).collect()], key=str) == clustered(equal)


def test_only_vectors_with_overlapping_intervals_are_compared():
    rng = np.random.default_rng(1)
    middle = rng.integers(-40, 40, (6, 64))
    v = middle[rng.integers(0, 6, 500)] + rng.integers(-3, 4, (500, 64))
    spread = v.std(axis=0)
    edges = np.stack([v.min(axis=0), *[np.ceil(v.mean(axis=0) + spread * z) for z in np.linspace(-1.5, 1.5, 15)], v.max(axis=0) + 1], axis=1)
    edges = np.clip(edges, v.min(axis=0)[:, None], v.max(axis=0)[:, None] + 1).astype("int64")
    found = centroids.Intervals(middle, edges)
    may = found.candidates(np.array(centroids.approximations(v, edges)))
    exact = ((v[:, None, :] - middle[None]) ** 2).sum(axis=2)
    assert may[np.arange(500), exact.argmin(axis=1)].all()
    assert (found.nearest(may, v) == exact.argmin(axis=1)).all()
    assert (may.sum(axis=1) == 1).mean() > 0.9
