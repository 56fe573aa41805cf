"""Mixing, sharding, line deduplication and the pipeline."""

import itertools
import math
import re
import tempfile
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sablequery.llm import common, line_dedup, mixing, virtual_slots

from .fixtures import ROWS, documents, empty, words


def sources(n=600):
    rng = np.random.default_rng(6)
    names = ["big"] * 300 + ["mid"] * 200 + ["small"] * 90 + [None] * 10
    return [(i, " ".join(["w"] * int(rng.integers(1, 40))), "en", names[i]) for i in range(n)]


def test_exponent_meets_repetition_and_entropy(spark):
    shares = spark.createDataFrame([("a", 0.9), ("b", 0.09), ("c", 0.01)], "source string, share double")
    a = mixing.bisect_exponent(shares, max_repetition=4.0)
    raised = [p**a / p for p in (0.9, 0.09, 0.01)]
    assert math.isclose(max(raised) / min(raised), 4.0, rel_tol=1e-6)
    b = mixing.bisect_exponent(shares, target_entropy=0.8)
    w = np.array([0.9, 0.09, 0.01]) ** b
    w /= w.sum()
    assert math.isclose(-(w * np.log(w)).sum(), 0.8, rel_tol=1e-6)
    assert mixing.bisect_exponent(shares, max_repetition=1e9) < 1e-6
    assert mixing.bisect_exponent(shares, target_entropy=0.0) > 1 - 1e-6
    with pytest.raises(ValueError):
        mixing.bisect_exponent(shares)


def test_mix_keeps_budgets(spark):
    rows = sources()
    got = mixing.mix(documents(spark, rows), max_repetition=2.0).collect()
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]
    tokens, mixed, epochs = Counter(), Counter(), {}
    for r in got:
        tokens[r["source"]] += r["n_tokens"]
        mixed[r["source"]] += r["n_tokens"] * r["copies"]
        epochs[r["source"]] = r["epochs"]
        assert r["copies"] in (math.floor(r["epochs"] + 1e-9), math.floor(r["epochs"] + 1e-9) + 1)
    assert math.isclose(min(epochs.values()), 1.0, rel_tol=1e-6) and math.isclose(max(epochs.values()), 2.0, rel_tol=1e-5)
    for source, e in epochs.items():
        assert -40 <= mixed[source] - e * tokens[source] <= 1e-3  # never over budget, under by less than a document
    assert math.isclose(sum({r["source"]: r["weight"] for r in got}.values()), 1.0, rel_tol=1e-9)


def test_small_blocks_give_the_same_budgets(spark):
    rows = sources()
    slim = common.stored(mixing._tokens(documents(spark, rows, clash=False)), "t")
    shares = mixing.source_shares(slim)
    weights = mixing.mixing_weights(shares, 0.5, budget_tokens=9000)
    got = mixing.realise(slim, *mixing.draw_plan(slim, weights, block_tokens=100)).collect()
    mixed, quota = Counter(), {r["source"]: r["quota_tokens"] for r in weights.collect()}
    for r in got:
        mixed[r["source"]] += r["n_tokens"] * r["copies"]
    assert all(-40 <= mixed[s] - q <= 1e-3 for s, q in quota.items())


def test_every_source_has_a_permutation_of_its_own(spark):
    rows = sources()
    slim = common.stored(mixing._tokens(documents(spark, rows, clash=False)), "t")
    weights = mixing.mixing_weights(mixing.source_shares(slim), 0.5, budget_tokens=9000)
    got = mixing.realise(slim, *mixing.draw_plan(slim, weights, block_tokens=100)).collect()
    place = {(e, r["source"], r["block"]): p for r in got for e, p in enumerate(r["places"])}
    orders = defaultdict(dict)
    for e, source in {k[:2] for k in place}:
        orders[e][source] = [b for _, b in sorted((p, k[2]) for k, p in place.items() if k[:2] == (e, source))]
    compared = 0
    for own in orders.values():
        for a, b in itertools.combinations(sorted(own, key=str), 2):
            common_blocks = set(own[a]) & set(own[b])
            if len(common_blocks) >= 6:
                compared += 1
                assert [x for x in own[a] if x in common_blocks] != [x for x in own[b] if x in common_blocks]
    assert compared


def test_places_order_every_epoch(spark):
    rows = sources()
    docs = documents(spark, rows)
    got = mixing.mix(docs, max_repetition=2.0).collect()
    blocks = defaultdict(set)
    for r in got:
        assert len(r["places"]) == r["copies"] and r["places"] == sorted(r["places"]) and all(0 <= p < mixing.PLACES for p in r["places"])
        for e, p in enumerate(r["places"]):
            assert math.floor(p / mixing.PLACES * max(r["epochs"], r["copies"]) + 1e-5) == e
            blocks[r["source"], r["block"], e, max(r["epochs"], r["copies"])].add(p)
    assert all(len(own) == 1 for own in blocks.values())  # a block stays together in its epoch
    ordered = mixing.mixed_corpus(docs).collect()
    assert [r["place"] for r in ordered] == sorted(p for r in got for p in r["places"])
    assert ordered[0].asDict().keys() - {"place"} == set(docs.columns)


def test_many_null_ids_keep_the_budgets(spark):
    rows = [(None, " ".join(["w"] * (1 + k % 30)) + f" {k}", "en", "big") for k in range(400)] + [(k, "some words here", "en", "small") for k in range(60)]
    slim = common.stored(mixing._tokens(documents(spark, rows, clash=False)), "t")
    weights = mixing.mixing_weights(mixing.source_shares(slim), 0.7, budget_tokens=5000)
    got = mixing.realise(slim, *mixing.draw_plan(slim, weights, block_tokens=200)).collect()
    mixed, quota = Counter(), {r["source"]: r["quota_tokens"] for r in weights.collect()}
    for r in got:
        mixed[r["source"]] += r["n_tokens"] * r["copies"]
    assert len(got) == 460 and len({r["block"] for r in got if r["doc_id"] is None}) > 10
    assert all(-40 <= mixed[s] - q <= 1e-3 for s, q in quota.items())


def test_mix_cases_and_stage(spark):
    docs = documents(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    assert sorted(r["n_tokens"] for r in got) == sorted(len(words(t)) for _, t, _, _ in ROWS)
    staged = mixing.mix_stage(docs)
    assert staged.columns == docs.columns
    copies = Counter(str(r["doc_id"]) for r in staged.collect())
    wanted = Counter()
    for r in got:
        wanted[str(r["doc_id"])] += r["copies"]
    assert copies == wanted and set(copies) == {str(r[0]) for r in ROWS}
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mix_stage(empty(spark)).count() == 0


def check_shards(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(sorted(x["slot"] for x in own) == list(range(len(own))) for own in by.values())
    return [sum(x["size"] for x in by.get(k, [])) for k in range(shards)]


def test_sharding_follows_the_contract(spark):
    rows = [(i, "x" * (i * 37 % 900), "en", "s") for i in range(6000)]
    got = virtual_slots.shard_documents(documents(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(6000))
    assert all(r["size"] == len(rows[r["doc_id"]][1]) + 8 and r["text_crc32"] == zlib.crc32(rows[r["doc_id"]][1].encode()) for r in got)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    loads = check_shards(got, 24)
    assert max(loads) - min(loads) <= 2 * 908


def test_sharding_cases(spark):
    got = virtual_slots.shard_documents(documents(spark)).collect()
    assert len(got) == len(ROWS) and sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 8 for _, t, _, _ in ROWS)
    check_shards(got, 24)
    assert virtual_slots.shard_documents(empty(spark)).count() == 0
    staged = virtual_slots.shard_stage(spark, documents(spark))
    assert len(staged.collect()) == len(ROWS) and {"shard", "slot", "vslot", "size", "text"} <= set(staged.columns)


def test_law_holds_with_repeated_and_null_ids(spark):
    same = [(7, "the same text", "en", "s")] * 1500 + [(7, f"text {k}", "en", "s") for k in range(1500)]
    rows = same + [(None, None, "en", "s")] * 900 + [(None, f"no id {k}", "en", "s") for k in range(900)] + [(100 + k, "x" * (k % 90), "en", "s") for k in range(2000)]
    got = virtual_slots.shard_documents(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    loads = check_shards(got, 24)
    assert max(loads) - min(loads) < 200
    staged = virtual_slots.shard_stage(spark, documents(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in staged) == sorted((str(i), t or "") for i, t, *_ in rows)
    loads = check_shards(staged, 24)
    assert max(loads) - min(loads) < 200


def slot_hashes(spark, rows):
    """Virtual slot and part of every record, copies of a record numbered in input order."""
    copies, keyed = Counter(), []
    for i, text in rows:
        keyed.append((len(keyed), "" if i is None else str(i), text, copies[i, text]))
        copies[i, text] += 1
    frame = spark.createDataFrame(keyed, "n int, id string, text string, copy long")
    hashed = {r["n"]: r["h"] for r in frame.select("n", F.xxhash64(F.xxhash64("id", F.xxhash64("text")), "copy").alias("h")).collect()}
    return [(hashed[n] % 4096, hashed[n] >> 40 & 63) for n in range(len(rows))]


def test_slots_and_shards_match_brute_force(spark):
    rows = [(i, "y" * (i * 53 % 700)) for i in range(3000)]
    got = virtual_slots.shard_documents(documents(spark, [(*r, "en", "s") for r in rows])).collect()
    hashes = slot_hashes(spark, rows)
    sizes, filled = Counter(), Counter()
    for (vslot, _), (_, text) in zip(hashes, rows, strict=True):
        sizes[vslot] += len(text) + 8
        filled[vslot] += 1
    shard_of, mean, moving, loads = {}, sum(sizes.values()) / 24, [], [0] * 24
    for s in range(24):
        own = sorted(range(s, 4096, 24), key=lambda k: (sizes[k], k))
        left = sum(sizes[k] for k in own)
        for k in own:
            if left > mean and filled[k]:
                moving.append(k)
            else:
                shard_of[k] = s
                loads[s] += sizes[k]
            left -= sizes[k]
    for k in sorted(moving, key=lambda k: (-sizes[k], k)):
        low = min(range(24), key=lambda s: (loads[s], s))
        shard_of[k] = low
        loads[low] += sizes[k]
    assert moving and len(moving) < 4096
    assert all(r["vslot"] == hashes[r["doc_id"]][0] and r["shard"] == shard_of[r["vslot"]] for r in got)
    counts = Counter()
    for r in sorted(got, key=lambda r: (r["shard"], *hashes[r["doc_id"]], r["doc_id"])):
        assert r["slot"] == counts[r["shard"]]
        counts[r["shard"]] += 1


def test_a_record_keeps_its_slot_in_any_table_and_partitioning(spark, monkeypatch):
    monkeypatch.setattr(virtual_slots, "BLOCK_BITS", 3)  # copies over many blocks
    few = [(5, "again")] * 40 + [(None, None)] * 60 + [(None, f"t{k}") for k in range(50)] + [(k, "same") for k in range(50)]
    more = few + [(1000 + k, "x" * (k % 50)) for k in range(4000)]

    def slots(rows, cut):
        frame = documents(spark, [(*r, "en", "s") for r in rows]).repartition(cut)
        staged = virtual_slots.shard_stage(spark, frame).collect()
        check_shards(staged, 24)
        return Counter((r["doc_id"], r["text"], r["vslot"]) for r in staged)

    found = slots(few, 1)
    wanted = Counter((i, t, v) for (i, t), (v, _) in zip(few, slot_hashes(spark, few), strict=True))
    assert found == wanted == slots(few, 7)
    grown = slots(more, 3)
    assert all(grown[k] == n for k, n in found.items())
    assert len({v for i, t, v in found if (i, t) == (5, "again")}) > 30


def test_rebalancing_edits_the_map(spark):
    stats = spark.createDataFrame([(k, 1000 if k % 6 == 0 else 10, 1) for k in range(600)], "vslot int, slot_bytes long, slot_rows long")
    old = virtual_slots.even_map(spark, 6, 600)
    new = virtual_slots.rebalanced_map(old, stats)
    assert (new.version, new.shards) == (2, 6)
    before, loads, moved = dict(old.current().select("vslot", "shard").collect()), Counter(), 0
    for r in new.current().collect():
        loads[r["shard"]] += r["slot_bytes"]
        moved += before[r["vslot"]] != r["shard"]
        assert before[r["vslot"]] in (0, r["shard"])  # only the full shard gives
    assert 0 < moved < 100 and max(loads.values()) - min(loads.values()) <= 1000
    none = virtual_slots.rebalanced_map(virtual_slots.even_map(spark, 6, 600), stats.withColumns({"slot_bytes": F.lit(0).cast("long"), "slot_rows": F.lit(0).cast("long")}))
    assert {r["vslot"]: r["shard"] for r in none.current().collect()} == before


def test_greedy_plan_is_longest_first(spark):
    rng = np.random.default_rng(8)
    sizes = rng.integers(0, 1000, 300).tolist()
    stats = spark.createDataFrame([(k, s, 1) for k, s in enumerate(sizes)], "vslot int, slot_bytes long, slot_rows long")
    got = {r["vslot"]: r["shard"] for r in virtual_slots.plan_slots(stats, 7).collect()}
    loads, wanted = [0] * 7, {}
    for k in sorted(range(300), key=lambda k: (-sizes[k], k)):
        low = min(range(7), key=lambda s: (loads[s], s))
        wanted[k] = low
        loads[low] += sizes[k]
    assert got == wanted


def test_growing_edits_the_map_toward_new_shards_only(spark):
    rng = np.random.default_rng(9)
    stats = spark.createDataFrame([(k, int(s), 1) for k, s in enumerate(rng.integers(1, 1000, 2000))], "vslot int, slot_bytes long, slot_rows long")
    old = virtual_slots.first_map(stats, 6)
    new = virtual_slots.grown_map(old)
    assert new.version == 2 and virtual_slots.SlotMap.load(spark, old.path, 1).current().count() == 2000
    again = virtual_slots.SlotMap.load(spark, old.path)  # the latest
    assert (again.version, again.shards) == (2, 7) and sorted(again.current().collect()) == sorted(new.current().collect())
    assert virtual_slots.grown_map(again).version == 3
    before = {r["vslot"]: r["shard"] for r in old.current().collect()}
    loads = Counter()
    for r in new.current().collect():
        assert r["shard"] in (before[r["vslot"]], 6)
        loads[r["shard"]] += r["slot_bytes"]
    assert len(loads) == 7 and max(loads.values()) < 1.1 * min(loads.values())


def brute_lines(rows):
    """Numbers of the lines that go, by (doc_id, text)."""
    docs = sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    earlier, out = [], {}
    for i, text in docs:
        gone = []
        for k, line in enumerate((text or "").split("\n")):
            own = {w for w in re.split("[\x20\x09-\x0d]+", line.lower()) if w}
            if own:
                if any(len(own & o) / len(own | o) >= 0.8 - 1e-12 for o in earlier):
                    gone.append(k)
                earlier.append(own)
        out[i, text] = gone
    return out


def test_lines_match_brute_force(spark):
    rng = np.random.default_rng(10)
    vocabulary = [f"v{k}" for k in range(60)]
    rows = [(r[0], r[1]) for r in ROWS]
    lines = [list(rng.choice(vocabulary, int(rng.integers(1, 14)))) for _ in range(60)]
    for i in range(100, 160):
        own = []
        for _ in range(6):
            line = list(lines[int(rng.integers(60))])
            if rng.random() < 0.6:
                line[int(rng.integers(len(line)))] = str(rng.choice(vocabulary))
            own.append(" ".join(line).upper() if rng.random() < 0.2 else "\t".join(line))
        rows.append((i, "\n".join(own)))
    docs = documents(spark, [(*r, "en", "s") for r in rows])
    wanted = brute_lines(rows)
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(rows)
    by_id = {i: gone for (i, _), gone in wanted.items()}
    assert all(r["removed_lines"] == by_id[r["doc_id"]] and r["n_removed"] == len(by_id[r["doc_id"]]) for r in got)
    kept = line_dedup.without_lines(docs, line_dedup.removed_lines(docs)).collect()
    for r in kept:
        text = next(t for i, t in rows if i == r["doc_id"])
        assert r["text"] == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in by_id[r["doc_id"]]) if by_id[r["doc_id"]] else text)


def test_lines_without_broadcasts_and_empty(spark, monkeypatch):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    whole = sorted((str(r["doc_id"]), r["kept_sha256"]) for r in line_dedup.dedup_lines(documents(spark)).collect())
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    assert sorted((str(r["doc_id"]), r["kept_sha256"]) for r in line_dedup.dedup_lines(documents(spark)).collect()) == whole


def test_pipeline_stages(spark, small):
    docs = common.read_table(spark, small, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        path = common.fresh_path(spark, "test")
        stage(spark, docs, small).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "sharding":
            assert after.columns == docs.columns
        if name == "source_mixing":
            assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
        docs = after
    assert docs.count() == corpus_pipeline.run(spark, small).count()
    assert docs.where(F.col("shard").isNull()).count() == 0


def shuffle_files():
    return {f for f in Path(tempfile.gettempdir()).glob("blockmgr-*/*/shuffle_*.data")}


def test_line_dedup_keeps_no_shuffle_files(spark):
    """What a stored table was made from goes with the write; the driver's garbage collection would come too late for the disk."""
    before = shuffle_files()
    rows = [(i, "\n".join(f"{i % 7} word{i * k} beside w{k} and five more here" for k in range(1, 9)), "en", "s") for i in range(400)]
    kept = spark.conf.get(common.SHUFFLE_CLEANUP, None)
    held = line_dedup.distinct_sets(documents(spark, rows))
    gone = line_dedup.matched_sets(held[1], documents(spark, rows))
    assert gone.count() < held[1].count()
    end = time.time() + 20
    # counting and sizing actions leave files of a few rows
    while (left := sum(f.stat().st_size for f in shuffle_files() - before if f.exists())) > 20_000 and time.time() < end:
        time.sleep(0.2)
    assert left <= 20_000
    assert spark.conf.get(common.SHUFFLE_CLEANUP, None) == kept


def test_prefix_rows_are_slim(spark):
    sets = line_dedup.distinct_sets(documents(spark, [(1, "a b c\na b d", "en", "s"), (2, "a b e\na f g", "en", "s")]))[1]
    name = line_dedup._shared_words(sets, 0.5)
    try:
        assert not {"sig2", "sig3", "sig4"} & set(spark.table(name).columns)
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_near_copies_that_are_not_alike_make_no_pairs(spark):
    """Lines of one base with 4 of 30 words of their own differ in 8 to 16 words, which is too many: none of their shared words pairs them."""
    rng, base = np.random.default_rng(3), [f"common{k}" for k in range(30)]

    def line(i, own):
        at = set(rng.choice(30, own, replace=False).tolist())
        return " ".join(f"own{i}x{k}" if k in at else w for k, w in enumerate(base))

    pairs = {}
    for own in (4, 1):
        docs = documents(spark, [(i, line(f"{own}y{i}", own), "en", "s") for i in range(40)])
        name = line_dedup._shared_words(line_dedup.distinct_sets(docs)[1], line_dedup.THRESHOLD)
        try:
            shared = spark.table(name).select("w", "id", "n", "at", "sig")
            met = shared.join(shared.select("w", F.struct("id", "n", "at", "sig").alias("y")), "w").where("y.id < id").where(line_dedup._first_shared("y", line_dedup.THRESHOLD))
            pairs[own] = met.select("id", "y.id").distinct().count()
        finally:
            spark.sql(f"DROP TABLE {name}")
    assert pairs == {4: 0, 1: 40 * 39 // 2}  # with one word of their own all pairs are alike
