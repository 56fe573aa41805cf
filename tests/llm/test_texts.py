"""Language model, token ids, media and piece counts."""

import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sablequery.llm import arrow_ids, hmm_lm, ogg, piece_counts

from .fixtures import ROWS, documents, empty, words


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def test_base_scores_match_the_formula(spark):
    rows = hmm_lm.score_documents(documents(spark), rounds=1).collect()
    counts = Counter()
    for i, text, _, _ in ROWS:
        if not held(i):
            counts.update([*words(text), "\n"])
    n, v = sum(counts.values()), len(counts)
    wanted = []
    for i, text, _, _ in ROWS:
        own = [*words(text), "\n"]
        base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        wanted.append((str(i), held(i), len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == sorted(wanted)
    assert hmm_lm.score_documents(empty(spark), rounds=1).count() == 0


def test_rare_words_join_gives_the_same_sums(spark, monkeypatch):
    whole = {str(r["doc_id"]): round(r["base_score"], 6) for r in hmm_lm.score_documents(documents(spark), rounds=1).collect()}
    monkeypatch.setattr(hmm_lm, "LEAST_COUNT", 10**9)  # every word is rare
    assert {str(r["doc_id"]): round(r["base_score"], 6) for r in hmm_lm.score_documents(documents(spark), rounds=1).collect()} == whole


def test_scores_are_probabilities_of_texts_with_rare_words(spark):
    long = "z" * 100
    rows = [(k, t, "en", "s") for k, t in enumerate(["a b a c", "b a", "c a b rare1", f"a b c {long}", "rare2 rare2 a", "b b", "a c", "b never a", f"{long} never never", None, "a", "b c a"])]
    docs = documents(spark, rows)
    counts = hmm_lm.count_tokens(docs.where(~hmm_lm.held_out()))
    alphabet = hmm_lm.make_alphabet(counts, size=2)
    encoded = hmm_lm.encode_texts(docs, alphabet)
    model, rare = hmm_lm.train(encoded, alphabet, states=2, rounds=2)
    known = {bytes(r["word"]): r["c"] for r in counts.collect()}
    expected = {bytes(r["word"]): (r["c"], hmm_lm.unpacked([np.array([r["p0"]])], np.array([r["c"]]), 2)[0]) for r in rare.table.collect()}
    got = {r["doc_id"]: r["score"] for r in hmm_lm.scores(encoded, model, rare, alphabet).collect()}
    assert len(alphabet.words) == 2
    # every training word outside the alphabet has its own expected counts, which add up to its tokens
    assert {w: c for w, (c, _) in expected.items()} == {w: c for w, c in known.items() if w not in (*alphabet.words, hmm_lm.END)}
    assert all(np.isclose(sum(e), c, rtol=1e-4) for c, e in expected.values())

    def weight(word, state, part):
        c, e = expected.get(word, (0, [0, 0]))
        own = c / (c + hmm_lm.SHRINK)
        return own * e[state] + ((1 - own) * c + 0.5) * part

    def emitted(word, state):
        if word in alphabet.words:
            return model.emit[alphabet.words.index(word), state]
        at = hmm_lm.bucket(word)
        inside = [w for w in expected if hmm_lm.bucket(w) == at]
        whole = [sum(expected[w][1][s] for w in inside) for s in range(2)]
        part = (whole[state] + 0.5) / (sum(whole) + 1)
        return model.emit[2 + at, state] * weight(word, state, part) / (sum(weight(w, state, part) for w in inside) + 0.5 * part)

    for i, text, *_ in rows:
        own, total = hmm_lm.tokens_of((text or "").encode()), 0.0
        for path in itertools.product(range(2), repeat=len(own) + 1):
            p = model.start[path[0]]
            for t, state in enumerate(path):
                p *= (model.move[path[t - 1], state] if t else 1) * (emitted(own[t], state) if t < len(own) else model.emit[-1, state])
            total += p
        assert np.isclose(got[i], np.log10(total), atol=1e-6)


def test_expected_counts_of_rare_words_are_those_of_the_recursion(spark):
    docs = documents(spark, [(k, t, "en", "s") for k, t in enumerate(["a x a y", "y a b x x", "b b a", "x", None, "a b a b z"] * 3)])
    alphabet = hmm_lm.make_alphabet(hmm_lm.count_tokens(docs), size=2)
    encoded = hmm_lm.encode_texts(docs, alphabet)
    model = hmm_lm.first_model(alphabet, 3)
    got = {bytes(r["word"]): hmm_lm.unpacked([np.array([r["p0"]])], np.array([r["c"]]), 3)[0] for r in hmm_lm.baum_welch_round(encoded, model, alphabet, keep=True)[2].collect()}
    wanted = {w: np.zeros(3) for w in (b"x", b"y", b"z")}
    for row in docs.collect():
        own = [*words(row["text"]), hmm_lm.END]
        own = [w.encode() if isinstance(w, str) else w for w in own]
        emit = np.array([model.emit[alphabet.words.index(w) if w in alphabet.words else -1 if w == hmm_lm.END else 2 + hmm_lm.bucket(w)] for w in own])
        weights = {}
        for path in itertools.product(range(3), repeat=len(own)):
            p = model.start[path[0]]
            for t, state in enumerate(path):
                p *= (model.move[path[t - 1], state] if t else 1) * emit[t, state]
            weights[path] = p
        for path, p in weights.items():
            for w, state in zip(own, path, strict=True):
                if w in wanted:
                    wanted[w][state] += p / sum(weights.values())
    assert got.keys() == wanted.keys() and all(np.allclose(got[w], wanted[w], rtol=1e-3, atol=3e-4) for w in wanted)


def test_likelihood_rises_and_partitioning_does_not_matter(spark):
    rng = np.random.default_rng(4)
    kinds = ["alpha beta gamma delta epsilon".split(), "uno dos tres cuatro cinco".split()]
    docs = documents(spark, [(i, " ".join(rng.choice(kinds[i % 2], 40)), "en", "s") for i in range(200)])
    counts = hmm_lm.count_tokens(docs)
    alphabet = hmm_lm.make_alphabet(counts)
    model, logs = hmm_lm.first_model(alphabet, 4), []
    encoded = hmm_lm.encode_texts(docs, alphabet)
    for _ in range(5):
        model, log, _ = hmm_lm.baum_welch_round(encoded, model, alphabet)
        logs.append(log)
    assert logs == sorted(logs) and logs[-1] > logs[0] + 100
    one = {r["doc_id"]: r["score"] for r in hmm_lm.score_documents(docs.repartition(1), states=4).collect()}
    many = {r["doc_id"]: r["score"] for r in hmm_lm.score_documents(docs.repartition(7), states=4).collect()}
    assert all(np.isclose(one[i], many[i], rtol=1e-3) for i in one)


def test_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(2)
    model = hmm_lm.Model(rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 5, 3).T)
    texts = [[0, 3, 4], [1], [2, 2, 0, 1, 4]]
    wanted = []
    for text in texts:
        total = 0.0
        for path in itertools.product(range(3), repeat=len(text)):
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for t in range(1, len(text)):
                p *= model.move[path[t - 1], path[t]] * model.emit[text[t], path[t]]
            total += p
        wanted.append(np.log10(total))
    got = hmm_lm.log10_likelihood(model, np.concatenate(texts), np.array([len(t) for t in texts]))
    assert np.allclose(got, wanted)
    starts, moves, emissions, logs = hmm_lm.expected_counts(model, np.concatenate(texts), np.array([len(t) for t in texts]))
    assert np.isclose(starts.sum(), 3, atol=1e-4) and np.isclose(moves.sum(), 6, atol=1e-4) and np.isclose(emissions.sum(), 9, atol=1e-4)
    assert np.isclose(logs / np.log(10), sum(wanted), atol=1e-4)


def test_emissions_are_a_distribution_over_words_and_the_unseen(spark):
    counts = hmm_lm.count_tokens(documents(spark))
    alphabet = hmm_lm.make_alphabet(counts, size=5)
    all_counts = {bytes(r["word"]): r["c"] for r in counts.collect()}
    assert len(alphabet.words) == 5 and np.isclose(alphabet.unigram().sum(), 1)
    rare = {w: c for w, c in all_counts.items() if w not in alphabet.words and w != hmm_lm.END}
    sums = np.full(hmm_lm.BUCKETS, 0.5)
    for w, c in rare.items():
        sums[hmm_lm.bucket(w)] += c + 0.5
    assert np.allclose(sums, alphabet.bucket_sums)


def test_model_beats_unigrams_on_unseen_documents(spark, small):
    rng = np.random.default_rng(4)
    kinds = ["alpha beta gamma delta epsilon".split(), "uno dos tres cuatro cinco".split()]
    rows = [(i, " ".join(rng.choice(kinds[i % 2], 40)), "en", "s") for i in range(300)]
    scored = hmm_lm.score_documents(documents(spark, rows), states=4).where("held_out").collect()
    assert sum(r["score"] for r in scored) > 0.85 * sum(r["base_score"] for r in scored)


def test_ids_match_the_library_and_files_give_random_access(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    got = arrow_ids.encode_and_read_back(spark, documents(spark), path, length=64).collect()
    at, wanted = 0, []
    for i, text, _, _ in sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        wanted.append((str(i), at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((str(r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(wanted)
    one = max(got, key=lambda r: r["n_tokens"])["path"]
    with arrow_ids.SequenceReader(one) as reader:
        first, held = reader.ids(0, 500), pa.total_allocated_bytes()
        views = [reader.sequence(k) for k in (0, 3, 6)]
        assert pa.total_allocated_bytes() == held and not any(ids.flags.owndata or ids.flags.writeable for ids, _ in views)  # slices of the mapped file
        assert all(ids.tolist() == first[64 * k : 64 * k + 64].tolist() and mask.true_count == 64 for k, (ids, mask) in zip((0, 3, 6), views, strict=True))
        assert reader.ids(10, 5).tolist() == first[10:15].tolist()
    store, base = arrow_ids._open(one)
    with store.open_input_file(f"{base}.ids.arrow") as source:
        schema = pa.ipc.open_file(source).schema
    assert pa.types.is_fixed_size_list(schema.field("ids").type) and schema.field("mask").type.list_size == 64
    assert arrow_ids.encode_and_read_back(spark, empty(spark), path).count() == 0


def test_many_rows_of_one_id_are_dealt_to_several_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(None, f"no id {k}", "en", "s") for k in range(300)] + [(7, "same", "en", "s")] * 300
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would become one partition
    try:
        got = sorted(arrow_ids.encode_and_read_back(spark, documents(spark, rows), path, length=16).collect(), key=lambda r: r["start"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 600 and len({r["path"] for r in got if r["doc_id"] == 7}) > 1
    assert [r["doc_id"] for r in got] == [None] * 300 + [7] * 300
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))


def test_encoder_cuts_like_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = arrow_ids.Encoder(path, "<u2", 2)
    odd = ["a  b", " a", "a ", "\n a\n\nb \n c", "don't stop", "x y z", "tab\tz", "", " ", "  ", "né é", "<|endoftext|> x", "a b", "it 's 12 34", None]
    ids, sizes = coder.encode(pa.array(odd, pa.string()))
    wanted = [[*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in odd]
    assert ids.tolist() == sum(wanted, []) and sizes.tolist() == [len(w) for w in wanted]


def test_media_round_trip(spark):
    rows = ogg.media_features(ogg.store_media(documents(spark))).collect()
    wanted = []
    for i, text, _, _ in ROWS:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        wanted.append((str(i), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted((str(r["doc_id"]), *r[1:5]) for r in rows) == sorted(wanted)
    by = {r["doc_id"]: r for r in rows}
    assert by[10]["media_sha256"] == by[11]["media_sha256"] and by[10]["feature"] == by[11]["feature"]
    assert ogg.media_features(ogg.store_media(empty(spark))).count() == 0


def slow_checksum(page):
    register = 0
    for byte in page:
        register ^= byte << 24
        for _ in range(8):
            register = (register << 1 ^ (0x04C11DB7 if register >> 31 else 0)) & 0xFFFFFFFF
    return register


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=400))
def test_checksum_is_the_bitwise_one(data):
    assert ogg.page_checksum(data) == slow_checksum(data)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), min_size=1, max_size=6), st.integers(0, 2**32 - 1))
def test_packets_survive_any_lacing(sizes, serial):
    packets = [(bytes([k % 251]) * n, k) for k, n in enumerate(sizes)]
    other = [(b"side", 0), (b"", 9)]
    one, two = ogg.write_stream(packets, serial), ogg.write_stream(other, serial ^ 1)
    mixed = b"".join(p for pair in itertools.zip_longest(one, two, fillvalue=b"") for p in pair)
    streams = ogg.read_streams(mixed)
    assert streams[serial].packets == [p for p, _ in packets] and streams[serial ^ 1].packets == [b"side", b""]


def test_damage_is_found():
    media = bytearray(ogg.encode_media(b"some text to keep " * 200))
    for at in range(0, len(media), 97):
        broken = bytes(media[:at]) + bytes([media[at] ^ 1]) + bytes(media[at + 1 :])
        with pytest.raises(ogg.OggError):
            ogg.decode_media(broken)
    with pytest.raises(ogg.OggError):
        ogg.decode_media(bytes(media[:-5]))


def greedy(pieces, symbols):
    at = n = 0
    while at < len(symbols):
        end = next((e for e in range(len(symbols), at, -1) if tuple(symbols[at:e]) in pieces), None)
        if end is None:
            return None
        at, n = end, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.lists(st.integers(0, 2), min_size=1, max_size=5).map(tuple), max_size=12), st.lists(st.integers(0, 2), max_size=14))
def test_automaton_counts_like_greedy(pieces, symbols):
    assert piece_counts.LongestMatch(sorted(pieces)).count(symbols) == greedy(pieces, symbols)


def test_piece_counts_of_documents(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = set(piece_counts.vocabulary_pieces(path))
    rows = piece_counts.count_pieces(documents(spark), path).collect()
    wanted = []
    for i, text, _, _ in ROWS:
        own = [greedy(pieces, (*w.encode(), piece_counts.END)) or 1 for w in words(text)]
        wanted.append((str(i), len(own), sum(own), max(own, default=0)))
    assert sorted((str(r["doc_id"]), *r[1:]) for r in rows) == sorted(wanted)
    assert piece_counts.count_pieces(empty(spark), path).count() == 0


@settings(deadline=None, max_examples=40)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cc", "Zs", "Zl", "Zp"]) | st.just("\n"), max_size=8), max_size=40, unique=True))
def test_pieces_in_one_text_have_their_own_ids(pieces):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = arrow_ids.encoder(path, arrow_ids.id_type(path), 0)
    pieces = [*pieces, "", "\n", "a\n", "\nb", "c\nd", "don't", "'s", "9" * 30]
    assert coder.together(pieces) == coder.whole([f" {p}" for p in pieces])


def test_new_pieces_share_texts(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = arrow_ids.Encoder(path, arrow_ids.id_type(path), 0)
    given_texts, whole = [], coder.whole
    monkeypatch.setattr(coder, "whole", lambda texts: given_texts.extend(texts) or whole(texts))
    text = " ".join(f"word{k}" for k in range(5000))
    ids, sizes = coder.encode(pa.array([text]))
    assert ids[:-1].tobytes() == whole([text])[0] and sizes.tolist() == [len(ids)]
    assert len(given_texts) < 100  # one for each piece before
