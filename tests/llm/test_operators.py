"""Operators against the plain Python contracts, on the smallest tables and on hard rows."""

import time

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import FOLDER, pairs
from pyspark.sql import functions as F

from trialweave.llm import (
    arrays,
    chat,
    decontaminate,
    exchange,
    ngram_join,
    pieces,
    pii,
    quality_classifier,
    quality_rules,
    queries,
    secret_scan,
    substring_dedup,
    warc,
)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("table", ["documents", "hard"])
def test_ngram_join(request, table):
    df = request.getfixturevalue(table)
    assert set(rows(ngram_join.ngram_join(df))) == brute.ngram_join(pairs(df))


def test_ngram_join_compares_all_texts_of_a_repeated_id(spark):
    texts = [" ".join(f"{kind}{k}" for k in range(60)) for kind in "ab"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0] + " end"), (3, texts[1] + " end")]
    found = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {1}


def test_ngram_join_ties_all_texts_of_repeated_ids(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}
    data = [(1, "a"), (2, "b"), (3, "c"), (5, "a"), (5, "b"), (5, "c"), (9, "d"), (9, "e"), (9, "f"), (4, "f"), (6, "e"), (None, "d"), (None, "f")]
    data = [(d, text[k]) for d, k in data]
    df = spark.createDataFrame(data, "doc_id long, text string")
    low = [(-(2**63) if d is None else d, t) for d, t in data]
    want = {(None if d == -(2**63) else d, n, None if c == -(2**63) else c) for d, n, c in brute.ngram_join(low)}
    assert set(rows(ngram_join.ngram_join(df))) == want


def test_ngram_join_of_long_texts_and_near_misses(spark):
    """Sets of thousands of shingles under common keys; texts that just miss the limit, and chains of links."""
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(2500)]
    data = []
    for k in range(14):
        t = list(base)
        for at in rng.choice(2500, 30 + 12 * k, replace=False):
            t[at] = f"c{k}x{at}"
        data.append((200 - k, " ".join(t)))
    chain = [f"d{i}" for i in range(80)]
    for k in range(10):
        chain = chain[4:] + [f"e{k}x{i}" for i in range(4)]
        data.append((300 + k, " ".join(chain)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert set(rows(ngram_join.ngram_join(df))) == brute.ngram_join(data)


def test_ngram_join_finds_links_that_no_smallest_member_has(spark):
    base = [f"b{i}" for i in range(60)]
    texts = [list(base)]
    for k in range(12):  # each linked with the base alone
        t = list(base)
        t[5 * k % 50] = f"c{k}"
        texts.append(t)
    df = spark.createDataFrame([(100 - i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert set(rows(ngram_join.ngram_join(df))) == brute.ngram_join(pairs(df))


def test_ngram_join_links_a_near_copy_of_many_copies(spark):
    base = [f"b{i}" for i in range(60)]
    near = base[:30] + ["changed"] + base[31:]
    data = [(i, " ".join(base)) for i in range(1, 81)] + [(100, " ".join(near))]
    df = spark.createDataFrame(data, "doc_id long, text string").coalesce(2)
    assert set(rows(ngram_join.ngram_join(df))) == brute.ngram_join(data)


def test_drop_copies_keeps_the_smallest(hard):
    kept = ngram_join.drop_copies(hard)
    assert kept.columns == hard.columns
    want = {c for _, _, c in brute.ngram_join(pairs(hard))}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_drop_copies_keeps_unlinked_texts_of_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{kind}{k}" for k in range(60)) for kind in "abc")
    rows_ = [(1, a), (1, b), (2, b + " end"), (None, c), (None, c + " end"), (None, "other words"), (None, None), (3, None), (3, None), (42, "x")]
    kept = ngram_join.drop_copies(spark.createDataFrame(rows_, "doc_id long, text string"))
    want = [(1, a), (1, b), (None, c), (None, "other words"), (None, None), (3, None), (42, "x")]
    assert rows(kept) == sorted(want, key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (100, 95), (7, 7)]
    got = exchange.components(spark.createDataFrame(edges, "a long, b long"))
    assert rows(got) == sorted([(i, 0) for i in range(41)] + [(90, 90), (95, 90), (100, 90)], key=repr)


@pytest.mark.parametrize("table", ["documents", "hard"])
def test_substring_dedup(request, table):
    df = request.getfixturevalue(table)
    assert set(rows(substring_dedup.substring_dedup(df))) == brute.substring_dedup(pairs(df))


def test_substring_dedup_without_ids(spark):
    """Texts without ids have places of their own; the number of places grows with the texts."""
    passage = " ".join(f"p{i}" for i in range(40))

    def table(n):
        return spark.createDataFrame([(None, f"a{i} b{i} {passage} c{i}") for i in range(n)] + [(3, passage), (3, passage + " x")], "doc_id long, text string")

    df = table(30)
    low = [(-(2**63) if d is None else d, t) for d, t in pairs(df)]
    want = {(None if r[0] == -(2**63) else r[0], *r[1:]) for r in brute.substring_dedup(low)}
    assert set(rows(substring_dedup.substring_dedup(df))) == want
    found = []
    for n in (40, 80):
        docs = table(n).withColumn("text_hash", F.xxhash64("text"))
        anchors = substring_dedup.repeated_anchors(docs)
        bits = exchange.bitmap(anchors, "doc")
        near = substring_dedup._with_places(docs, anchors, bits, "inner")
        found.append(near.agg(F.sum(F.size("places"))).first()[0])
    assert found[1] < 2.2 * found[0]


def test_substring_dedup_text(hard):
    kept = {r.doc_id: r.kept for r in substring_dedup.substring_dedup(hard, as_text=True).collect()}
    assert kept[10] == "head" and kept[11] == "" and kept[4] == "one two"


@pytest.mark.parametrize("table", ["documents", "hard"])
@pytest.mark.parametrize("find, spans, kinds", [(pii.find_pii, brute.pii_spans, pii.BASE), (secret_scan.find_secrets, brute.secret_spans, secret_scan.BASE)])
def test_spans(request, table, find, spans, kinds):
    df = request.getfixturevalue(table)
    want = []
    for d, t in pairs(df):
        own = spans(t)
        want.append((d, *(sum(s[0] == k for s in own) for k in kinds), brute.digest(brute.shown(own, list(kinds)))))
    got = find(df).collect()
    assert sorted(tuple(r)[: len(kinds) + 2] for r in got) == sorted(want)
    for r, t in zip(sorted(got), sorted(pairs(df), key=lambda x: x[0])):
        assert {f"{k}:{a}:{b}" for k, a, b in spans(t[1])} <= set(r.spans.split(",")) | {""}


def test_pii_needs_checksum_or_context():
    assert pii.spans_of("iban GB82WEST12345698765432 x")[1] == [("iban", 5, 27)]
    assert pii.spans_of("GB82WEST12345698765431")[1] == []
    assert pii.spans_of("ssn 078-05-1120")[1] == [("ssn", 4, 15)] and pii.spans_of("no 078-05-1120")[1] == []
    assert pii.redacted("to a@b.co now", [("email", 3, 9)]) == "to [EMAIL] now"


def test_context_words_are_whole_words():
    number = "415-555-0100"
    for text in (f"the hotel number {number}", f"locally {number}", f"a stellar {number}", f"{number} telling", f"{number} a phoned friend"):
        assert pii.spans_of(text) == ([], [])
    for text in (f"Tel.: {number}", f"tel{number}", f"{number} (phone)", "x" * 60 + f" call {number}", f"{number}" + " " * 35 + "phone"):
        at = text.index(number)
        assert pii.spans_of(text)[1] == [("phone", at, at + len(number))]
    assert pii.spans_of(f"{number}" + " " * 36 + "phone") == ([], [])


def test_iban_ends_before_words_and_numbers():
    grouped = "GB82 WEST 1234 5698 7654 32"
    for text in (f"pay {grouped} EUR", f"pay {grouped} 2024 NOW", f"pay XY34 {grouped} DE89 3704 0044 0532 0130 00 EUR"):
        a = text.index(grouped)
        found = pii.spans_of(text)[1]
        assert ("iban", a, a + len(grouped)) in found
    assert [text[a:b] for k, a, b in found if k == "iban"] == [grouped, "DE89 3704 0044 0532 0130 00"]


def test_redact_keeps_columns(hard):
    out = pii.redact(hard)
    assert out.columns == hard.columns and out.where("text is null").count() == 1
    assert "[EMAIL]" in out.where("doc_id = 12").first().text


def test_secrets_scores_all_candidates():
    """Short runs, runs without a digit, dotted ones and the rests of covered runs are candidates."""
    text = "a.b-c token=abcdef1 see shortie, Zq.Xw-Vk. AKIA" + "B" * 16 + "-restOfRun"
    base = secret_scan.base_spans(text)
    got = [text[a:b] for a, b in secret_scan.candidates(text, base)]
    assert got == ["shortie", "Zq.Xw-Vk", "restOfRun"] or got == ["shortie", "Zq.Xw-Vk"]
    assert not any(x < b and a < y for a, b in secret_scan.candidates(text, base) for _, x, y in base)


def test_secrets_finds_unlabelled_credentials(spark):
    rng = np.random.default_rng(8)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")

    def key(n):
        return "".join(rng.choice(letters, n))

    plain = ["".join(rng.choice(list("etaoinshr"), rng.integers(6, 12))) for _ in range(400)]
    texts = [(i, " ".join(rng.choice(plain, 30)) + f" password={key(20)}") for i in range(120)]
    hidden = [key(20) for _ in range(40)]
    texts += [(200 + i, " ".join(rng.choice(plain, 30)) + f" {h} end") for i, h in enumerate(hidden)]
    found = {r.doc_id: r.spans for r in secret_scan.find_secrets(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    caught = sum("token" in found[200 + i] for i in range(40))
    assert caught >= 38 and sum("token" in found[i] for i in range(120)) <= 2


def test_secrets_learns_from_all_values(spark):
    """The probabilities are those of every distinct value, run through the states."""
    rng = np.random.default_rng(4)
    values = ["".join(rng.choice(list("abc123XYZ"), rng.integers(8, 14))) for _ in range(900)]
    words = ["".join(rng.choice(list("etaoinshr"), rng.integers(6, 9))) for _ in range(700)]
    rows = [(i, f"password={v} {words[i % 700]}") for i, v in enumerate(values)]
    got = secret_scan.train(spark.createDataFrame(rows, "doc_id long, text string"))
    end = secret_scan.SYMBOLS
    for learned, strings in ((got.credentials, set(values)), (got.ordinary, set(words))):
        counts = np.zeros((len(learned.ends), end + 1))
        for v in strings:
            state = 0
            for c in secret_scan.classes_of(v):
                counts[state, c] += 1
                state = learned.moves[state][c][0]
            counts[state, end] += 1
        for state, c in enumerate(counts):
            assert np.isclose(learned.ends[state], np.log((c[end] + 1) / (c.sum() + end + 1)))
            assert all(np.isclose(p, np.log((c[s] + 1) / (c.sum() + end + 1))) for s, (_, p) in learned.moves[state].items())


def test_automaton_prefers_its_language():
    learned = secret_scan.learn([secret_scan.classes_of("ab12" * k) for k in range(3, 9)] * 5)
    assert learned.score(secret_scan.classes_of("cd34" * 5)) > learned.score(secret_scan.classes_of("zzzzzzzzzz"))
    assert len(learned.ends) < 20


@pytest.mark.parametrize("table", ["documents", "hard"])
def test_quality_rules(request, table):
    df = request.getfixturevalue(table)
    got = quality_rules.quality_rules(df).collect()
    want = sorted((d, *brute.rules(t)) for d, t in pairs(df))
    assert sorted(tuple(r)[:7] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


@pytest.mark.parametrize("table", ["documents", "hard"])
def test_perplexity_is_of_word_pairs(request, table):
    """Against a plain modified Kneser-Ney model of the words of all texts."""
    df = request.getfixturevalue(table)
    got = quality_rules.quality_rules(df).collect()
    want = brute.perplexities([t for _, t in pairs(df)])
    found = sorted((r.doc_id, r.log_perplexity) for r in got)
    expected = sorted((d, x) for (d, _), x in zip(pairs(df), want))
    assert [d for d, _ in found] == [d for d, _ in expected]
    assert max(abs(a - b) for (_, a), (_, b) in zip(found, expected)) < 0.0011


def test_pairs_take_little_room():
    """Pairs of frequent words travel in less than half of their hashes' 16 bytes."""
    rng = np.random.default_rng(4)
    table = np.unique(rng.integers(1, 2**63, 5000, dtype=np.uint64))
    before, word = (rng.choice(table, 100000) for _ in range(2))
    key = quality_rules.mix(before * quality_rules._ODD ^ word)
    sent = quality_rules._sent(before, word, key, [np.ones(100000, np.uint32)], table, 24)
    assert sum(len(blob) for _, blob in sent) < 8 * 100000


def test_packed_pairs_come_back():
    rng = np.random.default_rng(2)
    vocabulary = rng.integers(2, 2**63, 500, dtype=np.uint64)
    table = np.union1d(vocabulary[:200], [quality_rules.START])
    before, word = (rng.choice(vocabulary, 3000) for _ in range(2))
    before[::7] = quality_rules.START
    times = rng.integers(1, 9, 3000).astype(np.uint32)
    key = quality_rules.mix(before * quality_rules._ODD ^ word)
    back = []
    for bucket, blob in quality_rules._sent(before, word, key, [times], table, 7):
        x, y, n = quality_rules._received(blob, table, np.uint32)
        assert (quality_rules.mix(x * quality_rules._ODD ^ y) % np.uint64(7) == bucket).all()
        back += zip(x, y, n)
    assert sorted(back) == sorted(zip(before, word, times))


def test_fast_hashes_are_of_words():
    """One hash for equal words wherever they start, another for other words, up to long ones; in less time than byte by byte."""
    rng = np.random.default_rng(6)
    plain = ["".join(rng.choice(list("abé\0"), n)) for n in rng.integers(1, 40, 3000)] + ["a" * n for n in range(1, 30)] + ["\0" * n for n in range(1, 30)]
    nothing = arrays.texts_of(pa.array(["", None, " "]))
    texts = arrays.texts_of(pa.array(["", *(" ".join(rng.choice(plain, 400)) for _ in range(300)), "x" * 100000, " ".join(plain), " "]))
    words = arrays.words_of(texts)
    fast = arrays.fast_words_of(texts)
    assert all((x == y).all() for x, y in [(words.start, fast.start), (words.end, fast.end), (words.at, fast.at)])
    found = [texts.data[a:b].tobytes() for a, b in zip(words.start, words.end)]
    hashes = arrays.fast_word_hashes(texts, words)
    assert len(set(found)) == len(set(hashes.tolist())) == len(set(zip(found, hashes.tolist()))) > 2000
    assert not len(arrays.fast_word_hashes(nothing, arrays.words_of(nothing)))

    def seconds(f):
        began = time.process_time()
        f(texts, words)
        return time.process_time() - began

    assert min(seconds(quality_rules.fast_word_hashes) for _ in range(7)) < min(seconds(arrays.word_hashes) for _ in range(7))


def test_codes_of_words_that_begin_alike():
    rng = np.random.default_rng(7)
    alike = np.uint64(5 << 44) + np.arange(50, dtype=np.uint64)
    table = np.unique(np.r_[quality_rules.START, alike[::2], rng.integers(2, 2**63, 20000, dtype=np.uint64)])
    words = np.r_[rng.choice(table, 5000), alike, rng.integers(2, 2**63, 5000, dtype=np.uint64), quality_rules.START]
    code = {w: k for k, w in enumerate(table.tolist(), 1)}
    assert quality_rules._codes(words, table, quality_rules._slots(table)).tolist() == [code.get(w, 0) for w in words.tolist()]


def test_packed_numbers_come_back():
    """Whole numbers of any size and sign; zeros in front take no room before compression."""
    columns = [np.zeros(0, np.uint16), np.zeros(9, np.int64), np.array([-1, 0, 2**62]), np.arange(70000, dtype=np.uint64), np.array([2**64 - 1, 0], np.uint64)]
    back = quality_rules._arrays(quality_rules._blob(*columns), *(c.dtype for c in columns))
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(columns, back))
    packed = quality_rules._blob(np.arange(70000, dtype=np.uint64))
    assert int.from_bytes(packed[8:16], "little") == 3 * 70000


def test_perplexity_sees_other_scripts(spark):
    """Texts of equal letter classes but shuffled words differ."""
    words = ["молоко", "золото", "корова", "болото", "колесо", "полено"]
    rng = np.random.default_rng(5)
    usual = " ".join(words * 12)
    texts = [(i, usual, "ru") for i in range(30)] + [(40, " ".join(rng.permutation(words * 12)), "ru")]
    got = {r.doc_id: r.log_perplexity for r in quality_rules.quality_rules(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect()}
    assert got[40] > 2 * got[0]


def test_bands_change_without_a_step(spark):
    """One text more never moves a rare language's band far."""
    def ends(n):
        data = [("en", 2000 + i % 100, 60) for i in range(500)] + [("xx", 2600 + i % 40, 60) for i in range(n)]
        measured = spark.createDataFrame(data, "lang string, log_perplexity long, n_words long")
        return {r.lang: (r.low, r.high) for r in quality_rules.bands(measured).collect()}

    before, after, common = ends(19), ends(20), ends(4000)
    assert abs(before["xx"][1] - after["xx"][1]) < 25 and before["xx"][1] > before["en"][1]
    assert common["xx"][0] > 2300


def test_rare_language_rejects_junk(spark):
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("etaoin"), 5)) for _ in range(200)]
    texts = [(i, " ".join(rng.choice(plain, 60)), "en") for i in range(40)] + [(40, " ".join(rng.choice(plain, 60)), "yy")]
    junk = " ".join("".join(rng.choice(list("QXZKVJqxzkvj0123#!"), 6)) for _ in range(60))
    df = spark.createDataFrame([*texts, (41, junk, "xx"), (42, junk[::-1], None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in quality_rules.quality_rules(df).collect() if not r.kept] == [41, 42]


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(1)
    gram = np.unique(rng.integers(0, 64**4, 3000))
    p = np.exp(quality_rules.log_table(quality_rules.kneser_ney(gram, rng.integers(1, 9, len(gram)))).astype(float))
    assert np.allclose(p.reshape(-1, 64).sum(1), 1, atol=1e-5)


def test_classifier_agrees_with_labels(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r.kept for r in quality_classifier.classify(docs).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.doc_id in got}
    right = sum(got[d] == bool(q) for d, q in labels.items())
    assert right / len(labels) > 0.97
    assert sum(not got[d] for d, q in labels.items() if q) <= 0.01 * len(labels)


def test_classifier_trains_without_ids(spark):
    texts = [" ".join(f"word{(i * k) % 97} is" for k in range(40)) for i in range(30)] + ["##|| " * 60 + str(i) for i in range(10)]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = [r.kept for r in quality_classifier.classify(df).collect()]
    assert len(got) == 40 and not any(got[30:])
    assert quality_classifier.keep_good(df).count() == sum(got)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.7])
    votes = np.where(rng.random((20000, 7)) < accuracy, good[:, None], ~good[:, None]).astype(int)
    pattern, n = np.unique(quality_classifier.patterns(votes), return_counts=True)
    assert np.abs(quality_classifier.fit_labels(pattern, n).accuracies() - accuracy).max() < 0.03


def test_keep_good_keeps_columns(hard):
    assert quality_classifier.keep_good(hard).columns == hard.columns


def test_pieces_equal_the_library_and_round_trip(documents, hard):
    import sentencepiece

    path = queries.vocabulary_path()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t for _, t in pairs(documents) + pairs(hard)] + ["Hello  world\n  def f(x): return 1,000", "😀 zzz", " a "]
    encoder = pieces.Encoder(pieces.load(path))
    got = pieces.encode_texts(texts, encoder)
    for t, a, b in zip(texts, got.at, got.at[1:]):
        if "▁" not in (t or ""):
            assert got.id[a:b].tolist() == model.encode(t or "")
    assert pieces.decode_ids(got, encoder.v) == [(t or "").encode() for t in texts]
    assert pieces.round_trip(hard, path).where("not exact").count() == 0
    back = pieces.decode(pieces.encode(hard, path), path)
    assert rows(back.select("doc_id", "text").na.fill("")) == rows(hard.select("doc_id", "text").na.fill(""))


def test_decontamination_catches_reordered_passages(spark, hard):
    items = spark.createDataFrame(
        [(1, "the quick brown fox jumps over the lazy dog near a river"), (2, "one two"), (3, None)], "item_id long, text string"
    )
    docs = spark.createDataFrame(
        [(1, "x Over The lazy dog near! y THE quick-brown fox jumps z"), (2, "the quick brown fox"), (3, None), (4, "")],
        "doc_id long, text string",
    )
    assert [tuple(r) for r in decontaminate.find_contaminated(docs, items).collect()] == [(1, 1, 2, 10, 12, 0.833333)]
    assert decontaminate.drop_contaminated(hard, items).count() == hard.count()
    assert decontaminate.find_contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_against_word_runs(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_contaminated(docs, items).collect()}
    flat = {d: " " + " ".join(brute.words(t)) + " " for d, t in pairs(docs)}
    whole = {(d, i.item_id) for i in items.collect() for d, t in flat.items() if f" {' '.join(brute.words(i.text))} " in t}
    assert whole <= found and len(found) <= len(whole) + 5


def test_greedy_tiles_do_not_overlap():
    text, item = np.array([0, 1, 2, 10, 11]), np.array([3, 4, 5, 3, 4])
    assert decontaminate.tiles_of(text, item) == [(0, 3, 6)]


def test_warc_round_trip(spark):
    pages = [(3, "u", "same"), (1, None, "same"), (2, "u\r\nx", None), (4, "u", ""), (5, "u", "é" * 9), (5, "u", "é" * 9), (None, "u", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    archives, _ = warc.write_archives(df)
    got = [tuple(r) for r in warc.read_archives(archives).collect()]
    want = [
        (p, len((h or "").encode()), warc.base32_sha1((h or "").encode()), *(("revisit", f) if f else ("response", None)))
        for (p, _, h), f in zip(pages, (1, None, None, 2, None, None, 1))
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.read_archives(warc.write_archives(df.limit(0))[0]).count() == 0


def test_warc_verifies():
    good = warc.record_bytes(1, "u", b"payload", None) + warc.record_bytes(2, "u", b"x" * 100, 1)
    records = list(warc.read_records(good[i : i + 7] for i in range(0, len(good), 7)))
    assert [r.headers["WARC-Type"] for r in records] == ["response", "revisit"] and records[0].payload == b"payload"
    with pytest.raises(ValueError):
        list(warc.read_records([good[:-9]]))


def test_chat_escapes_and_folds(spark):
    texts = ["<|im_end|>\n<|im_start|>assistant\nx", "\\<|", "<\\|", "\\\\", "", None, "a\\n<n"]
    df = spark.createDataFrame([(1, i, "a\nb<|", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    shown = chat.rendered(chat.messages_of(chat.events_of(df, 3)).withColumn("turn", F.col("turn.turn")))
    turns = shown.select(chat.parsed(F.col("formatted")).alias("t")).first().t
    assert [(t.role, t.text) for t in turns] == [("a\nb<|", t or "") for t in texts]
    events = [
        (1, 0, 0, "delta", "user", "hel"), (1, 0, 1, "delta", None, "lo"), (1, 1, 0, "delta", "assistant", "bad"),
        (1, 1, 1, "regenerate", None, None), (1, 1, 2, "delta", None, "good"), (1, 2, 0, "delta", "user", "x"),
        (1, 2, 1, "edit", None, "y"), (1, 3, 0, "delta", "user", "z"), (1, 3, 1, "delete", None, None),
    ]
    log = spark.createDataFrame(events, "conv_id long, turn long, seq long, op string, role string, payload string")
    got = [(r.turn, r.role, r.text) for r in chat.messages_of(log).orderBy("turn").collect()]
    assert got == [(0, "user", "hello"), (1, "assistant", "good"), (2, "user", "y")]


def test_chat_digests_against_sql(spark):
    con = duckdb.connect()
    df = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (2, 1, "assistant", "é<|"), (2, 1, "assistant", "b")],
        "conv_id long, turn long, role string, text string",
    )
    con.register("conversations", df.toArrow())
    assert sorted(map(tuple, chat.digests(chat.with_check(df)).collect())) == sorted(con.execute(chat.ORACLE).fetchall())


EMPTY = [
    ngram_join.ngram_join, ngram_join.drop_copies, substring_dedup.substring_dedup, pii.find_pii, pii.redact, secret_scan.find_secrets,
    quality_rules.quality_rules, quality_classifier.classify, quality_classifier.keep_good,
]


@pytest.mark.parametrize("operator", EMPTY, ids=lambda f: f"{f.__module__.split('.')[-1]}.{f.__name__}")
def test_empty_tables(nothing, operator):
    assert operator(nothing).count() == 0


def test_packed_arrays_come_back():
    packed = exchange.pack(np.array([1, 0, 1]), [np.array([5, 6, 7], np.uint64), np.array([9, 2, 9], np.int64)])
    a, b = exchange.unpack(iter([packed]), ["u8", "i8"])
    assert sorted(zip(a.tolist(), b.tolist())) == [(5, 9), (6, 2), (7, 9)] and isinstance(packed, pa.RecordBatch)
