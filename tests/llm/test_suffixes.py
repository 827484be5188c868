"""Removal of repeated bytes against plain Python, and the parts of the merge sort."""

import brute
import numpy as np
import pytest
from conftest import pairs
from pyspark.sql import functions as F

from trialweave.llm import suffix_dedup
from trialweave.llm.arrays import Texts
from trialweave.llm.exchange import bitmap


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def check(df):
    assert rows(suffix_dedup.suffix_dedup(df)) == sorted(brute.suffix_dedup(pairs(df)), key=repr)


@pytest.mark.parametrize("table", ["documents", "hard"])
def test_tables(request, table):
    check(request.getfixturevalue(table))


def made(seed, letters, n, long=400):
    """Texts that share passages of 45 to 120 bytes, copies and near copies, null and repeated ids."""
    rng = np.random.default_rng(seed)

    def text(size):
        return "".join(rng.choice(list(letters), size))

    passages = [text(int(rng.integers(45, 120))) for _ in range(8)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(int(rng.integers(0, 6))):
            parts.append(passages[int(rng.integers(8))] if rng.random() < 0.5 else text(int(rng.integers(0, long // 4))))
        out.append((int(rng.integers(0, n)) if rng.random() < 0.9 else None, "".join(parts) if rng.random() < 0.97 else None))
    copies = [(i, out[int(rng.integers(n))][1]) for i in range(n, n + n // 4)]
    near = [(i, (out[int(rng.integers(n))][1] or "")[1:] + "!") for i in range(2 * n, 2 * n + n // 4)]
    return out + copies + near


@pytest.mark.parametrize("seed, letters", [(1, "ab"), (2, "abcdefgh \n"), (3, "a\x00\u00e9\u6f22"), (4, "x")])
def test_shared_passages(spark, seed, letters):
    check(spark.createDataFrame([(d, t, 7) for d, t in made(seed, letters, 120)], "doc_id long, text string, row long"))


def test_hot_anchors_and_small_runs(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_SLICES", 1)
    monkeypatch.setattr(suffix_dedup, "RUN", 50)
    monkeypatch.setattr(suffix_dedup, "PACKED_ANCHORS", 40)
    monkeypatch.setattr(suffix_dedup, "SLICE", 300)
    data = made(8, "abcdef", 300)
    check(spark.createDataFrame(data, "doc_id long, text string").repartition(8))


def test_nothing(nothing):
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_kept_bytes(spark):
    passage = "".join(chr(97 + i % 23) for i in range(60))
    df = spark.createDataFrame([(1, passage), (2, "head " + passage + " tail"), (3, passage)], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.suffix_dedup(df, as_bytes=True).collect()}
    assert kept == {1: passage.encode(), 2: b"head  tail", 3: b""}


def suffixes(seed, n):
    rng = np.random.default_rng(seed)
    data = rng.choice(np.array([0, 1, 97, 255], np.uint8), n)
    low = rng.integers(0, 10, n).astype(np.uint8)
    high = (low + rng.integers(0, 20, n)).astype(np.uint8)
    j = np.arange(50)
    right = np.where(j < (50 - low)[:, None], data[(np.arange(n)[:, None] + j) % n], 0).astype(np.uint8)
    left = np.where(np.arange(suffix_dedup.OFFSETS - 1) < high[:, None], data[(np.arange(n)[:, None] - 1 - np.arange(suffix_dedup.OFFSETS - 1)) % n], 0).astype(np.uint8)
    ids = rng.integers(-5, 5, n)
    return suffix_dedup.Suffixes(right, left, low, high, ids, ids * 3, np.arange(n, dtype=np.int32))


def test_front_coding_comes_back():
    run, rest = suffix_dedup.sorted_run(suffixes(1, 500))
    assert len(run) + len(rest) == 500
    back, shared = suffix_dedup.decoded(suffix_dedup.front_coded(run))
    for a, b in zip(run.columns, back.columns):
        assert np.array_equal(a, b)
    assert np.array_equal(shared, suffix_dedup.shared_with_previous(run.right))


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_loser_tree(k):
    runs, shared = [], []
    for i in range(k):
        run, _ = suffix_dedup.sorted_run(suffixes(10 + i, 40 * i + 5))
        runs.append([x.tobytes() for x in run.right])
        shared.append(suffix_dedup.shared_with_previous(run.right).tolist())
    which, place, common = suffix_dedup.merged(runs, shared)
    strings = [runs[r][p] for r, p in zip(which, place)]
    assert strings == sorted(x for r in runs for x in r)
    flat = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, 50)
    assert common[1:] == suffix_dedup.shared_with_previous(flat).tolist()[1:]


def test_equal_strings_have_one_anchor_at_one_offset():
    rng = np.random.default_rng(4)
    passage = rng.integers(97, 100, 90).astype(np.uint8)
    a, b = (np.concatenate([rng.integers(97, 100, n).astype(np.uint8), passage, rng.integers(97, 100, 30).astype(np.uint8)]) for n in (13, 40))
    _, place, low, high, key = suffix_dedup.anchors_of(Texts(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])))
    owner = suffix_dedup.anchors_of(Texts(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])))[0]
    strings = [{p - o: p for p, x, y, t in zip(place, low, high, owner) if t == own for o in range(x, y + 1)} for own in (0, 1)]
    assert sorted(strings[0]) == list(range(len(a) - 49)) and sorted(strings[1]) == list(range(len(b) - 49))
    assert all(strings[0][13 + i] - 13 == strings[1][40 + i] - 40 for i in range(41))


def test_anchors_are_hot_by_surroundings_and_not_by_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 1)
    monkeypatch.setattr(suffix_dedup, "PACKED_ANCHORS", 1)
    rng = np.random.default_rng(12)
    line = "".join(rng.choice(list("abcdefgh "), 150))
    texts = ["".join(rng.choice(list("abcdefgh "), 60)) + line + "".join(rng.choice(list("abcdefgh "), 60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    nothing = bitmap(spark.createDataFrame([], "id long"), "id")
    anchors = suffix_dedup.shared_anchors(suffix_dedup._own(df), 4, lambda batches: batches, nothing).cache()
    assert anchors.where("bucket is not null").count() and not anchors.where("hot is not null").count()
    check(df)


def test_surroundings():
    rng = np.random.default_rng(6)
    passage = rng.integers(97, 123, 120).astype(np.uint8)
    parts = [rng.integers(97, 123, n).astype(np.uint8) for n in (20, 25, 30, 35)]
    a, b = np.concatenate([parts[0], passage, parts[1]]), np.concatenate([parts[2], passage, parts[3]])
    texts = Texts(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    owner, place, low, high, key = suffix_dedup.anchors_of(texts)
    found = {}
    for t, p, x, y, h in zip(owner, place, low, high, suffix_dedup.surroundings_of(texts, owner, place, low, high)):
        at = texts.at[t] + p
        found.setdefault((texts.data[at - y : at - x + 50].tobytes(), x, y), set()).add(h)
    assert len(found) < len(key) and all(len(x) == 1 for x in found.values())
    assert len({h for x in found.values() for h in x}) == len(found)


@pytest.mark.parametrize("n, each", [(1, 1), (8, 4), (290, 1), (211, 4)])
def test_tasks_get_the_same_number_of_buckets(spark, n, each):
    numbers = suffix_dedup._buckets(spark, n, each)
    assert len(numbers) == n * each and (np.diff(numbers) > 0).all()
    df = spark.createDataFrame([(int(x),) for x in numbers], "bucket int").repartition(n, "bucket")
    assert [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()] == [each] * n


def test_a_task_packs_a_row_per_receiving_task(spark, monkeypatch):
    df = spark.createDataFrame([(d, t) for d, t in made(9, "abcdefgh", 400)], "doc_id long, text string").coalesce(1)
    nothing = bitmap(spark.createDataFrame([], "id long"), "id")
    rows = []
    monkeypatch.setattr(suffix_dedup, "_dealt", lambda packed, n: rows.append(packed.where("bucket >= 0").count()) or packed)
    suffix_dedup.shared_anchors(suffix_dedup._own(df), 16, lambda batches: batches, nothing)
    assert rows == [16]


def test_pieces_of_a_run_come_back_together():
    run, _ = suffix_dedup.sorted_run(suffixes(3, 700))
    starts = np.array([0, 1, 250, 251, 600])
    ends = np.r_[starts[1:], len(run)]
    pieces = suffix_dedup.front_coded_pieces(run, starts, ends)
    assert pieces == [suffix_dedup.front_coded(run.take(slice(a, b))) for a, b in zip(starts, ends)]
    back, shared, at = suffix_dedup.decoded_pieces(pieces)
    assert at == [*starts, len(run)] and not shared[starts].any()
    for a, b in zip(run.columns, back.columns):
        assert np.array_equal(a, b)


def test_packed_rows_come_back():
    rng = np.random.default_rng(5)
    buckets = rng.integers(0, 9, 500)
    columns = [rng.integers(-(2**63), 2**63 - 1, 500), rng.integers(-9, 9, 500).astype("i4"), rng.integers(0, 9, 500).astype("u1")]
    batch = suffix_dedup._packed(buckets, columns)
    back, sizes = suffix_dedup._unpacked([suffix_dedup.squeezed(b""), *batch.column("packed").to_pylist()], ["i8", "i4", "u1"])
    order = np.argsort(buckets, kind="stable")
    assert sizes.tolist() == [0, *np.bincount(buckets)]
    for a, b in zip(columns, back):
        assert np.array_equal(a[order], b)
