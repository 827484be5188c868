"""Hard negatives against plain Python, and the visiting order of cells."""

import brute
import numpy as np
import pytest
from conftest import FOLDER

from trialweave.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, row long, score long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def triples(df):
    return [(r.vec_id, r.embedding, r.label) for r in df.collect()]


def test_query(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    moved = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in triples(df)]
    assert rows(queries.op11_hard_negatives(spark, FOLDER)) == sorted(brute.hard_negatives(moved), key=repr)


def test_hard_rows(spark):
    """Copies, repeated and null ids, ties, short, empty and invalid vectors, negative products."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 7))
    data = [(i, (centres[i % 6] + rng.normal(size=7) * 0.2).tolist(), i % 3) for i in range(900)]
    data += [(i % 4 * 50, [1.0, 0.5, 0.25], i % 2) for i in range(40)]
    data += [(None, [1.0, 0.5, 0.25], 1), (50, [], 1), (100, [0.0] * 7, 2), (150, [float("nan")] * 7, 1), (200, None, 1)]
    data += [(250, [1.0, None], 1), (300, [float("inf")] * 7, 1), (350, [1.0] * 7, None), (400, [-1.0] * 7, 1), (450, [30.0] * 7, 2)]
    df = spark.createDataFrame([(*x, 1, 1) for x in data], SCHEMA)
    assert rows(hard_negatives.hard_negatives(df)) == sorted(brute.hard_negatives(data), key=repr)


@pytest.mark.parametrize("size", [900.0, 1e5])
def test_large_components(spark, size):
    rng = np.random.default_rng(6)
    data = [(i * 10, (rng.normal(size=4) * size).tolist(), i % 2) for i in range(60)]
    df = spark.createDataFrame([(*x, 1, 1) for x in data], SCHEMA)
    assert rows(hard_negatives.hard_negatives(df)) == sorted(brute.hard_negatives(data), key=repr)


def test_blocks_share_a_cell_of_copies(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "FIRST", 20)
    data = [(i, [1.0, 0.0, 0.5] if i % 3 else [0.9, 0.1 * (i % 7), 0.2], i % 4) for i in range(301)]
    df = spark.createDataFrame([(*x, 1, 1) for x in data], SCHEMA)
    assert rows(hard_negatives.hard_negatives(df)) == sorted(brute.hard_negatives(data), key=repr)


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.hard_negatives(df).count() == 0
    one = spark.createDataFrame([(50, [1.0, 2.0], 1, 1, 1)], SCHEMA)
    assert hard_negatives.hard_negatives(one).count() == 0


def test_cells_come_by_descending_bound():
    rng = np.random.default_rng(7)
    halves = [rng.normal(size=9), rng.normal(size=9)]
    held = rng.integers(0, 3, 81)
    got = list(hard_negatives.visits(halves, held))
    want = sorted((-(halves[0][c // 9] + halves[1][c % 9]), c) for c in np.flatnonzero(held))
    assert [b for _, b in got] == [-b for b, _ in want] and {c for c, _ in got} == {c for _, c in want}
