"""Ranked search against plain Python."""

import brute
import pytest
from conftest import FOLDER, pairs

from trialweave.llm import lexical_search


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def items_of(df):
    return [(r.item_id, r.text) for r in df.collect()]


def test_lexical_search(spark, documents):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    got = rows(lexical_search.lexical_search(documents, items))
    assert got == sorted(brute.ranked(pairs(documents), items_of(items)), key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_lexical_search_of_hard_rows(spark, hard, block_bytes):
    docs = hard.unionByName(hard.where("doc_id in (9, 12)").selectExpr("null as doc_id", "text", "lang", "n", "label", "node"))
    items = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (3, "One two TWO w1x1 w2x2 w3x3 \u00c9\u00e9", 0), (3, "tail head p3 p4", 0), (3, "tail head p3 p4", 0),
         (None, "absent words", 0), (None, "token=p29", 0), (7, "\u00e9" * 50 + " \u6f22\u5b57", 0)],
        "item_id long, text string, doc_id long",
    )
    got = rows(lexical_search.lexical_search(docs, items, block_bytes=block_bytes))
    assert got == sorted(brute.ranked(pairs(docs), items_of(items)), key=repr)


def test_lexical_search_of_many_copies(spark):
    texts = [(i, "red green blue " + "x" * (i % 3)) for i in range(60)] + [(100 + i, "blue " * i) for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, "green blue"), (2, "x xx"), (3, "blue")], "item_id long, text string")
    got = rows(lexical_search.lexical_search(docs, items, k=7))
    assert got == sorted(brute.ranked(texts, items_of(items), 7), key=repr)


def test_lexical_search_of_empty_tables(spark, nothing, documents):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert lexical_search.lexical_search(nothing, items).count() == 0
    assert lexical_search.lexical_search(documents, items.limit(0)).count() == 0
