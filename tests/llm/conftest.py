import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash."""
    run = " ".join(f"w{i % 37}x{i % 11}" for i in range(4000))
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (6, "x" * 5000),
        (7, run), (8, run + " end"), (9, passage + " tail"), (10, "head " + passage), (11, passage + " " + passage),
        (12, "a@b.co 4111 1111 1111 1111 and 10.0.0.1, +1 (415) 555-0100; a@b.c@d.e.f"),
        (13, "token = \"abcdef123456\" AKIA" + "A1" * 8 + " " + "0a" * 20), (14, "é" * 50 + " ß▁ 漢字 <s>"),
    ]
    return spark.createDataFrame(
        [(d, t, "en", 7, 7, 7) for d, t in rows], "doc_id long, text string, lang string, n long, label long, node long"
    )


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]
