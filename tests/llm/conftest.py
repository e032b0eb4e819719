from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest documents with rows that are empty, null, blank, very long or repeated, and a column too many."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    one = next(t for _, t in rows if t and 200 < len(t.split()) < 900)
    words = one.split()
    extra = [
        (900_001, None), (900_002, ""), (900_003, " \t\n"), (900_004, "word"), (900_005, "Word"), (900_006, "two words"), (900_007, one), (900_008, one.upper()),
        (900_009, " ".join([*words[:-1], "else"])), (900_010, " ".join(words[: len(words) * 95 // 100])), (900_011, " ".join(f"w{i % 7919}x{i % 31}" for i in range(60_000))),
        (900_012, "é" * 40 + one[:300] + "\U0001f600" * 30), (900_013, "a" * 3000), (900_014, "a" * 2990 + "b"), (900_015, "ab " * 900), (None, one), (None, None),
    ]
    docs = rows + extra
    return docs, spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, h int").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
