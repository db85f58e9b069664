from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def texts(small, spark):
    """(doc_id, text) of the smallest documents table."""
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


#: Null, empty, blank, long, repeated and tied rows, with columns whose names clash.
EDGE = [
    (1, None, "n", "x"),
    (2, "", "n", "x"),
    (3, " \t\n\r\x0b\f ", "n", "x"),
    (4, "one", "n", "x"),
    (5, "a b c d", "n", "x"),
    (6, "long " * 30000, "n", "x"),
    (7, "w" * 200000, "n", "x"),
    (8, " ".join(f"t{k}" for k in range(120)), "n", "x"),
    (9, " ".join(f"t{k}" for k in range(120)), "n", "x"),
    (9, " ".join(f"t{k}" for k in range(120)), "n", "x"),
    (9, "another text of the same id", "n", "x"),
    (None, " ".join(f"t{k}" for k in range(120)), "n", "x"),
    (None, None, None, None),
    (10, "nbsp between   and　ideographic ''s don't it's ́combining <|endoftext|> \U0001f600 \x1c x", "n", "x"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, n_words string, kept string")


@pytest.fixture(scope="session")
def edge_rows():
    return EDGE
