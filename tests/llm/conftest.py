from __future__ import annotations

import pytest

#: Null, empty, white space, very long, repeated, clashing: what every text operator must stand.
LONG = "lorem ipsum dolor sit amet " * 8_000
EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "Hello world, a b c d."),
    (5, "Hello  world,\na b c d."),
    (5, "Hello  world,\na b c d."),
    (None, "Hello world, a b c d."),
    (6, LONG),
    (7, "äöü ß 日本語 🙂 \x00 \x1c é"),
    (8, "..."),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Edge rows, with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "x", i, True, 3, "y", "z", 4, "v", 5) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, keep_id bigint, KEPT boolean, n_words int, ids string, score string, `a.b` int, quality_text string, `sieve ``bits` int").coalesce(2)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.where("doc_id = -1")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
