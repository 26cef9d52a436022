import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, sig string, rep int, fine int, src string, shard string, key string, h string, y int"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "sig", 1, 2, "src", "s", "k", "h", 0) for i, t, s in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    rng = random.Random(5)
    long = " ".join(words(rng, 60_000))
    plain = " ".join(words(rng, 80))
    return [
        (1, plain, "a"), (2, plain, "a"), (3, None, "a"), (4, "", None), (None, plain, "b"), (None, None, None),
        (5, " \n\t ", "b"), (6, "!!! ???", "b"), (7, "!!! ???", "b"), (8, long, "hot"), (8, long, "hot"), (9, "x" * 100_000, "hot"),
        (10, "Ünïcode ß 字。漢字 Licensed under the MIT License.", "a"), (10, "other text under the same id", "a"), (11, "one", "c"),
    ]


@pytest.fixture(scope="session")
def edge(make_docs, edge_rows):
    return make_docs(edge_rows)


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([])
