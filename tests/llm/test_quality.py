import random

import numpy as np

from glyphgrid.llm import quality
from tests.llm.conftest import words


def labelled(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = words(rng, rng.randrange(5, 80))
        bad = i % 4 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 8 == 0 else [x for x in w for _ in range(4)]
        rows.append((seed * 100_000 + i, " ".join(w), 0 if bad else 1))
    return rows


def test_held_out_accuracy(spark, make_docs):
    train, test = labelled(600, 1), labelled(200, 2)
    docs = make_docs([(i, t, "a") for i, t, _ in train + test])
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in train] + [(None, 1, 0), (train[0][0], None, None)], "doc_id bigint, quality int, toxic int")
    w = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, w).collect()}
    assert all(got[i]["keep"] for i, _, y in test if y)
    assert np.mean([not got[i]["keep"] for i, _, y in test if not y]) > 0.9
    assert len(got) == len(train) + len(test)
    assert np.array_equal(w, quality.train(docs.repartition(7), labels))  # the order of rows doesn't matter
    kept = {r["doc_id"] for r in quality.keep_good(docs, w).select("doc_id").collect()}
    assert kept == {i for i, r in got.items() if r["keep"]}
    assert quality.keep_good(docs, w).columns == docs.columns


def test_scores_are_sparse_dot_products():
    rng = np.random.default_rng(0)
    w = rng.normal(size=(1 << 12) + 1).astype(np.float32)
    texts = ["a b b c!", "", None, "z", "a a a", "w " * 3000]
    for (first, grams), _ in zip(quality.hashed(texts, 12), range(1)):
        assert first == 0
        for i, t in enumerate(texts):
            slots = np.concatenate([s[to[i] : to[i + 1]] for s, to in grams])
            u, c = np.unique(slots, return_counts=True)
            z = w[0] + (w[1 + u].astype(float) * c).sum() / np.sqrt(max(c.sum(), 1))
            want = 1 / (1 + np.exp(-z)) if len(slots) else 0.0
            assert abs(quality.scores([t], w)[0] - want) < 1e-9


def test_edges(edge, empty, edge_rows, spark):
    w = quality.train(edge, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert not w.any()
    rows = quality.score(edge, w).collect()
    assert len(rows) == len(edge_rows)
    want = sorted((i is not None, i or 0, bool(t and t.strip())) for i, t, _ in edge_rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["keep"]) for r in rows) == want
    assert quality.score(empty, w).count() == 0


def test_bound_is_on_the_sample_alone(spark, make_docs):
    rows = labelled(60, 3)
    docs, labels = make_docs([(i, t, "a") for i, t, _ in rows]), spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    assert not np.array_equal(quality.train(docs, labels, rows=30), quality.train(docs, labels))
    assert quality.score(docs, quality.train(docs, labels, rows=30)).count() == 60


def test_labels_without_documents_do_not_use_up_the_sample(spark, make_docs):
    rows = labelled(100, 4)
    docs = make_docs([(i, t, "a") for i, t, _ in rows] + [(rows[0][0], "zz later text", "a"), (rows[0][0], None, "a"), (None, "x", "a")])
    own = [(i, y, 0) for i, _, y in rows]
    labels = spark.createDataFrame(own + [(10_000_000 + i, 1, 0) for i in range(20_000)], "doc_id bigint, quality int, toxic int")
    w = quality.train(docs, labels, rows=50)
    assert w.any() and np.array_equal(w, quality.train(docs, spark.createDataFrame(own, labels.schema), rows=50))
    assert np.mean([(s >= 0.5) == bool(y) for s, (_, _, y) in zip(quality.scores([t for _, t, _ in rows], w), rows)]) > 0.9


def test_ftrl_against_a_plain_run():
    """The update of McMahan et al., one slot at a time."""
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(40, rng.integers(1, 9), replace=False)), None, int(rng.integers(0, 2))) for _ in range(120)]
    rows = [(s, rng.integers(1, 4, len(s)).astype(float), y) for s, _, y in rows]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.1
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    good = sum(y for *_, y in rows)
    per = {1: len(rows) / (2 * good), 0: len(rows) / (2 * (len(rows) - good))}
    for _ in range(3):
        for slots, counts, y in rows:
            x = {0: 1.0} | {int(s) + 1: c / counts.sum() ** 0.5 for s, c in zip(slots, counts)}
            p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in x.items())))
            for i, v in x.items():
                w, g = weight(i), (p - y) * v * per[y]
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - sigma * w
                n[i] += g * g
    want = np.array([weight(i) for i in range(65)])
    assert np.allclose(quality.fit(rows, bits=6, epochs=3), want, atol=1e-5) and (want != 0).sum() > 20
