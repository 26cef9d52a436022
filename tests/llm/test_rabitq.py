import duckdb
import numpy as np
import pytest

from glyphgrid.llm import queries, rabitq

SF = "/root/testdata/sf0.001"


def brute(ids, x, k, every=1):
    s = np.round(x.astype(np.float64) @ x.T.astype(np.float64), 6)
    np.fill_diagonal(s, -np.inf)
    return {int(ids[i]): [int(ids[j]) for j in np.lexsort((ids, -s[i]))[: min(k, len(ids) - 1)]] for i in range(len(ids)) if ids[i] % every == 0}


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(8, d))[rng.integers(0, 8, n)] * 1.5 + rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["vec_id"], r["rank"])):
        out.setdefault(r["vec_id"], []).append(r["neighbour"])
    return out


@pytest.mark.parametrize("every,options", [(1, {}), (2, {"cell_rows": 120}), (3, {"wave_bytes": 10_000, "cell_rows": 300})])
def test_recall_against_brute_force(spark, every, options):
    x = clustered(900, 32, 1)
    ids = np.arange(900) * 3
    df = spark.createDataFrame([(int(i), v.tolist(), 0, 1) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>, block int, cell int")
    got, want = found(rabitq.neighbours(df, k=10, every=every, **options)), brute(ids, x, 10, every)
    assert set(got) == set(want)
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) > 0.99


def test_recall_without_clusters_and_few_are_compared(monkeypatch):
    """Isotropic vectors, where spheres exclude nothing: bounds alone choose what is reranked."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids, turn, centre = np.arange(6000), rabitq.rotation(64, 128), x.mean(0)
    best = rabitq.Best(ids[:100], x[:100], rabitq.first_bars(ids[:100], x[:100], ids[:3000], x[:3000], 10), 10)
    compared = []
    add = rabitq.Best.add
    monkeypatch.setattr(rabitq.Best, "add", lambda self, r, c, ip: (compared.append(len(r)), add(self, r, c, ip))[1])
    best.visit(ids, x, rabitq.Codes.of(x, centre, turn), centre, turn)
    got = {i: sorted(best.neighbour[best.row == i]) for i in range(100)}
    want = brute(ids, x, 10)
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in range(100)]) > 0.99
    assert sum(compared) < 0.02 * 100 * 6000


def test_estimates_are_unbiased_and_bounds_hold():
    x = clustered(600, 48, 2) * np.random.default_rng(0).uniform(0.2, 3, (600, 1)).astype(np.float32)
    turn = rabitq.rotation(48, rabitq.code_bits(48))
    assert np.allclose(turn @ turn.T, np.eye(48), atol=1e-5)
    codes = rabitq.Codes.of(x, x.mean(0), turn)
    guess, err = codes.estimate(x, x.mean(0), turn)
    gap = guess - x @ x.T
    assert (np.abs(gap) <= err).mean() > 0.99 and abs(gap.mean()) < 0.02
    assert codes.bits.shape == (600, 2) and codes.bits.dtype == np.uint64
    assert (np.abs(codes.estimate(x, x.mean(0), turn, 1.0)[0] - x @ x.T) <= codes.estimate(x, x.mean(0), turn, 1.0)[1]).mean() < 0.95


def test_edges(spark):
    kind = "vec_id bigint, embedding array<float>"
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (3, [0.0, 1.0])]
    got = found(rabitq.neighbours(spark.createDataFrame(rows, kind), k=2, every=1))
    assert got == {1: [2, 3], 2: [1, 3], 3: [1, 2], 4: [1, 2]}
    assert rabitq.neighbours(spark.createDataFrame([], kind)).count() == 0
    assert rabitq.neighbours(spark.createDataFrame(rows[:1], kind), every=1).count() == 0
    assert rabitq.neighbours(spark.createDataFrame(rows, kind), every=50).count() == 0
    ties = spark.createDataFrame([(i, [0.5, 0.5], "x", 1, 2.0, 3) for i in range(30)], kind + ", code string, cell int, norm double, rank int")
    assert found(rabitq.neighbours(ties, k=3, every=1, cell_rows=7))[20] == [0, 1, 2]
    long = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=3000).tolist()) for i in range(12)], kind)
    assert len(found(rabitq.neighbours(long, k=3, every=1))) == 12


def test_query_against_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(rabitq.sql()).fetchall())
    assert sorted(tuple(r) for r in queries.op8_rotated_codes(spark, SF).collect()) == want and want
