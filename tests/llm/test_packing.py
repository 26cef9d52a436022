import duckdb
import numpy as np

from glyphgrid.llm import packing, queries


def slow_pack(demand, limits):
    """The heuristic, one example and one dimension at a time."""
    n = len(demand)
    mean = [sum(d[k] for d in demand) / n / limits[k] for k in range(3)]
    todo = [i for i in range(n) if all(demand[i][k] <= limits[k] for k in range(3))]
    over = [i for i in range(n) if i not in set(todo)]
    pack, number = [-1] * n, 0
    while todo:
        left = list(limits)
        while True:
            can = [i for i in todo if all(demand[i][k] <= left[k] for k in range(3))]
            if not can:
                break
            best = max(can, key=lambda i: (round(sum(demand[i][k] / limits[k] * mean[k] * left[k] / limits[k] for k in range(3)), 9), -i))
            pack[best] = number
            left = [left[k] - demand[best][k] for k in range(3)]
            todo.remove(best)
        number += 1
    for i in over:
        pack[i], number = number, number + 1
    return pack


def test_heuristic_matches_plain_loops():
    rng = np.random.default_rng(1)
    for _ in range(5):
        d = np.stack([rng.integers(0, 900, 80), rng.integers(1, 6, 80), rng.integers(0, 700, 80)], 1)
        d[7] = d[9] = d[11]
        d[3] = [5000, 1, 1]
        pack, fits, when = packing.pack_vectors(d, (1000, 8, 800))
        assert pack.tolist() == slow_pack(d.tolist(), (1000, 8, 800))
        assert fits.tolist() == [i != 3 for i in range(80)]


def test_packs_hold_every_example_once_within_limits(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), int(rng.integers(0, 900)), int(rng.integers(1, 7)), int(rng.integers(0, 500))) for i in range(900)]
    rows += [rows[0], rows[0], (5000, 9999, 1, 1), (5001, None, None, None), (None, 10, 1, 5)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "id bigint, tokens bigint, segments bigint, loss bigint, shard string, pack_id string")
    got = packing.pack(df, (1000, 8, 800), shard_rows=200).collect()
    assert sorted((i is not None, i or 0) for r in got for i in r["ids"]) == sorted((r[0] is not None, r[0] or 0) for r in rows)
    assert len({r["pack_id"] for r in got}) == len(got)
    assert all(r["n_tokens"] <= 1000 and r["n_segments"] <= 8 and r["n_loss"] <= 800 for r in got if r["fits"])
    assert [r["ids"] for r in got if not r["fits"]] == [[5000]]
    assert sum(r["n_tokens"] for r in got) == sum(r[1] or 0 for r in rows)
    full = sum(r["n_tokens"] for r in got) / 1000
    assert len(got) < 1.6 * max(full, sum(r["n_segments"] for r in got) / 8)


def test_conversations_and_edges(spark, edge, empty):
    turns = spark.createDataFrame([(1, 0, "user", "a b c"), (1, 1, "assistant", "d e"), (1, 2, None, None), (2, 0, "assistant", " "), (None, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    got = {r["id"]: (r["tokens"], r["segments"], r["loss"]) for r in packing.conversation_examples(turns).collect()}
    assert got == {1: (5, 3, 2), 2: (0, 1, 0), None: (1, 1, 0)}
    assert packing.pack(packing.conversation_examples(turns)).count() == 1
    assert packing.pack(packing.conversation_examples(turns.limit(0))).count() == 0
    packs = packing.pack(packing.document_examples(edge), texts=True).collect()
    assert sum(len(r["ids"]) for r in packs) == edge.count()
    assert all(len(r["texts"]) == len(r["ids"]) for r in packs)
    assert packing.pack(packing.document_examples(empty), texts=True).count() == 0


def test_copies_beyond_a_shard_are_dealt_out(spark):
    rows = [(7, 10, 1, 5)] * 900 + [(None, 0, 1, 0)] * 400 + [(1000 + i, 100, 2, 50) for i in range(200)]
    df = spark.createDataFrame([(*r, f"t{r[0]}") for r in rows], "id bigint, tokens bigint, segments bigint, loss bigint, text string")
    for texts in (False, True):
        got = packing.pack(df, (1000, 16, 800), shard_rows=100, texts=texts).collect()
        ids = [i for r in got for i in r["ids"]]
        assert len(ids) == len(rows) and ids.count(7) == 900 and ids.count(None) == 400
        assert all(r["n_segments"] <= 16 and r["n_tokens"] <= 1000 for r in got)
        per = {}
        for r in got:
            per[r["pack_id"] >> 32] = per.get(r["pack_id"] >> 32, 0) + len(r["ids"])
        assert max(per.values()) < 500 and len(per) > 5


def test_query_against_its_sql(spark, tmp_path):
    """The recursion in SQL places all conversations alike, in one shard and in many."""
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    key = lambda r: (r[0], r[1])
    for rows in (packing.SHARD_ROWS, 30):
        own = packing.members(packing.pack(packing.conversation_examples(turns), shard_rows=rows)).collect()
        want = con.execute(packing.sql(shard_rows=rows)).fetchall()
        assert sorted(map(tuple, own), key=key) == sorted(want, key=key) and len(want) > 50
    assert queries.oracle_sql()["op4_packing"] == packing.sql()
