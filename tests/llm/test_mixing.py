import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from glyphgrid.llm import mixing
from tests.llm.conftest import words


def tokens(text):
    return [t for t in __import__("re").split("[ \t\n\r\f]+", text or "") if t]


def brute_blocks(docs, size, streams):
    """Token lists of (source, block), made one document after another."""
    fine = lambda r: int(hashlib.md5(f"{'' if r['doc_id'] is None else r['doc_id']}|{r['text']}".encode()).hexdigest()[:5], 16)
    rows = [(r["source"], fine(r), r["doc_id"], r["text"]) for r in docs.collect() if r["text"]]
    out = {}
    for source in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == source), key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[3].encode()))
        total = sum(len(tokens(r[3])) for r in own)
        if not total:
            continue
        bits = min(20, max(0, int(np.ceil(np.log2(total / streams)))))
        parts = defaultdict(list)
        for r in own:
            parts[r[1] >> (20 - bits)] += [(r[2], t) for t in tokens(r[3])]
        blocks = [p[i : i + size] for s in sorted(parts) for p in [parts[s]] for i in range(0, len(p), size)]
        out |= {(source, i): b for i, b in enumerate(blocks)}
    return out


def rows_of(df):
    return [(r["shard"], r["slot"], r["source"], r["epoch"], r["block"], [(p["doc_id"], t) for p in r["pieces"] for t in tokens(p["text"])], r["n_tokens"]) for r in df.collect()]


@pytest.fixture(scope="module")
def corpus(make_docs):
    rng = random.Random(2)
    return make_docs([(i, "  ".join(words(rng, rng.choice([1, 5, 60, 700]))), rng.choice(["hot", "hot", "hot", "b", "c"])) for i in range(150)])


def test_slots_hold_the_blocks_of_a_plain_run(corpus, monkeypatch):
    monkeypatch.setattr(mixing, "STREAM_TOKENS", 1000)
    want = brute_blocks(corpus, 32, 2_000_000)
    got = rows_of(mixing.mix_sources(corpus, {"hot": 1, "b": 2, "c": 1, "none": 5}, block_tokens=32, shard_slots=50, seed=3))
    assert len(got) == len(want)
    assert {(s, k) for s, k, *_ in got} == {(i // 50, i % 50) for i in range(len(want))}
    for _, _, source, _, block, own, n in got:
        assert own == want[source, block] and n == len(own)
    share = np.array([2, 1, 1]) / 4  # b, c, hot
    for shard in range(-(-len(want) // 50)):
        draw = mixing.draws(3, shard, min(50, len(want) - 50 * shard), share)
        assert [g[2] for g in sorted(got) if g[0] == shard] == [["b", "c", "hot"][x] for x in draw]
    for source in ("hot", "b", "c"):
        size = sum(k[0] == source for k in want)
        epochs = defaultdict(list)
        for g in got:
            if g[2] == source:
                epochs[g[3]].append(g[4])
        for e, blocks in epochs.items():
            assert len(set(blocks)) == len(blocks)
            assert len(blocks) == size or e == max(epochs)


def test_streams_cut_a_hot_source_and_lose_nothing(corpus):
    made, streams, names = mixing.blocks(corpus, 32, 1000)
    want = brute_blocks(corpus, 32, 1000)
    assert streams.where("src = 2").count() > 4
    got = {(r["source"], r["block"]): [(p["doc_id"], t) for p in r["pieces"] for t in tokens(p["text"])] for r in made.collect()}
    assert got == want
    assert names == ["b", "c", "hot"]


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (0, 12345, -9):
            x = mixing.feistel(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(x) == list(range(n))
    assert list(mixing.feistel(np.arange(500), np.full(500, 500), np.full(500, 1))) != list(mixing.feistel(np.arange(500), np.full(500, 500), np.full(500, 2)))


def test_draws_are_multinomial():
    share = np.array([0.5, 0.0, 0.3, 0.2])
    counts = np.array([np.bincount(mixing.draws(17, s, 1024, share), minlength=4) for s in range(400)])
    assert (counts.sum(1) == 1024).all() and not counts[:, 1].any()
    assert np.allclose(counts.mean(0), 1024 * share, atol=4 * np.sqrt(1024 * 0.25 / 400))
    assert np.allclose(counts.var(0)[[0, 2, 3]], (1024 * share * (1 - share))[[0, 2, 3]], rtol=0.25)
    assert abs(np.corrcoef(counts[:, 0], counts[:, 2])[0, 1] + np.sqrt(0.5 * 0.3 / (0.5 * 0.7))) < 0.1
    assert mixing.draws(1, 5, 10, np.array([0.0, 1.0, 0.0])).tolist() == [1] * 10


def test_slots_are_numbered_through_groups_of_shards(corpus, monkeypatch):
    """Each epoch is a permutation, whatever the grouping of shards."""
    options = {"block_tokens": 32, "shard_slots": 7, "total_blocks": 900, "seed": 3}
    want = rows_of(mixing.mix_sources(corpus, **options))
    monkeypatch.setattr(mixing, "SHARD_GROUP", 5)
    assert sorted(rows_of(mixing.mix_sources(corpus, **options))) == sorted(want)


def test_every_source_completes_an_epoch(corpus):
    made, _, _ = mixing.blocks(corpus, 32)
    got = mixing.mix_sources(corpus, block_tokens=32, epochs=1.0)
    assert got.select("source", "block").distinct().count() == made.count()


def test_no_table_that_grows_is_broadcast(corpus):
    plan = mixing.mix_sources(corpus)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("ShuffledHashJoin") == 3, plan


def test_edges(edge, empty, edge_rows):
    want = brute_blocks(edge, mixing.BLOCK_TOKENS, mixing.STREAM_TOKENS)
    got = rows_of(mixing.mix_sources(edge))
    assert len(got) == len(want) and all(g[5] == want[g[2], g[4]] for g in got)
    assert {g[2] for g in got} <= {"a", "b", "hot", "c"}
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(edge, {}).count() == 0
    docs = mixing.mixed_documents(edge)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.where("n_chars <> length(text)").count() == 0


def test_weights_are_met(corpus):
    got = mixing.mix_sources(corpus, {"hot": 1, "b": 1}, block_tokens=32, total_blocks=4000).groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in got}
    assert set(counts) == {"hot", "b"} and abs(counts["b"] - 2000) < 200
