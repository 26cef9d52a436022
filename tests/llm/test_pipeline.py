from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from glyphgrid.llm import licenses, mixing, neardup, packing, quality, queries
from tests.llm.test_mixing import brute_blocks, tokens
from tests.llm.test_neardup import brute, brute_drop

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_runs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept, out = docs, []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        out.append(kept.collect())
        kept = spark.createDataFrame(out[-1], kept.schema)
        if name != "packing":
            assert kept.columns == corpus_pipeline.COLUMNS == docs.columns
    rows = docs.collect()
    w = quality.train(docs, labels)
    good = [r for r, p in zip(rows, quality.scores([r["text"] for r in rows], w)) if round(p, 6) >= 0.5]
    assert Counter(out[0]) == Counter(good)
    group = brute([(r["doc_id"], r["text"], None) for r in good])
    assert Counter(out[1]) == Counter(r for r in good if group.get(r["doc_id"], r["doc_id"]) == r["doc_id"])
    single = spark.createDataFrame(out[1], docs.schema)
    blocks = brute_blocks(single, mixing.BLOCK_TOKENS, mixing.STREAM_TOKENS)
    slots = mixing.mix_sources(single, epochs=1.0).select("source", "block").collect()
    want = Counter(t for s in slots for t in blocks[s["source"], s["block"]])
    assert Counter((r["doc_id"], t) for r in out[2] for t in tokens(r["text"])) == want
    assert {r["doc_id"] for r in out[2]} == {r["doc_id"] for r in out[1]}  # the mixture leaves no document out
    packed = out[3]
    assert Counter(i for r in packed for i in r["ids"]) == Counter(r["doc_id"] for r in out[2])
    assert Counter(t for r in packed for t in r["texts"]) == Counter(r["text"] for r in out[2])
    assert all(r["n_tokens"] <= 2048 and r["n_segments"] <= 16 for r in packed if r["fits"])
    run = corpus_pipeline.run(spark, SF)
    assert sorted(r["ids"] for r in run.collect()) == sorted(r["ids"] for r in packed)


def test_edges(spark, edge, empty, edge_rows, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # without labels all visible texts are kept
    visible = [(i, t) for i, t, _ in edge_rows if t and t.strip()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    docs, out = edge, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        out.append(docs.collect())
        docs = spark.createDataFrame(out[-1], docs.schema)
        assert name == "packing" or docs.columns == corpus_pipeline.COLUMNS
    assert sorted(((r["doc_id"], r["text"]) for r in out[0]), key=key) == sorted(visible, key=key)
    kept = brute_drop([(i, t, None) for i, t in visible])
    assert Counter((r["doc_id"], r["text"]) for r in out[1]) == kept
    want = Counter((i, t) for (i, x), n in kept.items() for t in tokens(x) for _ in range(n))
    got = Counter((r["doc_id"], t) for r in out[2] for t in tokens(r["text"]))
    assert all(got[k] >= n for k, n in want.items()) and set(got) == set(want)
    assert Counter(i for r in out[3] for i in r["ids"]) == Counter(r["doc_id"] for r in out[2])
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == []
    assert packing.pack(packing.document_examples(empty)).count() == 0


def test_there_is_a_query_for_every_operator():
    names = queries.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(queries.oracle_sql()) <= set(names)
    assert corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixing", "packing"]


def test_queries_run_on_test_tables(spark):
    assert queries.op9_compression_cross_entropy(spark, SF).count() > 0


def rows_of(rows):
    clean = lambda x: round(x, 8) if isinstance(x, float) else x
    return sorted((tuple(clean(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_their_sql(spark, con, name):
    own = queries.queries()[name](spark, SF)
    other = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in other.description]
    assert sorted(names) == sorted(own.columns)
    assert rows_of(own.select(names).collect()) == rows_of(other.fetchall())


@pytest.mark.parametrize("name", ["op3_minhash_near_dedup", "near_pairs", "op6_mixing", "op10_license_scan"])
def test_sql_on_edge_rows(spark, edge, name):
    """Null, blank, repeated and very long rows: Spark and SQL agree on them too."""
    made = {"op3_minhash_near_dedup": neardup.groups, "near_pairs": neardup.pairs, "op6_mixing": lambda d: mixing.pieces(mixing.mix_sources(d)), "op10_license_scan": licenses.scan}
    c = duckdb.connect()
    for docs in (edge, edge.limit(0)):
        c.register("documents", docs.select("doc_id", "text", "lang", "source").toArrow())
        other = c.execute(queries.oracle_sql()[name])
        names = [d[0] for d in other.description]
        assert rows_of(made[name](docs).select(names).collect()) == rows_of(other.fetchall())
