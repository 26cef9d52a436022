"""Vectors, runs of postings and tables that are written when they are asked for, against what is plainly counted."""

import random
from collections import Counter

from pyspark.sql import functions as F

from glyphgrid.functions.analysis import STANDARD
from glyphgrid.functions.words import words
from glyphgrid.operators import index as indexing
from glyphgrid.operators.catalog import Engine
from glyphgrid.operators.index import build, postings_of, sorted_postings
from glyphgrid.plans.mapping import parse_mapping
from glyphgrid.sources.shared import keep

MAPPING = parse_mapping({"properties": {"a": {"type": "string"}, "b": {"type": "string"}, "c": {"type": "string", "index": "not_analyzed"}}})
TEXTS = [None, "", "The the THE ß", "Été été ete", "́x y", "á b", "\U0001f600 x \U0001d400", "Σας ΟΔΟΣ", "한국 어", "x" * 300]


def docs(spark, n=300):
    rng = random.Random(3)
    rows = [(i, rng.choice(TEXTS), " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(9))) if i % 7 else rng.choice(TEXTS), rng.choice([None, "x y", ""])) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, a string, b string, c string")


def test_vectors_are_each_row_counted_by_itself(spark):
    rows = docs(spark)
    got = {(r["doc_key"], r["field"]): (r["n_tokens"], Counter(dict(zip(map(bytes, r["terms"]), r["tfs"])))) for r in build(rows, MAPPING, "id").vectors.collect()}
    want = {}
    for r in rows.collect():
        for name, tokens in [(n, None if r[n] is None else STANDARD.split(r[n])[0]) for n in "ab"] + [("c", None if r["c"] is None else [r["c"]]), ("_all", STANDARD.split(" ".join(r[n] for n in "abc" if r[n] is not None))[0])]:
            if tokens is not None:
                want[str(r["id"]), name] = (len(tokens), Counter(t.encode() for t in tokens))
    assert got == want


def test_runs_are_sorted_and_whole(spark, tmp_path, monkeypatch):
    """Many runs in a task: the same rows as without sorting, and few pages of a run with a term."""
    monkeypatch.setattr(indexing, "_pieces", lambda batches, own=indexing._pieces: own(batches, 500))
    build(docs(spark), MAPPING, "id").vectors.coalesce(1).write.parquet(f"{tmp_path}/v")
    found = spark.read.parquet(f"{tmp_path}/v")
    runs = sorted_postings(found).collect()
    key = lambda r: (bytes(r["term"]), r["field"], r["doc_key"], r["tf"], r["len_code"])
    assert sorted(map(key, runs)) == sorted(map(key, postings_of(found).collect()))
    order = [key(r)[:2] for r in runs]
    falls = sum(a > b for a, b in zip(order, order[1:]))
    assert 0 < falls <= len(order) // 400 + 1


def test_no_shuffle_before_postings_and_only_what_is_asked_for_is_written(spark, tmp_path):
    kept = keep(build(docs(spark), MAPPING, "id"), f"{tmp_path}/kept")
    assert kept.docs.count() == 300 and {p.name for p in (tmp_path / "kept").iterdir()} == {"docs"}
    assert sorted_postings(kept.vectors)._jdf.queryExecution().toString().count("Exchange") == 0
    assert {(r["field"], bytes(r["term"])): r["df"] for r in kept.term_stats.collect()} == dict(Counter((r["field"], bytes(r["term"])) for r in kept.postings.collect()))
    plan = kept.term_stats.where(F.col("term") == F.lit(bytearray(b"the")))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term)" in plan


def test_keys_that_come_once_are_not_shuffled(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/w")
    engine.create_index("m", {"mappings": {"doc": {"properties": {"a": {"type": "string", "store": True}}}}})
    rows = spark.createDataFrame([(1, "one", 1), (1, "two", 2), (None, "none", 3), (2, "x", None)], "id bigint, a string, seq int")
    engine.upsert("m", "doc", rows, "id", "seq")
    assert sorted((r["doc_key"], r["a"]) for r in engine.stores["m"].index().docs.collect()) == [("1", "two"), ("2", "x")]
    engine.upsert("m", "doc", rows.where("seq = 1"), "id", "seq")
    assert engine.get_document("m", "doc", "1") == {"a": "one"} and engine.count("m", {"match": {"a": "two"}}) == 0


def test_words_of_all_planes():
    assert words("a\U0001d400b 한국 x") == ["a\U0001d400b", "한국", "x"] and words("é \U0001f600 ü") == ["é", "ü"] and words("a­b é") == ["a­b", "é"]


def test_blocks_and_packed_rows_hold_the_same_in_fewer_rows(spark, tmp_path, monkeypatch):
    """Numbers whose terms are any bytes, keys that can't be joined, and terms of more postings than a block has."""
    monkeypatch.setattr(indexing, "BLOCK", 7)
    mapping = parse_mapping({"properties": {"a": {"type": "string"}, "n": {"type": "integer"}, "e": {"type": "string"}}})
    rows = [(k + str(i), f"the w{i % 5} the", i % 3 * 2_105_376 - 31, None if i % 2 else "") for k in ("", "\x1f,", "é\x1f") for i in range(60)]
    for n, some in enumerate([rows[:60], rows, rows[:0]]):
        made = build(spark.createDataFrame(some, "k string, a string, n bigint, e string"), mapping, "k")
        kept = keep(made, f"{tmp_path}/{n}")
        whole = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
        assert whole(kept.vectors) == whole(made.vectors) and whole(indexing.unpack(indexing.pack(made.vectors))) == whole(made.vectors)
        assert whole(kept.postings) == whole(made.postings) and whole(kept.term_stats) == whole(made.term_stats) and whole(kept.lengths) == whole(made.lengths)
        sizes = [r["n"] for r in kept.blocks.collect()]
        assert sum(sizes) == made.postings.count() and len(sizes) < max(sum(sizes) / 3, 1) and max(sizes, default=7) == 7


def test_segments_of_single_postings_are_read_and_merged(spark, tmp_path):
    """A segment as it was written before: tables vectors and postings in place of packed and blocks."""
    engine = Engine(spark, f"{tmp_path}/w")
    engine.create_index("m", {"mappings": {"doc": {"properties": {"a": {"type": "string", "store": True}}}}})
    rows = spark.createDataFrame([(i, f"the w{i}") for i in range(20)], "id bigint, a string")
    engine.upsert("m", "doc", rows, "id")
    store = engine.stores["m"]
    folder = tmp_path / "w" / "m" / store.manifest["segments"][0]["id"]
    found = indexing.unpack(spark.read.parquet(f"{folder}/packed"))
    found.write.parquet(f"{folder}/vectors")
    postings_of(found).write.parquet(f"{folder}/postings")
    for old in ("packed", "blocks"):
        (folder / old).rename(tmp_path / old)
    engine.upsert("m", "doc", rows.where("id < 3").withColumn("a", F.lit("the new")), "id")
    store.delete(spark.createDataFrame([("4",)], "doc_key string"))
    for _ in range(2):
        assert [engine.count("m", {"match": {"a": t}}) for t in ("the", "new", "w1", "w4", "w5")] == [19, 3, 0, 0, 1]
        own = store.index()
        assert {bytes(r["term"]): r["df"] for r in own.term_stats.where("field = 'a'").collect()} == dict(Counter(bytes(r["term"]) for r in own.postings.where("field = 'a'").collect()))
        engine.optimize("m")


def test_tables_of_segments_are_compressed_well(spark, tmp_path):
    """By zstandard: packed rows of few repeated strings take more room by Snappy."""
    engine = Engine(spark, f"{tmp_path}/w")
    engine.create_index("m", {"mappings": {"doc": {"properties": {"a": {"type": "string", "store": True}}}}})
    engine.upsert("m", "doc", spark.createDataFrame([(1, "one two")], "id bigint, a string"), "id")
    written = [p.name for t in ("packed", "blocks", "docs") for p in (tmp_path / "w" / "m").rglob(f"{t}/*.parquet")]
    assert len(written) >= 3 and all(n.endswith(".zstd.parquet") for n in written)


def test_documents_by_term_are_told_by_blocks(spark, tmp_path, monkeypatch):
    """A segment has no table of them, whose making shuffled every term of every run; those of blocks add up, also after deletes."""
    monkeypatch.setattr(indexing, "BLOCK", 3)
    engine = Engine(spark, f"{tmp_path}/w")
    engine.create_index("m", {"mappings": {"doc": {"properties": {"a": {"type": "string", "store": True}}}}})
    engine.upsert("m", "doc", spark.createDataFrame([(i, f"the w{i % 4}") for i in range(20)], "id bigint, a string"), "id")
    store = engine.stores["m"]
    store.delete(spark.createDataFrame([("4",), ("5",)], "doc_key string"))
    assert {p.name for p in (tmp_path / "w" / "m" / store.manifest["segments"][0]["id"]).iterdir()} == {"packed", "docs", "blocks", "field_stats"}
    got = {bytes(r["term"]).decode(): r["df"] for r in store.index().term_stats.where("field = 'a'").collect()}
    assert got == {"the": 18, "w0": 4, "w1": 4, "w2": 5, "w3": 5}


def test_groups_are_sorted_with_their_places():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        for group in (rng.integers(0, 50, n).astype(np.int32), rng.integers(0, 2**61, n), rng.integers(0, 9, n) * 2**50):
            got, order = indexing._in_order(group)
            want = np.argsort(group, kind="stable")
            assert (order == want).all() and (got == group[want]).all()


def test_more_documents_are_analysed_in_more_tasks(spark, tmp_path):
    """Tasks of one size instead of one for each core, whose longest grew with the input."""
    small = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        build(docs(spark, 3000), MAPPING, "id").packed.write.parquet(f"{tmp_path}/p")
    finally:
        for k in small:
            spark.conf.unset(k)
    assert len(list((tmp_path / "p").glob("*.parquet"))) > spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{tmp_path}/p").where("field = '_all'").count() == 3000
