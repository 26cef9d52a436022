import json

import pytest
from pyspark.sql import functions as F

from glyphgrid.operators import search
from glyphgrid.operators.catalog import Engine, Names, NotFound
from glyphgrid.operators.index import FieldValueError, Index
from glyphgrid.plans.mapping import parse_mapping
from glyphgrid.sources import documents
from glyphgrid.sources.store import Conflict, Store
from glyphgrid.streaming.ingest import stream_bulk

MAPPING = {"properties": {"title": {"type": "string", "store": True}, "body": {"type": "string", "store": "yes"}, "pk": {"type": "integer", "store": True, "index": "no"}, "at": {"type": "date", "store": True}, "ok": {"type": "boolean", "store": True}, "sub": {"type": "nested", "properties": {"x": {"type": "string"}}}}}


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/warehouse")
    e.create_index("main", {"mappings": {"doc": MAPPING}})
    return e


def test_documents_go_in_and_out(engine, spark):
    engine.put_document("main", "doc", "test_doc", {"title": "hello world", "body": "lorem ipsum dolar", "pk": 1, "ok": "yes", "at": "2016-07-23T16:15:00+01:00", "sub": {"x": 1}})
    engine.put_document("main", "doc", "another_test_doc", {"title": "howdy partner", "body": ["lorem ipsum", None, "dolar"], "pk": 2})
    query = {"or": [{"term": {"title": {"value": w, "boost": 2.0}}} for w in ("howdy", "partner", "hello")]}
    hits = engine.search("main", query, fields=["pk"])["hits"]["hits"]
    assert [h["_id"] for h in hits] == ["another_test_doc", "test_doc"] and hits[0]["fields"] == {"pk": [2]}
    engine.optimize("main")
    assert [h["_id"] for h in Engine(spark, engine.warehouse).search("main", query)["hits"]["hits"]] == ["another_test_doc", "test_doc"]
    assert engine.get_document("main", "doc", "another_test_doc") == {"title": "howdy partner", "body": "lorem ipsum dolar", "pk": 2}
    assert engine.get_document("main", "doc", "test_doc")["at"].isoformat().startswith("2016-07-23T15:15:00")
    assert engine.get_document("main", "doc", "nope") is None
    assert engine.count("main", {"match": {"_all": "yes"}}) == 1 and engine.count("main", {"match": {"_all": "lorem"}}) == 1
    engine.put_document("main", "doc", "test_doc", {"title": "changed"})
    assert engine.count("main") == 2 and engine.count("main", {"match": {"title": "hello"}}) == 0
    stats = sorted(tuple(r) for r in engine.stores["main"].segment_stats().collect())
    assert [s[1:] for s in stats] == [(2, 1), (1, 0)]
    assert engine.delete_document("main", "doc", "test_doc") and not engine.delete_document("main", "doc", "test_doc")
    assert engine.count("main") == 1
    engine.put_document("main", "doc", "test_doc", {"title": "back"})
    assert engine.count("main", {"match": {"title": "back"}}) == 1
    engine.optimize("main")
    assert len(engine.stores["main"].manifest["segments"]) == 1 and engine.count("main") == 2


def test_strictness(engine):
    for document in ({"nope": 1}, {"pk": "1"}, {"pk": 1.5}, {"at": 5}, {"at": "2016-07-23"}, {"title": {"a": 1}}, {"title": [1]}, {"title": True}):
        with pytest.raises(FieldValueError):
            engine.put_document("main", "doc", "k", document)
    with pytest.raises(NotFound):
        engine.put_document("main", "doc", "k", None)
    engine.put_document("main", "doc", "bare", {})
    assert engine.count("main") == 1 and engine.get_document("main", "doc", "bare") == {}
    for call in (lambda: engine.put_document("x", "doc", "k", {"pk": 1}), lambda: engine.put_document("main", "x", "k", {"pk": 1}), lambda: engine.search("x", {"match_all": {}}), lambda: engine.get_index("x")):
        with pytest.raises(NotFound):
            call()
    row = documents.prepare("k", {"ok": 5, "title": 12, "body": None}, parse_mapping(MAPPING))
    assert row == {"_key": "k", "ok": False, "title": ["12"], "_all": ""}


def test_indices_mappings_and_aliases(engine):
    engine.put_alias("other", "main")
    assert engine.get_alias("other") == {"main": {"aliases": {"other": {}}}} == engine.get_alias("other", "main")
    assert engine.get_alias("nope") == {} and engine.get_alias("other", "x") == {} and engine.get_alias("main") == {"main": {"aliases": {"main": {}}}}
    assert not engine.put_alias("main", "other")["acknowledged"]
    assert engine.list_aliases() == {"main": {"aliases": {"other": {}}}}
    assert engine.put_mapping("main", {"more": {"properties": {"title": {"type": "string", "store": True}, "new": {"type": "integer"}}}})["acknowledged"]
    assert not engine.put_mapping("main", {"bad": {"properties": {"title": {"type": "integer"}}}})["acknowledged"]
    assert "new" in engine.stores["main"].mapping.fields
    engine.put_document("main", "more", "m", {"new": 7})
    assert engine.count("main", {"term": {"new": 7}}) == 1
    engine.create_index("second", {"mappings": {"doc": {"properties": {"title": {"type": "string"}}}}})
    engine.put_document("second", "doc", "a", {"title": "seven"})
    engine.put_alias("both", "main")
    engine.names.put_alias("both", ["main", "second"])
    assert engine.count("both", {"match": {"title": "seven"}}) == 1 and engine.count("both") == 2
    assert engine.search("both", {"match": {"title": "seven"}})["hits"]["hits"][0]["_id"] == "a"
    assert engine.refresh("main")["acknowledged"] and engine.create_index("main")["acknowledged"]
    assert set(engine.get_index("main")["main"]["mappings"]) == {"doc", "more"}
    engine.delete_index("second")
    assert engine.names.find("both") == ["main"]
    engine.delete_index("main")
    assert engine.names.find("both") == [] == engine.names.find("main")
    assert Engine(engine.spark, engine.warehouse).stores == {}


def test_aliases_are_there_after_a_restart(engine):
    engine.put_alias("other", "main")
    again = Engine(engine.spark, engine.warehouse)
    assert again.names.find("other") == ["main"] and again.search("other", {"match_all": {}})["hits"]["total"] == 0
    again.delete_index("main")
    assert Engine(engine.spark, engine.warehouse).names.aliases == {}


def test_names():
    n = Names()
    assert n.add("a") and not n.add("a") and n.put_alias("x", ["a"])
    n.add("x")
    assert n.find("x") == ["x"] and n.of("a") == []


def body(*documents_):
    return "".join(json.dumps({"index": {"_id": k, "_type": "doc", "_index": "main"}}) + "\n" + json.dumps(d) + "\n" for k, d in documents_)


def test_bulk(engine, spark):
    text = json.dumps({"delete": {"_id": "z"}}) + "\n" + body(("a", {"title": "one"}), ("b", {"title": "two"}), ("a", {"title": "three"})) + "\n" + body(("c", {"title": "after the empty line"}))
    out = engine.bulk(spark.createDataFrame([(text,)], "value string"))
    assert out["took"] == 3 and engine.count("main") == 2 and engine.count("main", {"match": {"title": "three"}}) == 1
    no_index = json.dumps({"index": {"_id": "d", "_type": "doc"}}) + "\n" + json.dumps({"title": "four"})
    engine.bulk(spark.createDataFrame([(no_index,)], "value string"), "main")
    assert engine.count("main") == 3


def test_bulk_reports_each_action(engine, spark):
    lines = [{"index": {"_id": "a", "_type": "doc", "_index": "main"}}, {"title": "one"}, {"index": {"_id": "b", "_type": "doc", "_index": "main"}}, {"pk": "no number"}, {"index": {"_type": "doc", "_index": "main"}}, {"title": "no id"}, {"index": {"_id": "c", "_type": "none", "_index": "main"}}, {}, {"index": {"_id": "a", "_type": "doc", "_index": "main"}}, {"nope": 1}]
    out = engine.bulk_request("\n".join(map(json.dumps, lines)) + "\n[1]\n{}")
    assert out["took"] == 6 and out["errors"]
    got = [(i["create"]["_id"], i["create"].get("error", "").split(":")[0]) for i in out["items"]]
    assert got == [("a", ""), ("b", "FieldValueError"), (None, "ExpectedKey"), ("c", "NotFound"), ("a", "FieldDoesntExist"), (None, "BadAction")]
    # what is invalid replaces nothing
    assert engine.count("main") == 1 and engine.get_document("main", "doc", "a") == {"title": "one"}
    assert engine.bulk_request("")["items"] == []


def test_files_are_in_order_of_their_names(engine, spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for i in range(12):
        (folder / f"f{i:02d}.json").write_text(body(("k", {"title": f"version{i}"}), (f"own{i}", {"title": "x"})))
    found = documents.read_bulk(spark, str(folder))
    assert [r["document"] for r in found.orderBy("request", "line").where("id = 'k'").collect()] == [json.dumps({"title": f"version{i}"}) for i in range(12)]
    files = spark.read.text(str(folder), wholetext=True).select("value", F.input_file_name().alias("request"))
    engine.bulk(files)
    assert engine.get_document("main", "doc", "k") == {"title": "version11"} and engine.count("main") == 13
    for bad in ('{"index": {}, "x": 1}\n{}', '{"index": {"_id": "a"}}\n', "[1]\n{}"):
        with pytest.raises(ValueError):
            list(documents.actions(bad))


def test_maintenance_merges_a_full_tier(engine):
    for i in range(3):
        engine.put_document("main", "doc", str(i), {"pk": i})
    assert engine.maintain() == ["main"] and engine.maintain() == [] and engine.count("main") == 3


def test_a_merge_takes_the_full_tier_alone(engine, spark):
    rows = spark.createDataFrame([(f"big{i}", "x y") for i in range(30)], "id string, title string")
    engine.upsert("main", "doc", rows, "id")
    store = engine.stores["main"]
    big = store.manifest["segments"][0]["id"]
    for i in range(3):
        engine.put_document("main", "doc", str(i), {"title": "x z"})
    engine.put_document("main", "doc", "big7", {"title": "z"})
    engine.delete_document("main", "doc", "2")
    assert engine.maintain() == ["main"]
    assert [s["id"] for s in store.manifest["segments"]][0] == big and len(store.manifest["segments"]) == 2
    assert sorted(tuple(r) for r in store.segment_stats().collect()) == [(1, 30, 1), (6, 3, 0)]
    assert engine.count("main", {"match": {"title": "z"}}) == 3 and engine.count("main") == 32
    check_statistics(store)


def check_statistics(store):
    """Summed statistics are those of a count over the live tables."""
    own = store.index()
    fresh = Index(own.docs, own.lengths, own.postings, own.mapping)
    for name in ("field_stats", "term_stats"):
        assert sorted(map(tuple, getattr(own, name).collect())) == sorted(map(tuple, getattr(fresh, name).collect())), name


def test_statistics_follow_updates_deletes_and_merges(engine, spark):
    store = engine.stores["main"]
    make = lambda ids, text: spark.createDataFrame([(str(i), f"{text} w{i}") for i in ids], "id string, title string")
    engine.upsert("main", "doc", make(range(12), "one"), "id")
    engine.upsert("main", "doc", make(range(6, 15), "two"), "id")
    store.delete(spark.createDataFrame([("3",), ("7",), ("nope",), ("3",)], "doc_key string"))
    store.delete(spark.createDataFrame([("3",), ("8",)], "doc_key string"))
    engine.upsert("main", "doc", make([3, 9], "three"), "id")
    check_statistics(store)
    assert engine.count("main") == 13 and sum(r["deleted_docs"] for r in store.segment_stats().collect()) == 12 + 9 + 2 - 13
    plan = search.search(store.index(), {"match": {"title": "two"}})
    assert not any("/vectors/" in f or "/docs/" in f for f in plan.inputFiles())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text
    store.merge([s["id"] for s in store.manifest["segments"][:2]])
    check_statistics(store)
    store.optimize()
    check_statistics(store)
    assert not store.manifest["deletes"] and engine.count("main", {"match": {"title": "three"}}) == 2


def test_two_writers_lose_nothing(engine, spark):
    other = Engine(spark, engine.warehouse)
    engine.put_document("main", "doc", "a", {"title": "one"})
    other.put_document("main", "doc", "b", {"title": "two"})
    engine.put_document("main", "doc", "b", {"title": "three"})
    other.stores["main"].delete(spark.createDataFrame([("a",)], "doc_key string"))
    assert engine.count("main") == 1 == other.count("main") and other.get_document("main", "doc", "b") == {"title": "three"}
    check_statistics(engine.stores["main"])
    stale = Store(spark, engine.stores["main"].files.folder, engine.stores["main"].manifest, engine.stores["main"].number - 1)
    with pytest.raises(Conflict):
        stale._commit(next=99)
    # a writer that comes between another's look and its commit
    store, done = engine.stores["main"], []
    commit = store._commit

    def late(**changes):
        if not done:
            done.append(1)
            other.put_document("main", "doc", "c", {"title": "between"})
        commit(**changes)

    store._commit = late
    engine.put_document("main", "doc", "c", {"title": "after"})
    assert engine.count("main") == 2 == other.count("main") and other.get_document("main", "doc", "c") == {"title": "after"}
    check_statistics(other.stores["main"])


def test_a_snapshot_outlives_a_merge_until_purged(engine):
    for i in range(3):
        engine.put_document("main", "doc", str(i), {"title": "old"})
    store = engine.stores["main"]
    before = store.index()
    engine.optimize("main")
    engine.put_document("main", "doc", "0", {"title": "new"})
    assert search.count(before, {"match": {"title": "old"}}).first()["count"] == 3 and engine.count("main", {"match": {"title": "old"}}) == 2
    folders = set(store.files.folders())
    store.purge()
    assert set(store.files.folders()) == folders
    store.purge(older=-1)
    assert len(store.files.folders()) < len(folders) and engine.count("main", {"match": {"title": "old"}}) == 2 and not store.manifest["retired"]


def test_fields_can_be_removed(engine, spark):
    engine.put_document("main", "doc", "a", {"title": "one", "body": "two"})
    assert engine.remove_field("main", "body")["acknowledged"] and not engine.remove_field("main", "body")["acknowledged"]
    with pytest.raises(FieldValueError):
        engine.put_document("main", "doc", "b", {"body": "x"})
    assert engine.get_document("main", "doc", "a") == {"title": "one"}
    assert not engine.put_mapping("main", {"more": {"properties": {"body": {"type": "integer"}}}})["acknowledged"]
    assert engine.put_mapping("main", {"more": {"properties": {"body": {"type": "string", "store": True}}}})["acknowledged"]
    assert engine.count("main", {"match": {"body": "two"}}) == 0
    engine.put_document("main", "more", "c", {"body": "two"})
    assert engine.count("main", {"match": {"body": "two"}}) == 1 and engine.get_document("main", "doc", "a") == {"title": "one"}
    engine.optimize("main")
    assert engine.count("main", {"match": {"body": "two"}}) == 1 and engine.count("main", {"match": {"title": "one"}}) == 1


def test_stream(engine, spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text(body(("a", {"title": "one"}), ("b", {"title": "two"})))
    stream_bulk(engine, str(folder), f"{tmp_path}/checkpoint").awaitTermination()
    assert engine.count("main") == 2
    (folder / "2.json").write_text(body(("a", {"title": "changed"})))
    stream_bulk(engine, str(folder), f"{tmp_path}/checkpoint").awaitTermination()
    assert engine.count("main") == 2 and engine.count("main", {"match": {"title": "changed"}}) == 1
