"""Bulk bodies and documents become Python objects a few megabytes at a time."""

import json

import pyarrow as pa

from glyphgrid.plans.mapping import parse_mapping
from glyphgrid.sources import documents


def test_lines_are_those_of_split():
    for body in ("", "\n", "a\nb", "a\n\nb\n", " a\nb\r\n"):
        assert list(documents._lines(body)) == body.split("\n")


def test_slices_are_whole_and_bounded():
    batch = pa.RecordBatch.from_pydict({"document": ["x" * n for n in (0, 10, 5000, 30, 40)] + [None, "y" * 900], "n": list(range(7))})
    parts = list(documents._slices(batch, "document", 1200))
    assert [n for p in parts for n in p.column("n").to_pylist()] == list(range(7))
    assert len(parts) > 2 and all(p.num_rows == 1 or sum(len(x or "") for x in p.column("document").to_pylist()) <= 1200 for p in parts)


def test_large_bodies_give_all_their_documents_in_order(spark, monkeypatch):
    monkeypatch.setattr(documents, "HELD", 5000)
    action = lambda i: json.dumps({"index": {"_index": "a", "_type": "d", "_id": str(i)}})
    bodies = ["\n".join(f"{action(b * 1000 + i)}\n{json.dumps({'t': 'word ' * (i % 50)})}" for i in range(300)) for b in range(3)]
    found = documents.bulk(spark.createDataFrame([(b,) for b in bodies], "value string").coalesce(1))
    rows = documents.parse_documents(found.select("id", "line", "document"), parse_mapping({"properties": {"t": {"type": "string"}}})).collect()
    assert [(r["_key"], r["line"], r["t"]) for r in rows] == [(str(b * 1000 + i), 2 * i, ["word " * (i % 50)]) for b in range(3) for i in range(300)]
