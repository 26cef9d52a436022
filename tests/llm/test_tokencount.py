import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphgrid.llm import tokencount
from tests.llm.conftest import words

ENC = tokencount.encoding(tokencount.vocabulary())[0]


def chunked(text, chunk, overlap):
    parts = tokencount.spans(len(text), chunk, overlap)
    out = []
    for i, (s, e) in enumerate(parts):
        first, last = (s + 2 * overlap if i else s), (e - 2 * overlap if i < len(parts) - 1 else e)
        n, found = tokencount.boundaries(text[s:e], s, first, last, tokencount.vocabulary())
        out.append((i, n, [x for x in found if x[0] < first], [x for x in found if x[0] > last]))
    return tokencount.splice(out)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abc  \n\t.,'!9ß字。 　")), max_size=400), st.integers(8, 60), st.integers(2, 12))
def test_spliced_counts_are_whole_counts(text, chunk, overlap):
    got = chunked(text, chunk, overlap)
    assert got is None or got == len(ENC.encode_ordinary(text))


def test_prose_always_aligns():
    text = " ".join(words(random.Random(1), 5000))
    assert chunked(text, 500, 40) == len(ENC.encode_ordinary(text))


def test_documents_of_every_kind(spark, edge, edge_rows, empty):
    rows = [(i, t) for i, t, _ in edge_rows] + [(20, "ab'll " * 3000), (21, " " * 9000 + "a"), (22, "字。漢字、" * 2000), (23, "12" * 4000 + " end"), (24, "字" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = tokencount.count_tokens(docs, chunk=1000, overlap=16).collect()
    want = sorted(((i, len(ENC.encode_ordinary(t or ""))) for i, t in rows), key=key)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=key) == want
    assert max(r["widened"] for r in got) > 0 and max(r["n_chunks"] for r in got) > 100
    assert tokencount.count_tokens(empty).count() == 0
    assert tokencount.count_tokens(edge).count() == len(edge_rows)


def test_widening_ends_with_one_chunk():
    assert tokencount.spans(5000, 1000, 3000) == [(0, 5000)]
    assert tokencount.spans(900, 1000, 10) == [(0, 900)]
    parts = tokencount.spans(5000, 1000, 10)
    assert parts[0] == (0, 1010) and parts[-1] == (3990, 5000) and all(a[1] - b[0] == 20 for a, b in zip(parts, parts[1:]))


def test_missing_vocabulary_is_an_error():
    with pytest.raises(OSError):
        tokencount.vocabulary("/nowhere")
