import pytest

from glyphgrid.functions.analysis import STANDARD
from glyphgrid.plans.dsl import Parser, QueryError
from glyphgrid.plans.query import All, Conjunction, Disjunction, DisMax, Exclude, Filter, Nothing, Prefix, Query, Scorer, Term

P = Parser({"author": STANDARD, "press": STANDARD, "shelf": STANDARD, "genre": STANDARD, "note": STANDARD, "raw": None})


def t(field, term, boost=1.0):
    return Term(field, term.encode() if isinstance(term, str) else term, Scorer(boost=boost))


CASES = [
    ({"match": {"author": {"query": "press"}}}, t("author", "press")),
    ({"match": {"author": "press shelf"}}, Disjunction((t("author", "press"), t("author", "shelf")))),
    ({"match": {"author": {"query": "press Shelf", "operator": "and"}}}, Conjunction((t("author", "press"), t("author", "shelf")))),
    ({"match": {"author": {"query": "press shelf", "boost": 2.0}}}, Disjunction((t("author", "press", 2.0), t("author", "shelf", 2.0)))),
    ({"match": {"author": " - "}}, Nothing()),
    ({"match": {"raw": "Press Shelf"}}, t("raw", "Press Shelf")),
    ({"multi_match": {"boost": 2.0, "fields": ["press^2", "shelf^1.0"], "query": "author"}}, DisMax((t("press", "author", 4.0), t("shelf", "author", 2.0)))),
    ({"multi_match": {"query": "a b", "fields": ["press^x", "shelf"], "operator": "and"}}, DisMax((Conjunction((t("press", "a"), t("press", "b"))), Conjunction((t("shelf", "a"), t("shelf", "b")))))),
    ({"multi_match": {"query": "a", "fields": []}}, Nothing()),
    ({"multi_match": {"query": "a", "fields": ["author^3"]}}, t("author", "a", 3.0)),
    ({"match_all": {}}, All(1.0)), ({"match_all": {"boost": 3}}, All(3.0)), ({"match_none": {}}, Nothing()),
    ({"term": {"author": "Press"}}, t("author", "Press")), ({"term": {"author": {"value": 123}}}, t("author", b"\x7b" + bytes(7))),
    ({"term": {"author": True}}, t("author", "t")), ({"term": {"author": {"value": "x", "boost": 2}}}, t("author", "x", 2.0)),
    ({"terms": {"author": ["press", None, 1.5, [], {}, "shelf"]}}, Disjunction((t("author", "press"), t("author", "shelf")))),
    ({"in": {"author": []}}, Disjunction(())),
    ({"prefix": {"author": "Ba"}}, Prefix("author", b"Ba")), ({"prefix": {"author": {"prefix": "b", "boost": 2}}}, Prefix("author", b"b", Scorer(boost=2.0))),
    ({"prefix": {"author": {"value": "v", "prefix": "p"}}}, Prefix("author", b"v")),
    ({"and": [{"term": {"genre": "author"}}, {"term": {"genre": "press"}}]}, Conjunction((t("genre", "author"), t("genre", "press")))),
    ({"or": []}, Disjunction(())), ({"not": {"term": {"genre": "author"}}}, Exclude(All(), t("genre", "author"))),
    ({"filtered": {"filter": {"term": {"note": "wide"}}, "query": {"term": {"note": "deep"}}}}, Filter(t("note", "deep"), t("note", "wide"))),
    ({"filtered": {"filter": {"term": {"note": "wide"}}}}, Filter(All(), t("note", "wide"))),
    ({"constant_score": {"filter": {"term": {"genre": "author"}}, "boost": 2.0}}, Filter(All(2.0), t("genre", "author"))),
]


@pytest.mark.parametrize("json,tree", CASES, ids=[str(c[0])[:50] for c in CASES])
def test_trees(json, tree):
    assert P.parse(json) == tree


ERRORS = [
    ([], "ExpectedObject", None), ({}, "ExpectedSingleKey", None), ({"match": {}, "term": {}}, "ExpectedSingleKey", None), ({"fuzzy": {}}, "UnrecognisedQueryType", "fuzzy"),
    ({"match": "x"}, "ExpectedObject", None), ({"match": {"author": 1}}, "ExpectedObjectOrString", None), ({"match": {"author": {"query": 1}}}, "ExpectedString", None),
    ({"match": {"author": {"boost": 1}}}, "ExpectedKey", "query"), ({"match": {"author": {"query": "a", "boost": "x"}}}, "ExpectedFloat", None),
    ({"match": {"author": {"query": "a", "operator": "OR"}}}, "InvalidOperator", None), ({"match": {"author": {"query": "a", "zz": 1}}}, "UnrecognisedKey", "zz"),
    ({"match": {"author": {"query": "a"}, "press": "b"}}, "ExpectedSingleKey", None), ({"match": {"nope": "a"}}, "FieldDoesntExist", "nope"),
    ({"multi_match": {"query": "a"}}, "ExpectedKey", "fields"), ({"multi_match": {"fields": ["author"]}}, "ExpectedKey", "query"), ({"multi_match": {"fields": "author", "query": "a"}}, "ExpectedArray", None),
    ({"multi_match": {"fields": [1], "query": "a"}}, "ExpectedString", None), ({"match_all": {"boost": True}}, "ExpectedFloat", None), ({"match_all": {"x": 1}}, "UnrecognisedKey", "x"),
    ({"match_none": {"boost": 1}}, "UnrecognisedKey", "boost"), ({"match_none": 1}, "ExpectedObject", None),
    ({"term": {"author": {"value": None}}}, "InvalidValue", None), ({"term": {"author": {"value": 1.5}}}, "InvalidValue", None), ({"term": {"author": None}}, "ExpectedKey", "value"),
    ({"term": {"author": [1]}}, "ExpectedKey", "value"), ({"term": {"author": {}}}, "ExpectedKey", "value"), ({"terms": {"author": "a"}}, "ExpectedArray", None), ({"in": {}}, "ExpectedSingleKey", None),
    ({"prefix": {"author": 1}}, "ExpectedObjectOrString", None), ({"prefix": {"author": {"value": 1}}}, "ExpectedString", None), ({"prefix": {"author": {"boost": 1}}}, "ExpectedKey", "value"),
    ({"prefix": {"author": {"value": "a", "x": 1}}}, "UnrecognisedKey", "x"), ({"and": {}}, "ExpectedArray", None), ({"or": [1]}, "ExpectedObject", None), ({"not": []}, "ExpectedObject", None),
    ({"filtered": {"query": {"match_all": {}}}}, "ExpectedKey", "filter"), ({"filtered": {"filter": {"match_all": {}}, "x": 1}}, "UnrecognisedKey", "x"),
    ({"constant_score": {"filter": {"match_all": {}}}}, "ExpectedKey", "boost"), ({"constant_score": {"boost": 1}}, "ExpectedKey", "filter"),
    ({"constant_score": {"boost": "x", "filter": {"fuzzy": {}}}}, "ExpectedFloat", None),
]


@pytest.mark.parametrize("json,kind,detail", ERRORS, ids=[str(c[0])[:50] for c in ERRORS])
def test_errors(json, kind, detail):
    with pytest.raises(QueryError) as e:
        P.parse(json)
    assert e.value == QueryError(kind, detail)


def test_boost_reaches_what_scores_and_leaves_filters_alone():
    q: Query = DisMax((Filter(t("author", "a"), t("author", "b")), Exclude(All(2.0), t("author", "c")), Nothing())).boost(3.0)
    assert q == DisMax((Filter(t("author", "a", 3.0), t("author", "b")), Exclude(All(6.0), t("author", "c")), Nothing()))
    assert t("author", "a").filter(All()).exclude(Nothing()) == Exclude(Filter(t("author", "a"), All()), Nothing())
    assert P.parse('{"match_all": {}}') == All()
