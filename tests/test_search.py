import math
import random

import pytest
from pyspark.sql import functions as F

from glyphgrid.functions.similarity import Bm25, TfIdf
from glyphgrid.functions.terms import term_of
from glyphgrid.operators import search, sets
from glyphgrid.operators.index import FieldValueError, build
from glyphgrid.plans.compile import matches, matches_without_terms
from glyphgrid.plans.mapping import parse_index, parse_mapping
from glyphgrid.plans.query import All, Conjunction, Disjunction, DisMax, Exclude, Filter, Nothing, Prefix, Scorer, Term

MAPPING = parse_mapping({"properties": {"title": {"type": "string", "store": True}, "body": {"type": "string"}, "tag": {"type": "string", "index": "not_analyzed", "store": True}, "n": {"type": "integer", "store": True}, "ok": {"type": "boolean"}, "hidden": {"type": "string", "index": "no", "store": True}}})
VOCABULARY = ["a", "ab", "abc", "b", "bc", "cd"]


class Plain:
    """Documents searched one by one in Python."""

    def __init__(self, docs):
        self.docs = {}
        for key, fields in docs.items():
            self.docs[key] = {f: toks for f, toks in fields.items() if toks is not None}
        self.dictionary = {t for d in self.docs.values() for toks in d.values() for t in toks}

    def matches(self, q, d):
        match q:
            case All():
                return True
            case Nothing():
                return False
            case Term():
                return q.term in self.docs[d].get(q.field, [])
            case Prefix():
                return any(t.startswith(q.prefix) for t in self.docs[d].get(q.field, []))
            case Conjunction():
                return bool(q.queries) and all(self.matches(x, d) for x in q.queries)
            case Disjunction() | DisMax():
                return any(self.matches(x, d) for x in q.queries)
            case Filter():
                return self.matches(q.query, d) and self.matches(q.by, d)
            case Exclude():
                return self.matches(q.query, d) and not self.matches(q.what, d)

    def leaf(self, field, term, scorer, d):
        toks = self.docs[d].get(field, [])
        if term not in toks:
            return 0.0
        having = [x[field] for x in self.docs.values() if field in x]
        df = sum(term in x for x in having)
        tf, idf = math.log(toks.count(term) + 1) + 1, math.log((len(having) + 1) / (df + 1)) + 1
        if isinstance(scorer.similarity, TfIdf):
            return tf * idf * scorer.boost
        root = math.floor((math.sqrt(len(toks)) - 1) * 3) / 3 + 1
        average = math.sqrt((sum(map(len, having)) + 1) / (len(having) + 1))
        return scorer.boost * idf * 2.2 * (tf / (tf + 1.2 * (0.25 + 0.75 * root / average) + 1))

    def score(self, q, d):
        match q:
            case All():
                return q.score
            case Term():
                return self.leaf(q.field, q.term, q.scorer, d)
            case Prefix():
                selected = [t for t in self.dictionary if t.startswith(q.prefix)]
                return sum(self.leaf(q.field, t, q.scorer, d) for t in selected) / len(selected) if selected else 0.0
            case Conjunction() | Disjunction():
                return sum(self.score(x, d) for x in q.queries) / len(q.queries) if q.queries else 0.0
            case DisMax():
                return max([0.0, *(self.score(x, d) for x in q.queries)])
            case Filter() | Exclude():
                return self.score(q.query, d)
        return 0.0

    def run(self, q):
        return {d: self.score(q, d) for d in self.docs if self.matches(q, d)}


@pytest.fixture(scope="module")
def both(spark):
    rng, rows, plain = random.Random(3), [], {}
    for i in range(40):
        title = None if i % 7 == 0 else " ".join(rng.choices(VOCABULARY, k=rng.randrange(0, 4)))
        body = None if i % 11 == 3 else " ".join(rng.choices(VOCABULARY, k=rng.randrange(0, 30)))
        tag, n, ok = rng.choice([None, "a", "A b"]), rng.choice([None, 1, -5]), rng.choice([None, True, False])
        rows.append((i, title, body, tag, n, ok, "secret"))
        split = lambda s: None if s is None else [w.encode() for w in s.lower().split()]
        every = " ".join(x for x in (body, tag, title) if x is not None)
        plain[str(i)] = {"title": split(title), "body": split(body), "tag": None if tag is None else [tag.encode()], "n": None if n is None else [term_of(n)], "ok": None if ok is None else [term_of(ok)], "_all": split(every)}
    df = spark.createDataFrame(rows, "id bigint, title string, body string, tag string, n bigint, ok boolean, hidden string")
    index = build(df, MAPPING, "id")
    for name in ("docs", "lengths", "postings"):
        getattr(index, name).persist()
    return index, Plain(plain)


def tree(rng, depth):
    kind = rng.choice(["term", "term", "prefix", "all", "none"] if depth == 0 else ["and", "or", "max", "filter", "exclude", "term"])
    scorer = Scorer(rng.choice([Bm25(), TfIdf()]), rng.choice([1.0, 2.0, -1.0]))
    sub = lambda: tree(rng, depth - 1)
    match kind:
        case "term":
            field = rng.choice(["title", "body", "_all", "tag", "n", "ok"])
            value = {"tag": rng.choice(["a", "A b"]), "n": rng.choice([1, -5, 9]), "ok": True}.get(field, rng.choice([*VOCABULARY, "zz"]))
            return Term(field, term_of(value), scorer)
        case "prefix":
            return Prefix(rng.choice(["title", "body", "tag"]), rng.choice([b"a", b"ab", b"", b"zz"]), scorer)
        case "all":
            return All(rng.choice([1.0, 0.5]))
        case "none":
            return Nothing()
        case "filter":
            return Filter(sub(), sub())
        case "exclude":
            return Exclude(sub(), sub())
    many = tuple(sub() for _ in range(rng.randrange(0, 4)))
    return {"and": Conjunction, "or": Disjunction, "max": DisMax}[kind](many)


def test_random_trees_match_a_plain_evaluator(both):
    index, plain = both
    rng = random.Random(11)
    for _ in range(45):
        q = tree(rng, rng.choice([0, 1, 2, 3]))
        want = plain.run(q)
        got = {r["doc_key"]: r["score"] for r in matches(index, q).collect()}
        assert set(got) == set(want), q
        assert all(abs(got[d] - want[d]) < 1e-9 for d in want), q
        assert search.count(index, q).first()["count"] == len(want)


def test_long_lists_match_too(both):
    index, plain = both
    terms = tuple(Term("body", f"x{i}".encode(), Scorer(boost=2.0)) for i in range(60)) + tuple(Term("body", v.encode()) for v in VOCABULARY) + (Term("body", b"a"),)
    for q in (Disjunction(terms), Filter(Disjunction(terms), Conjunction((Term("title", b"a"), Term("title", b"b")))), Exclude(All(3.0), Disjunction(terms)), DisMax((Disjunction(terms), Term("tag", b"a"), Nothing()))):
        want = plain.run(q)
        got = {r["doc_key"]: r["score"] for r in matches(index, q).collect()}
        assert set(got) == set(want) and all(abs(got[d] - want[d]) < 1e-9 for d in want)
        assert {r["doc_key"] for r in matches(index, q, scored=False).collect()} == set(want)


def test_trees_of_many_leaves_match_whatever_they_hold(both, monkeypatch):
    """Prefixes and several similarities among more leaves than are written into the filter."""
    index, plain = both
    rng = random.Random(5)
    monkeypatch.setattr("glyphgrid.plans.compile.INLINE_LEAVES", 1)
    trees = [tree(rng, d) for d in (1, 2, 3, 3, 3, 3)]
    many = tuple(Prefix("body", f"{v}{i}".encode(), Scorer(rng.choice([Bm25(), TfIdf()]), 2.0)) for i in range(12) for v in VOCABULARY[:3]) + tuple(Prefix("body", v.encode()) for v in ["", *VOCABULARY])
    trees += [Disjunction(many + (Term("tag", b"a", Scorer(TfIdf())), Term("tag", b"a"))), Conjunction((Prefix("body", b"a"), Prefix("title", b"a", Scorer(TfIdf())))), Exclude(All(), Disjunction(many[-3:])), Prefix("body", b"a")]
    for q in trees:
        want = plain.run(q)
        got = {r["doc_key"]: r["score"] for r in matches(index, q).collect()}
        assert set(got) == set(want), q
        assert all(abs(got[d] - want[d]) < 1e-9 for d in want), q
        assert search.count(index, q).first()["count"] == len(want)
    within = matches(index, Disjunction((Prefix("tag", b"a"), Term("body", b"a"))), prefix_within_field=True)
    monkeypatch.undo()
    again = matches(index, Disjunction((Prefix("tag", b"a"), Term("body", b"a"))), prefix_within_field=True)
    close = lambda df: sorted((r["doc_key"], round(r["score"], 9)) for r in df.collect())
    assert close(within) == close(again)


def test_a_single_term_needs_no_shuffle_of_postings(both, tmp_path):
    from glyphgrid.sources.shared import keep

    kept = keep(both[0], f"{tmp_path}/index")
    plan = matches(kept, Term("body", b"ab"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(doc_key" not in plan and "SortMergeJoin" not in plan, plan


def test_which_queries_need_all_documents():
    a, b = Term("f", b"a"), Term("f", b"b")
    assert matches_without_terms(Exclude(All(), a)) and matches_without_terms(Disjunction((a, All())))
    for q in (a, Filter(All(), a), Exclude(a, b), Conjunction((All(), a)), Conjunction(()), Exclude(All(), Exclude(All(), a)), Nothing()):
        assert not matches_without_terms(q)


def test_filters_reach_the_scan_and_top_k_is_one_step(spark, both, tmp_path):
    from glyphgrid.sources.shared import keep

    kept = keep(both[0], f"{tmp_path}/index")
    plan = search.search(kept, {"match": {"body": "ab"}}, 3, 5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(field,body)" in plan and "EqualTo(term," in plan
    plan = matches(kept, Prefix("body", b"ab"))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(term," in plan and "LessThan(term," in plan
    assert "docs" not in [f.split("/")[-2] for f in search.count(kept, {"match": {"body": "ab"}}).inputFiles()]


def test_pages_and_stored_fields(both):
    index, plain = both
    q = {"match": {"body": "ab cd"}}
    want = sorted(plain.run(search.read(index, q)).items(), key=lambda x: (-round(x[1], 9), x[0]))
    page = search.search(index, q, from_=2, size=5, fields=("title", "n", "body", "nope", "hidden"))
    assert page.columns == ["doc_key", "score", "title", "n", "hidden"]
    got = page.collect()
    assert [r["doc_key"] for r in got] == [d for d, _ in want[2:7]]
    out = search.response(page)
    assert out["hits"]["total"] == 5 and out["hits"]["hits"][0]["_id"] == got[0]["doc_key"] and out["hits"]["hits"][0]["fields"]["hidden"] == ["secret"]
    assert search.search(index, q, size=0).count() == 0
    assert search.search(index, {"match_all": {}}, size=3).select("doc_key").collect() == [(k,) for k in sorted(map(str, range(40)))[:3]]


def test_statistics(both):
    index, plain = both
    got = {r["field"]: (r["n_docs"], r["n_tokens"]) for r in index.field_stats.collect()}
    want = {f: (sum(f in d for d in plain.docs.values()), sum(len(d.get(f, [])) for d in plain.docs.values())) for f in ("title", "body", "tag", "n", "ok", "_all")}
    assert got == want and got["_all"][0] == 40


def test_sets(both):
    index, plain = both
    a, b = sets.having(index, "body", b"a"), sets.having(index, "title", b"b")
    keys = lambda df: {r["doc_key"] for r in df.collect()}
    x, y = keys(a), keys(b)
    assert keys(sets.both(a, b)) == x & y and keys(sets.either(a, b)) == x | y and keys(sets.without(a, b)) == x - y
    assert keys(sets.complement(index, a)) == set(plain.docs) - x
    assert keys(sets.fold(index, "and", [a, b, a])) == x & y and keys(sets.fold(index, "or", [])) == set()


def test_arrays_positions_and_grams(spark):
    settings, mappings = parse_index({"settings": {"analysis": {"filter": {"g": {"type": "nGram", "min_gram": 1, "max_gram": 1}}, "analyzer": {"g": {"type": "custom", "tokenizer": "standard", "filter": ["g"]}}}}, "mappings": {"m": {"properties": {"w": {"type": "string", "store": True}, "g": {"type": "string", "analyzer": "g"}}}}})
    df = spark.createDataFrame([("k", ["one two", None, "", "one"], "aab a"), ("z", [], None)], "id string, w array<string>, g string")
    index = build(df, mappings["m"], "id", settings)
    tf = {(r["field"], bytes(r["term"]).decode()): r["tf"] for r in index.postings.where("doc_key = 'k'").collect()}
    assert tf[("w", "one")] == 2 and tf[("w", "two")] == 1 and tf[("g", "a")] == 2 and tf[("g", "b")] == 1
    lengths = {(r["doc_key"], r["field"]): r["n_tokens"] for r in index.lengths.collect()}
    assert lengths[("k", "w")] == 3 and lengths[("z", "w")] == 0 and ("z", "g") not in lengths and lengths[("k", "g")] == 3
    assert index.docs.where("doc_key = 'k'").first()["w"] == "one two  one"


def test_strict_columns(spark):
    for kind, value in (("n string", "1"), ("other string", "x"), ("n double", 1.5), ("title struct<a:int>", (1,))):
        with pytest.raises(FieldValueError):
            build(spark.createDataFrame([(1, value)], f"id bigint, {kind}"), MAPPING, "id")
    df = spark.createDataFrame([(1, "yes"), (2, "no"), (3, "true"), (4, None)], "id bigint, ok string")
    got = {(r["doc_key"], bytes(r["term"])) for r in build(df, MAPPING, "id").postings.where(F.col("field") == "ok").collect()}
    assert got == {("1", b"t"), ("2", b"f"), ("3", b"f")}
