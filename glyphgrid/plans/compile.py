"""Query trees to DataFrames: one pass over the postings that a query names.

The leaves' postings are read with pushed filters and grouped once by document,
a column for each leaf; matching and scoring are then plain expressions.  All
documents are read only where the tree can match one that has none of its terms.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgrid.functions.terms import after, begins_with, literal
from glyphgrid.operators.index import Index
from glyphgrid.plans.query import All, Conjunction, Disjunction, DisMax, Exclude, Filter, Nothing, Prefix, Query, Term

#: Beyond so many leaves they are joined as a table instead of written into the filter; results are the same.
INLINE_LEAVES = 48


class Unsupported(ValueError):
    pass


@dataclass(frozen=True)
class Bundle(Query):
    """A long list of terms, or a prefix, of which a document's matches are counted and their scores summed in the grouping."""

    number: int
    terms: tuple[Term | Prefix, ...]
    least: int


def bundled(q: Query, found: list[Bundle]) -> Query:
    """The tree with every leaf in a bundle: each list of terms in one of its own, each other term and prefix too."""
    if isinstance(q, (Conjunction, Disjunction)) and q.queries and all(isinstance(x, Term) for x in q.queries):
        distinct = len({leaf_key(x) for x in q.queries})
        found.append(Bundle(len(found), q.queries, distinct if isinstance(q, Conjunction) else 1))
        return found[-1]
    if isinstance(q, (Term, Prefix)):
        found.append(Bundle(len(found), (q,), 1))
        return found[-1]
    if isinstance(q, (Conjunction, Disjunction, DisMax)):
        return type(q)(tuple(bundled(x, found) for x in q.queries))
    if isinstance(q, Filter):
        return Filter(bundled(q.query, found), bundled(q.by, found))
    if isinstance(q, Exclude):
        return Exclude(bundled(q.query, found), bundled(q.what, found))
    return q


def leaves(q: Query, scored: bool = True) -> dict[tuple, bool]:
    """(kind, field, bytes, similarity) of all leaves, and whether any use of one is scored."""
    out: dict[tuple, bool] = {}

    def visit(q: Query, scored: bool) -> None:
        if isinstance(q, (Term, Prefix)):
            key = leaf_key(q)
            out[key] = out.get(key, False) or scored
        elif isinstance(q, (Conjunction, Disjunction, DisMax)):
            for x in q.queries:
                visit(x, scored)
        elif isinstance(q, Filter):
            visit(q.query, scored)
            visit(q.by, False)
        elif isinstance(q, Exclude):
            visit(q.query, scored)
            visit(q.what, False)

    visit(q, scored)
    return out


def leaf_key(q: Term | Prefix) -> tuple:
    return ("term", q.field, q.term, q.scorer.similarity) if isinstance(q, Term) else ("prefix", q.field, q.prefix, q.scorer.similarity)


def matches_without_terms(q: Query) -> bool:
    """Whether a document that has none of the query's terms matches."""
    if isinstance(q, All):
        return True
    if isinstance(q, Conjunction):
        return bool(q.queries) and all(map(matches_without_terms, q.queries))
    if isinstance(q, (Disjunction, DisMax)):
        return any(map(matches_without_terms, q.queries))
    if isinstance(q, Filter):
        return matches_without_terms(q.query) and matches_without_terms(q.by)
    if isinstance(q, Exclude):
        return matches_without_terms(q.query) and not matches_without_terms(q.what)
    return False


def match_column(q: Query, leaf: dict[tuple, Column]) -> Column:
    """Whether a document matches; leaf has a column for each leaf, null where it doesn't match.  An empty list matches nothing."""
    if isinstance(q, All):
        return F.lit(True)
    if isinstance(q, Nothing):
        return F.lit(False)
    if isinstance(q, (Term, Prefix)):
        return leaf[leaf_key(q)].isNotNull()
    if isinstance(q, Bundle):
        return F.coalesce(F.col(f"c{q.number}"), F.lit(0)) >= q.least
    if isinstance(q, (Conjunction, Disjunction, DisMax)):
        if not q.queries:
            return F.lit(False)
        each = [match_column(x, leaf) for x in q.queries]
        return reduce(lambda a, b: a & b if isinstance(q, Conjunction) else a | b, each)
    if isinstance(q, Filter):
        return match_column(q.query, leaf) & match_column(q.by, leaf)
    if isinstance(q, Exclude):
        return match_column(q.query, leaf) & ~match_column(q.what, leaf)
    raise Unsupported(type(q).__name__)


def score_column(q: Query, leaf: dict[tuple, Column]) -> Column:
    """Leaves by their similarity and boost; lists by the mean over all clauses, maximum for DisMax; filters add nothing."""
    if isinstance(q, All):
        return F.lit(float(q.score))
    if isinstance(q, (Term, Prefix)):
        return F.coalesce(leaf[leaf_key(q)], F.lit(0.0)) * q.scorer.boost
    if isinstance(q, Bundle):
        return F.coalesce(F.col(f"s{q.number}"), F.lit(0.0)) / float(len(q.terms))
    if isinstance(q, (Conjunction, Disjunction)) and q.queries:
        return reduce(lambda a, b: a + b, [score_column(x, leaf) for x in q.queries]) / float(len(q.queries))
    if isinstance(q, DisMax) and q.queries:
        return F.greatest(F.lit(0.0), *[score_column(x, leaf) for x in q.queries], F.lit(0.0))
    if isinstance(q, (Filter, Exclude)):
        return score_column(q.query, leaf)
    return F.lit(0.0)


def _is(key: tuple) -> Column:
    kind, name, value, _ = key
    return (F.col("field") == name) & (F.col("term") == literal(value) if kind == "term" else begins_with(F.col("term"), value))


def _scored_postings(index: Index, wanted: Column, by: dict[tuple, bool]) -> DataFrame:
    """Postings that any leaf names, with N, total tokens and df where a score is wanted."""
    found = index.postings.where(wanted)
    if not any(by.values()):
        return found
    terms = index.term_stats.where(wanted)
    # a row for each term that the query names, and one for each field
    terms = F.broadcast(terms) if all(k[0] == "term" for k in by) else terms
    return found.join(terms, ["field", "term"]).join(F.broadcast(index.field_stats), "field")


def matches(index: Index, query: Query, scored: bool = True, prefix_within_field: bool = False) -> DataFrame:
    """(doc_key, score) of the documents that match; without scores just (doc_key).

    A prefix leaf's score is the mean over all terms of the index that begin with
    it, those of other fields too unless prefix_within_field.
    """
    by = leaves(query, scored)
    keys = list(by)
    whole = matches_without_terms(query)
    if not keys:
        out = index.docs.select("doc_key").where(match_column(query, {}))
        return out.withColumn("score", score_column(query, {})) if scored else out
    columns: dict[tuple, Column] = {}
    if len(keys) <= INLINE_LEAVES:
        hits = _inline(index, by, prefix_within_field)
        columns = {k: F.col(f"s{i}") for i, k in enumerate(keys)}
    else:
        bundles: list[Bundle] = []
        query = bundled(query, bundles)
        hits = _joined(index, keys, bundles, any(by.values()), prefix_within_field)
    if whole:
        hits = index.docs.select("doc_key").join(hits, "doc_key", "left")
    found = hits.where(match_column(query, columns))
    return found.select("doc_key", score_column(query, columns).alias("score")) if scored else found.select("doc_key")


def _leaf_score(key: tuple) -> Column:
    return key[3].score(F.col("tf"), F.col("len_code"), F.col("n_tokens"), F.col("n_docs"), F.col("df"))


def _counts(index: Index, by: dict[tuple, bool], within: bool) -> DataFrame | None:
    """One row: for each scored prefix how many terms of the index begin with it."""
    prefixes = [(i, k) for i, k in enumerate(by) if k[0] == "prefix" and by[k]]
    if not prefixes:
        return None
    some = reduce(lambda a, b: a | b, [_is(k) if within else begins_with(F.col("term"), k[2]) for _, k in prefixes])
    terms = index.term_stats.where(some).select("field", "term")
    counted = [F.countDistinct(F.when(_is(k) if within else begins_with(F.col("term"), k[2]), F.col("term"))).alias(f"n{i}") for i, k in prefixes]
    return terms.agg(*counted)


def _inline(index: Index, by: dict[tuple, bool], within: bool) -> DataFrame:
    found = _scored_postings(index, reduce(lambda a, b: a | b, map(_is, by)), by)
    made = []
    for i, k in enumerate(by):
        value = F.when(_is(k), _leaf_score(k) if by[k] else F.lit(0.0))
        made.append((F.sum(value) if k[0] == "prefix" else F.max(value)).alias(f"s{i}"))
    if len(by) == 1 and next(iter(by))[0] == "term":
        # a document has a term's posting once, so nothing is grouped or shuffled
        (key, used) = next(iter(by.items()))
        return found.select("doc_key", (_leaf_score(key) if used else F.lit(0.0)).alias("s0"))
    hits = found.groupBy("doc_key").agg(*made)
    counts = _counts(index, by, within)
    if counts is not None:
        hits = hits.crossJoin(F.broadcast(counts))
        hits = hits.select("doc_key", *[(F.col(f"s{i}") / F.col(f"n{i}")).alias(f"s{i}") if f"n{i}" in counts.columns else F.col(f"s{i}") for i in range(len(by))])
    return hits


def _joined(index: Index, keys: list[tuple], bundles: list[Bundle], scored: bool, within: bool) -> DataFrame:
    """The same for many leaves: they meet the postings in an equi-join and are counted and summed by bundle.

    Prefixes meet the index's terms first, cut to the lengths that the query has,
    and go on as these terms.
    """
    spark = index.postings.sparkSession
    kinds = list(dict.fromkeys(k[3] for k in keys))
    weight: dict[tuple, float] = {}
    for b in bundles:
        for t in b.terms:  # a term that a list has twice scores twice and is found once
            kind, field, value, how = leaf_key(t)
            key = (b.number, kind, field, value, kinds.index(how))
            weight[key] = weight.get(key, 0.0) + t.scorer.boost
    columns = "bundle int, field string, term binary, how int, weight double"
    rows = {kind: [(n, field, bytearray(value), how, w) for (n, k, field, value, how), w in weight.items() if k == kind] for kind in ("term", "prefix")}
    # as long as the query's own text
    leaf = F.broadcast(spark.createDataFrame(rows["term"], columns))
    spans: dict[str, tuple[bytes, bytes | None]] = {}
    for kind, field, value, _ in keys:
        low, top = spans.get(field, (value, value))
        last = value if kind == "term" else after(value)
        spans[field] = (min(low, value), None if last is None or top is None else max(top, last))
    # a span of each field's terms reaches the scan, for lists whose terms are near each other
    inside = reduce(lambda a, b: a | b, [(F.col("field") == f) & (F.col("term") >= literal(low)) & (F.lit(True) if top is None else F.col("term") <= literal(top)) for f, (low, top) in spans.items()])
    postings = index.postings.where(inside)
    found = postings.join(leaf, ["field", "term"])
    if rows["prefix"]:
        prefix = F.broadcast(spark.createDataFrame(rows["prefix"], columns).withColumnRenamed("term", "start").withColumnRenamed("field", "of"))
        lengths = F.array(*[F.lit(n) for n in sorted({len(r[2]) for r in rows["prefix"]})])
        cut = index.term_stats.select("field", "term", F.explode(lengths).alias("n")).where(F.octet_length("term") >= F.col("n")).withColumn("start", F.substring("term", F.lit(1), F.col("n")))
        met = cut.join(prefix, "start")
        per = (met.where("field = of") if within else met).groupBy("bundle").agg(F.countDistinct("term").alias("count"))
        selected = met.where("field = of").join(F.broadcast(per), "bundle").select("bundle", "field", "term", "how", (F.col("weight") / F.col("count")).alias("weight"))
        found = found.unionByName(postings.join(selected, ["field", "term"]))
    score = F.lit(0.0)
    if scored:
        found = found.join(index.term_stats.where(inside), ["field", "term"]).join(F.broadcast(index.field_stats), "field")
        score = reduce(lambda a, i: F.when(F.col("how") == i, _leaf_score((None, None, None, kinds[i]))).otherwise(a), range(len(kinds)), F.lit(0.0)) * F.col("weight")
    per = found.groupBy("doc_key", "bundle").agg(F.count(F.lit(1)).alias("c"), F.sum(score).alias("s"))
    return per.groupBy("doc_key").agg(*[F.max(F.when(F.col("bundle") == b.number, F.col(x))).alias(f"{x}{b.number}") for b in bundles for x in "cs"])
