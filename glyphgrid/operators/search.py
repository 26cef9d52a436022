"""Search, count and collectors over an Index."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrid.operators.index import Index
from glyphgrid.plans.compile import matches
from glyphgrid.plans.dsl import Parser
from glyphgrid.plans.query import All, Query


class Collector(Protocol):
    """What becomes of matches: needs_score tells whether they carry one."""

    needs_score: bool

    def collect(self, found: DataFrame) -> DataFrame: ...


class TotalCount:
    """One row (count)."""

    needs_score = False

    def collect(self, found: DataFrame) -> DataFrame:
        return found.agg(F.count(F.lit(1)).alias("count"))


class TopScore:
    """The best by score, ties by key, after skipping some."""

    needs_score = True

    def __init__(self, size: int = 10, skip: int = 0):
        self.size, self.skip = size, skip

    def collect(self, found: DataFrame) -> DataFrame:
        return found.orderBy(F.desc("score"), "doc_key").offset(self.skip).limit(self.size)


def read(index: Index, query: Query | dict | str | None) -> Query:
    """A tree as it is, JSON parsed for the index, nothing as all documents."""
    if query is None:
        return All()
    return query if isinstance(query, Query) else Parser(index.searchable).parse(query)


def run(index: Index, query: Query | dict | str | None, collector: Collector) -> DataFrame:
    return collector.collect(matches(index, read(index, query), scored=collector.needs_score))


def count(index: Index, query: Query | dict | str | None = None) -> DataFrame:
    return run(index, query, TotalCount())


def search(index: Index, query: Query | dict | str, from_: int = 0, size: int = 10, fields: Sequence[str] = ()) -> DataFrame:
    """(doc_key, score, the stored fields asked for) of a page of hits, best first.

    Names that aren't stored are passed over.  The page is cut before stored
    fields are fetched, so only its documents are read.
    """
    top = run(index, query, TopScore(size, from_))
    names = [n for n in fields if n in index.docs.columns and n != "doc_key"]
    if not names:
        return top
    return top.join(index.docs.select("doc_key", *names), "doc_key").orderBy(F.desc("score"), "doc_key").select("doc_key", "score", *names)


def response(page: DataFrame, total: int | None = None) -> dict[str, Any]:
    """A page as a search response; what it holds comes to the driver, from + size rows at most."""
    rows = [r.asDict(recursive=True) for r in page.collect()]
    names = [c for c in page.columns if c not in ("doc_key", "score")]
    hits = [{"_id": r["doc_key"], "_score": r["score"], "fields": {n: [] if r[n] is None else [r[n]] for n in names}} for r in rows]
    return {"hits": {"total": len(hits) if total is None else total, "hits": hits}}
