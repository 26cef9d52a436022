"""The logical query tree, built by hand or from JSON."""

from __future__ import annotations

from dataclasses import dataclass, replace

from glyphgrid.functions.similarity import Bm25, TfIdf


@dataclass(frozen=True)
class Scorer:
    similarity: Bm25 | TfIdf = Bm25()
    boost: float = 1.0


class Query:
    def boost(self, by: float) -> Query:
        """The tree with every leaf that scores multiplied; what only filters stays as it is."""
        return self if by == 1.0 else self._boosted(by)

    def _boosted(self, by: float) -> Query:
        return self

    def filter(self, by: Query) -> Query:
        return Filter(self, by)

    def exclude(self, what: Query) -> Query:
        return Exclude(self, what)


@dataclass(frozen=True)
class All(Query):
    score: float = 1.0

    def _boosted(self, by: float) -> Query:
        return All(self.score * by)


@dataclass(frozen=True)
class Nothing(Query):
    pass


class _Scored(Query):
    def _boosted(self, by: float) -> Query:
        return replace(self, scorer=replace(self.scorer, boost=self.scorer.boost * by))


@dataclass(frozen=True)
class Term(_Scored):
    field: str
    term: bytes
    scorer: Scorer = Scorer()


@dataclass(frozen=True)
class Prefix(_Scored):
    field: str
    prefix: bytes
    scorer: Scorer = Scorer()


class _Many(Query):
    def _boosted(self, by: float) -> Query:
        return type(self)(tuple(q.boost(by) for q in self.queries))


@dataclass(frozen=True)
class Conjunction(_Many):
    queries: tuple[Query, ...]


@dataclass(frozen=True)
class Disjunction(_Many):
    queries: tuple[Query, ...]


@dataclass(frozen=True)
class DisMax(_Many):
    queries: tuple[Query, ...]


@dataclass(frozen=True)
class Filter(Query):
    query: Query
    by: Query

    def _boosted(self, by: float) -> Query:
        return Filter(self.query.boost(by), self.by)


@dataclass(frozen=True)
class Exclude(Query):
    query: Query
    what: Query

    def _boosted(self, by: float) -> Query:
        return Exclude(self.query.boost(by), self.what)


def all_docs() -> Query:
    return All()


def term(field: str, value: bytes | str | bool | int) -> Query:
    from glyphgrid.functions.terms import term_of

    return Term(field, value if isinstance(value, bytes) else term_of(value))
