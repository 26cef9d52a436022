"""The JSON query language: thirteen keywords, read into Query trees.

Keys of an object are visited in sorted order, which decides the error that is
raised where several apply.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from glyphgrid.functions.analysis import Analyzer
from glyphgrid.functions.terms import term_of
from glyphgrid.plans.query import All, Conjunction, Disjunction, DisMax, Exclude, Filter, Nothing, Prefix, Query, Term

#: What a query needs to know of an index: the search analyzer by field, None for fields taken as they are.
Fields = Mapping[str, Analyzer | None]


class QueryError(ValueError):
    """kind is one of the names below; detail the key, keyword or field it is about."""

    def __init__(self, kind: str, detail: str | None = None):
        super().__init__(kind if detail is None else f"{kind}: {detail}")
        self.kind, self.detail = kind, detail

    def __eq__(self, other: object) -> bool:
        return isinstance(other, QueryError) and (self.kind, self.detail) == (other.kind, other.detail)

    __hash__ = ValueError.__hash__


def _object(x: Any) -> dict:
    if not isinstance(x, dict):
        raise QueryError("ExpectedObject")
    return x


def _single(x: Any) -> tuple[str, Any]:
    if len(_object(x)) != 1:
        raise QueryError("ExpectedSingleKey")
    return next(iter(x.items()))


def _string(x: Any) -> str:
    if not isinstance(x, str):
        raise QueryError("ExpectedString")
    return x


def _number(x: Any) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise QueryError("ExpectedFloat")
    return float(x)


def _operator(x: Any) -> str:
    if x not in ("or", "and") or not isinstance(x, str):
        raise QueryError("InvalidOperator")
    return x


def _value(x: Any) -> bytes | None:
    if isinstance(x, (str, bool)):
        return term_of(x)
    return term_of(x) if isinstance(x, int) and -(1 << 63) <= x < 1 << 63 else None


def _options(x: dict, **readers: Callable[[Any], Any]) -> dict[str, Any]:
    """Each key of x through its reader; others are errors."""
    out = {}
    for key in sorted(x):
        if key not in readers:
            raise QueryError("UnrecognisedKey", key)
        out[key] = readers[key](x[key])
    return out


def _need(options: dict, *keys: str) -> None:
    for key in keys:
        if key not in options:
            raise QueryError("ExpectedKey", key)


class Parser:
    """Reads queries for an index with these fields."""

    def __init__(self, fields: Fields):
        self.fields = fields
        self.keywords: dict[str, Callable[[Any], Query]] = {
            "match": self.match, "multi_match": self.multi_match, "match_all": self.match_all, "match_none": self.match_none,
            "term": self.term, "terms": self.terms, "in": self.terms, "prefix": self.prefix,
            "and": self.conjunction, "or": self.disjunction, "not": self.negation,
            "filtered": self.filtered, "constant_score": self.constant_score,
        }

    def parse(self, x: Any) -> Query:
        """The tree for decoded JSON, or for a JSON string."""
        keyword, body = _single(json.loads(x) if isinstance(x, str) else x)
        if keyword not in self.keywords:
            raise QueryError("UnrecognisedQueryType", keyword)
        return self.keywords[keyword](body)

    def _known(self, name: str) -> str:
        if name not in self.fields:
            raise QueryError("FieldDoesntExist", name)
        return name

    def _text(self, name: str, text: str, operator: str) -> Query:
        analyzer = self.fields[self._known(name)]
        found = [text] if analyzer is None else [t for t, _ in analyzer.tokens_of(text)]
        leaves = tuple(Term(name, term_of(t)) for t in found)
        if len(leaves) < 2:
            return leaves[0] if leaves else Nothing()
        return Conjunction(leaves) if operator == "and" else Disjunction(leaves)

    def match(self, x: Any) -> Query:
        name, body = _single(x)
        if isinstance(body, str):
            body = {"query": body}
        if not isinstance(body, dict):
            raise QueryError("ExpectedObjectOrString")
        got = _options(body, query=_string, operator=_operator, boost=_number)
        _need(got, "query")
        return self._text(name, got["query"], got.get("operator", "or")).boost(got.get("boost", 1.0))

    def multi_match(self, x: Any) -> Query:
        def fields(value: Any) -> list[tuple[str, float]]:
            if not isinstance(value, list):
                raise QueryError("ExpectedArray")
            return [_boosted_name(v) for v in value]

        got = _options(_object(x), query=_string, fields=fields, operator=_operator, boost=_number)
        _need(got, "fields", "query")
        each = tuple(self._text(name, got["query"], got.get("operator", "or")).boost(by) for name, by in got["fields"])
        whole = (each[0] if each else Nothing()) if len(each) < 2 else DisMax(each)
        return whole.boost(got.get("boost", 1.0))

    def match_all(self, x: Any) -> Query:
        return All(_options(_object(x), boost=_number).get("boost", 1.0))

    def match_none(self, x: Any) -> Query:
        _options(_object(x))
        return Nothing()

    def term(self, x: Any) -> Query:
        def value(v: Any) -> bytes:
            if _value(v) is None:
                raise QueryError("InvalidValue")
            return _value(v)

        name, body = _single(x)
        if not isinstance(body, dict):
            body = {} if _value(body) is None else {"value": body}
        got = _options(body, value=value, boost=_number)
        _need(got, "value")
        return Term(self._known(name), got["value"]).boost(got.get("boost", 1.0))

    def terms(self, x: Any) -> Query:
        name, values = _single(x)
        if not isinstance(values, list):
            raise QueryError("ExpectedArray")
        return Disjunction(tuple(Term(self._known(name), v) for v in map(_value, values) if v is not None))

    def prefix(self, x: Any) -> Query:
        name, body = _single(x)
        if isinstance(body, str):
            body = {"value": body}
        if not isinstance(body, dict):
            raise QueryError("ExpectedObjectOrString")
        got = _options(body, value=lambda v: v, prefix=lambda v: v, boost=_number)
        given = [got[k] for k in sorted(got) if k != "boost"]
        if not given:
            raise QueryError("ExpectedKey", "value")
        return Prefix(self._known(name), term_of(_string(given[-1]))).boost(got.get("boost", 1.0))

    def _list(self, x: Any) -> tuple[Query, ...]:
        if not isinstance(x, list):
            raise QueryError("ExpectedArray")
        return tuple(self.parse(_object(q)) for q in x)

    def conjunction(self, x: Any) -> Query:
        return Conjunction(self._list(x))

    def disjunction(self, x: Any) -> Query:
        return Disjunction(self._list(x))

    def negation(self, x: Any) -> Query:
        return Exclude(All(), self.parse(_object(x)))

    def filtered(self, x: Any) -> Query:
        got = _options(_object(x), filter=lambda q: self.parse(_object(q)), query=lambda q: self.parse(_object(q)))
        _need(got, "filter")
        return Filter(got.get("query", All()), got["filter"])

    def constant_score(self, x: Any) -> Query:
        got = _options(_object(x), filter=lambda q: self.parse(_object(q)), boost=_number)
        _need(got, "filter", "boost")
        return Filter(All(got["boost"]), got["filter"])


def _boosted_name(x: Any) -> tuple[str, float]:
    name, mark, by = _string(x).partition("^")
    try:
        return name, float(by.split("^")[0]) if mark else 1.0
    except ValueError:
        return name, 1.0
