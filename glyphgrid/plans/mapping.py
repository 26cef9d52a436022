"""Mappings and index settings: JSON to frozen dataclasses and back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from glyphgrid.functions.analysis import ASCII_FOLDING, LOWERCASE, LOWERCASE_TOKENIZER, STANDARD, STANDARD_TOKENIZER, Analyzer, Grams, TokenFilter, Tokenizer

ALL = "_all"
SPARK = {"string": T.StringType(), "integer": T.LongType(), "boolean": T.BooleanType(), "date": T.TimestampType()}


class MappingError(ValueError):
    """kind names the rule, detail what broke it, path the properties or components it is in."""

    def __init__(self, kind: str, detail: Any = None, path: tuple[str, ...] = ()):
        super().__init__(": ".join([*path, kind, *([str(detail)] if detail is not None else [])]))
        self.kind, self.detail, self.path = kind, detail, path

    def under(self, name: str) -> MappingError:
        return MappingError(self.kind, self.detail, (name, *self.path))


def _object(x: Any) -> dict:
    if not isinstance(x, dict):
        raise MappingError("ExpectedObject")
    return x


def _string(x: Any) -> str:
    if not isinstance(x, str):
        raise MappingError("ExpectedString")
    return x


def _flag(x: Any) -> bool:
    if x in ("yes", "no"):
        return x == "yes"
    if not isinstance(x, bool):
        raise MappingError("ExpectedBoolean")
    return x


def _only(x: dict, *allowed: str) -> None:
    if other := sorted(set(x) - set(allowed)):
        raise MappingError("UnrecognisedKeys", other)


def _key(x: dict, name: str) -> Any:
    if name not in x:
        raise MappingError("ExpectedKey", name)
    return x[name]


@dataclass(frozen=True)
class Settings:
    """Named tokenizers, filters and analyzers of an index, the built-in ones among them."""

    tokenizers: dict[str, Tokenizer] = field(default_factory=lambda: {"standard": STANDARD_TOKENIZER, "lowercase": LOWERCASE_TOKENIZER})
    filters: dict[str, TokenFilter] = field(default_factory=lambda: {"asciifolding": ASCII_FOLDING, "lowercase": LOWERCASE})
    analyzers: dict[str, Analyzer] = field(default_factory=lambda: {"standard": STANDARD})

    def default(self, use: str) -> Analyzer:
        """The analyzer named default_index or default_search, else default, else the standard one."""
        return self.analyzers.get(f"default_{use}", self.analyzers.get("default", STANDARD))


@dataclass(frozen=True)
class Field:
    type: str = "string"
    indexed: bool = True
    analyzed: bool = True
    stored: bool = False
    in_all: bool = True
    boost: float = 1.0  # kept and shown, not used in scores
    analyzer: str | None = None
    index_analyzer: str | None = None
    search_analyzer: str | None = None

    def use(self, settings: Settings, use: str) -> Analyzer | None:
        """The analyzer for indexing or searching; unknown names fall back."""
        if not self.analyzed:
            return None
        own = self.index_analyzer if use == "index" else self.search_analyzer
        for name in (own, self.analyzer):
            if name in settings.analyzers:
                return settings.analyzers[name]
        return settings.default(use)

    def to_json(self) -> dict:
        out: dict[str, Any] = {"type": self.type, "index": "no" if not self.indexed else "analyzed" if self.analyzed else "not_analyzed", "store": self.stored, "include_in_all": self.in_all}
        if self.indexed:
            out["boost"] = self.boost
        return out | {k: v for k in ("analyzer", "index_analyzer", "search_analyzer") if (v := getattr(self, k)) is not None}


@dataclass(frozen=True)
class Mapping:
    """Fields by name; nested mappings are kept but not indexed."""

    fields: dict[str, Field]
    nested: dict[str, Mapping] = field(default_factory=dict)

    def searchable(self, settings: Settings) -> dict[str, Analyzer | None]:
        own = {n: f.use(settings, "search") for n, f in self.fields.items() if f.indexed}
        return own if ALL in self.fields else own | {ALL: STANDARD}

    def schema(self) -> T.StructType:
        own = [T.StructField(n, SPARK[f.type], True, metadata=f.to_json()) for n, f in self.fields.items()]
        return T.StructType(own + [T.StructField(n, m.schema()) for n, m in self.nested.items()])

    def to_json(self) -> dict:
        nested = {n: {"type": "nested", **m.to_json()} for n, m in self.nested.items()}
        return {"properties": {n: f.to_json() for n, f in self.fields.items()} | nested}


def parse_field(x: Any) -> Field:
    _only(_object(x), "type", "index", "store", "include_in_all", "boost", "analyzer", "index_analyzer", "search_analyzer")
    kind = _string(_key(x, "type"))
    if kind not in SPARK:
        raise MappingError("UnrecognisedFieldType", kind)
    text = kind == "string"
    index = _string(x.get("index", "analyzed" if text else "not_analyzed"))
    if index not in ("no", "analyzed", "not_analyzed"):
        raise MappingError("UnrecognisedIndexSetting", index)
    if index == "analyzed" and not text:
        raise MappingError("IndexAnalyzedOnlyAllowedOnStringType")
    stored = _flag(x.get("store", False))
    named = {}
    for key in ("analyzer", "index_analyzer", "search_analyzer"):
        if key in x:
            named[key] = _string(x[key])
            if not text:
                raise MappingError("AnalyzersOnlyAllowedOnStringType")
            if index != "analyzed":
                raise MappingError("AnalyzersOnlyAllowedOnAnalyzedFields")
    boost = x.get("boost", 1.0)
    if isinstance(boost, bool) or not isinstance(boost, (int, float)):
        raise MappingError("ExpectedNumber")
    if "boost" in x and index == "no":
        raise MappingError("BoostOnlyAllowedOnIndexedFields")
    if boost < 0:
        raise MappingError("BoostMustBePositive")
    return Field(kind, index != "no", index == "analyzed", stored, _flag(x.get("include_in_all", True)), float(boost), **named)


def parse_mapping(x: Any, nested: bool = False) -> Mapping:
    _only(_object(x), "properties", *(["type"] if nested else []))
    fields, below = {}, {}
    for name, body in sorted(_object(_key(x, "properties")).items()):
        try:
            if _object(body).get("type") == "nested":
                below[name] = parse_mapping(body, nested=True)
            else:
                fields[name] = parse_field(body)
        except MappingError as e:
            raise e.under(name) from None
    return Mapping(fields, below)


def _grams(x: dict, edge: bool) -> Grams:
    def size(key: str, default: int) -> int:
        n = x.get(key, default)
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise MappingError("ExpectedPositiveInteger")
        return n

    least, most, side = size("min_gram", 1), size("max_gram", 2), None
    if edge:
        side = _string(x.get("side", "front")).lower()
        if side not in ("front", "back"):
            raise MappingError("InvalidSideValue")
    return Grams(least, most, side)


def parse_tokenizer(x: Any) -> Tokenizer:
    kind = _string(_key(_object(x), "type"))
    if kind in ("standard", "lowercase"):
        return Tokenizer(kind)
    if kind in ("nGram", "ngram", "edgeNGram", "edge_ngram"):
        return Tokenizer("standard", _grams(x, kind.startswith("edge")))
    raise MappingError("UnrecognisedType", kind)


def parse_filter(x: Any) -> TokenFilter:
    kind = _string(_key(_object(x), "type"))
    if kind in ("asciifolding", "lowercase"):
        return TokenFilter(kind)
    if kind in ("nGram", "ngram", "edgeNGram", "edge_ngram"):
        return TokenFilter("grams", _grams(x, kind.startswith("edge")))
    raise MappingError("UnrecognisedType", kind)


def parse_analyzer(x: Any, settings: Settings) -> Analyzer:
    kind = _string(_key(_object(x), "type"))
    if kind != "custom":
        raise MappingError("UnrecognisedType", kind)
    name = _string(_key(x, "tokenizer"))
    if name not in settings.tokenizers:
        raise MappingError("UnrecognisedTokenizer", name)
    chain = x.get("filter", [])
    if not isinstance(chain, list):
        raise MappingError("ExpectedArray")
    for f in chain:
        if _string(f) not in settings.filters:
            raise MappingError("UnrecognisedFilter", f)
    return Analyzer(settings.tokenizers[name], tuple(settings.filters[f] for f in chain))


def parse_index(x: Any) -> tuple[Settings, dict[str, Mapping]]:
    """Settings and mappings of an index from the body that creates it."""
    settings = Settings()
    analysis = _object(_object(_object(x).get("settings", {})).get("analysis", {}))
    steps: list[tuple[str, dict, Callable]] = [("tokenizer", settings.tokenizers, parse_tokenizer), ("filter", settings.filters, parse_filter), ("analyzer", settings.analyzers, lambda a: parse_analyzer(a, settings))]
    for kind, into, read in steps:
        for name, body in sorted(_object(analysis.get(kind, {})).items()):
            try:
                into[name] = read(body)
            except MappingError as e:
                raise e.under(name).under(kind) from None
    mappings = {}
    for name, body in sorted(_object(x.get("mappings", {})).items()):
        try:
            mappings[name] = parse_mapping(body)
        except MappingError as e:
            raise e.under(name) from None
    return settings, mappings


def _grams_json(g: Grams) -> dict:
    out: dict[str, Any] = {"type": "edgeNGram" if g.edge else "nGram", "min_gram": g.min_gram, "max_gram": g.max_gram}
    return out | ({"side": g.edge} if g.edge else {})


def settings_json(settings: Settings) -> dict:
    """What parse_index reads back; analyzers name components by what they are."""
    tokenizers = {n: _grams_json(t.grams) if t.grams else {"type": t.kind} for n, t in settings.tokenizers.items()}
    filters = {n: _grams_json(f.grams) if f.grams else {"type": f.kind} for n, f in settings.filters.items()}
    analyzers = {}
    for name, a in settings.analyzers.items():
        own = next(n for n, t in settings.tokenizers.items() if t == a.tokenizer)
        analyzers[name] = {"type": "custom", "tokenizer": own, "filter": [next(n for n, t in settings.filters.items() if t == f) for f in a.filters]}
    return {"analysis": {"tokenizer": tokenizers, "filter": filters, "analyzer": analyzers}}
