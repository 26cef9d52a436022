import pytest

from glyphgrid.functions.analysis import STANDARD, Analyzer, Grams, TokenFilter, Tokenizer
from glyphgrid.plans.mapping import Field, MappingError, Settings, parse_field, parse_index, parse_mapping, settings_json


def kind(fn, x):
    with pytest.raises(MappingError) as e:
        fn(x)
    return e.value.kind, e.value.detail


def test_fields():
    assert parse_field({"type": "string"}) == Field()
    for other in ("integer", "boolean", "date"):
        assert parse_field({"type": other}) == Field(other, analyzed=False)
    assert parse_field({"index": "no", "type": "string"}) == Field(indexed=False, analyzed=False)
    assert parse_field({"index": "not_analyzed", "store": "yes", "include_in_all": "no", "boost": 2, "type": "string"}) == Field(analyzed=False, stored=True, in_all=False, boost=2.0)
    assert parse_field({"include_in_all": "yes", "type": "integer"}).in_all
    assert parse_field({"analyzer": "a", "index_analyzer": "b", "search_analyzer": "c", "type": "string"}).search_analyzer == "c"


@pytest.mark.parametrize(
    "body,want",
    [
        ([], ("ExpectedObject", None)), ({}, ("ExpectedKey", "type")), ({"type": "foo"}, ("UnrecognisedFieldType", "foo")), ({"type": 123}, ("ExpectedString", None)),
        ({"foo": 1, "baz": 2, "type": "string"}, ("UnrecognisedKeys", ["baz", "foo"])), ({"index": "foo", "type": "string"}, ("UnrecognisedIndexSetting", "foo")),
        ({"index": "analyzed", "type": "integer"}, ("IndexAnalyzedOnlyAllowedOnStringType", None)), ({"store": "foo", "type": "string"}, ("ExpectedBoolean", None)),
        ({"analyzer": "a", "type": "integer"}, ("AnalyzersOnlyAllowedOnStringType", None)), ({"index": "no", "search_analyzer": "a", "type": "string"}, ("AnalyzersOnlyAllowedOnAnalyzedFields", None)),
        ({"boost": -2.0, "type": "string"}, ("BoostMustBePositive", None)), ({"boost": "x", "type": "string"}, ("ExpectedNumber", None)), ({"index": "no", "boost": 2, "type": "string"}, ("BoostOnlyAllowedOnIndexedFields", None)),
        ({"include_in_all": 1, "type": "string"}, ("ExpectedBoolean", None)), ({"analyzer": 1, "type": "string"}, ("ExpectedString", None)),
    ],
)
def test_field_errors(body, want):
    assert kind(parse_field, body) == want


def test_mappings():
    m = parse_mapping({"properties": {"a": {"type": "string"}, "n": {"type": "nested", "properties": {"m": {"type": "nested", "properties": {"b": {"type": "date"}}}}}}})
    assert m.fields == {"a": Field()} and m.nested["n"].nested["m"].fields == {"b": Field("date", analyzed=False)}
    assert parse_mapping(m.to_json()) == m
    assert m.schema()["n"].dataType["m"].dataType["b"].dataType.simpleString() == "timestamp"
    assert m.searchable(Settings()) == {"a": STANDARD, "_all": STANDARD}
    for body, want in [(["foo"], "ExpectedObject"), ("foo", "ExpectedObject"), (123, "ExpectedObject"), ({}, "ExpectedKey"), ({"properties": {}, "x": 1}, "UnrecognisedKeys"), ({"properties": {"a": 1}}, "ExpectedObject")]:
        assert kind(parse_mapping, body)[0] == want
    with pytest.raises(MappingError) as e:
        parse_mapping({"properties": {"n": {"type": "nested", "properties": {"b": {"type": "x"}}}}})
    assert e.value.path == ("n", "b")


SETTINGS = {
    "settings": {
        "analysis": {
            "tokenizer": {"ng": {"max_gram": 12, "min_gram": 4, "type": "nGram"}, "back": {"side": "BACK", "max_gram": 9, "min_gram": 3, "type": "edgeNGram"}},
            "filter": {"eg": {"type": "edge_ngram"}, "nf": {"max_gram": 4, "type": "ngram"}},
            "analyzer": {"mine": {"tokenizer": "ng", "filter": ["lowercase", "eg"], "type": "custom"}, "default": {"tokenizer": "lowercase", "type": "custom"}},
        }
    },
    "mappings": {"m": {"properties": {"f": {"type": "string"}}}},
}


def test_settings_round_trip():
    settings, mappings = parse_index(SETTINGS)
    assert settings.tokenizers["ng"] == Tokenizer("standard", Grams(4, 12)) and settings.tokenizers["back"].grams.edge == "back"
    assert settings.filters["eg"] == TokenFilter("grams", Grams(1, 2, "front")) and len(settings.filters) == 4
    assert settings.analyzers["mine"].filters[1] == settings.filters["eg"]
    again, _ = parse_index({"settings": settings_json(settings)})
    assert again == settings and set(mappings) == {"m"}
    plain, none = parse_index({})
    assert (len(plain.tokenizers), len(plain.filters), len(plain.analyzers), none) == (2, 2, 1, {})


def test_analyzers_resolve_with_fallbacks():
    settings, _ = parse_index(SETTINGS)
    default, mine = settings.analyzers["default"], settings.analyzers["mine"]
    assert Field().use(settings, "index") == default == Field(search_analyzer="nope").use(settings, "search")
    assert Field(analyzer="mine").use(settings, "search") == mine == Field(analyzer="mine", index_analyzer="nope").use(settings, "index")
    assert Field(index_analyzer="standard").use(settings, "index") == STANDARD and Field(analyzed=False).use(settings, "index") is None
    assert Settings().default("index") == STANDARD


@pytest.mark.parametrize(
    "analysis,want",
    [
        ({"tokenizer": {"x": {"type": "foo"}}}, "UnrecognisedType"), ({"filter": {"x": {"type": "foo"}}}, "UnrecognisedType"), ({"filter": {"x": {}}}, "ExpectedKey"), ({"tokenizer": {"x": {"min_gram": -1, "type": "ngram"}}}, "ExpectedPositiveInteger"),
        ({"tokenizer": {"x": {"side": "up", "type": "edgeNGram"}}}, "InvalidSideValue"), ({"analyzer": {"x": {"type": "custom"}}}, "ExpectedKey"), ({"analyzer": {"x": {"tokenizer": "no", "type": "custom"}}}, "UnrecognisedTokenizer"),
        ({"analyzer": {"x": {"tokenizer": "standard", "filter": ["no"], "type": "custom"}}}, "UnrecognisedFilter"), ({"analyzer": {"x": {"tokenizer": "standard", "filter": "lowercase", "type": "custom"}}}, "ExpectedArray"), ({"analyzer": {"x": {"type": "snowball"}}}, "UnrecognisedType"),
    ],
)
def test_settings_errors(analysis, want):
    assert kind(parse_index, {"settings": {"analysis": analysis}})[0] == want


def test_built_ins():
    assert STANDARD == Analyzer(Tokenizer("standard"), (TokenFilter("lowercase"), TokenFilter("asciifolding")))
