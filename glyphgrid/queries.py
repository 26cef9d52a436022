"""The registered queries of the search engine and the same in DuckDB SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrid.functions.analysis import ASCII_FOLDING, LOWERCASE, LOWERCASE_TOKENIZER, PLAIN_WORD, STANDARD, STANDARD_TOKENIZER, Analyzer, Grams, TokenFilter, Tokenizer
from glyphgrid.functions.similarity import TfIdf
from glyphgrid.operators import search, sets
from glyphgrid.operators.catalog import Engine
from glyphgrid.operators.index import Index, analyse, build
from glyphgrid.plans.compile import matches
from glyphgrid.plans.dsl import Parser
from glyphgrid.plans.mapping import Mapping, Settings, parse_index, parse_mapping
from glyphgrid.plans.query import All, Conjunction, Disjunction, DisMax, Exclude, Filter, Nothing, Prefix, Query, Scorer, Term
from glyphgrid.sources import documents as sources
from glyphgrid.sources.shared import fresh, keep
from glyphgrid.streaming.ingest import stream_bulk

TEXT = {"type": "string", "store": True}
EXACT = {"type": "string", "index": "not_analyzed", "store": True}
INTEGER = {"type": "integer", "store": True}


@dataclass(frozen=True)
class Table:
    """How a test table is indexed: its key and mapping, and its fields in SQL.

    sql has, by field, how its terms come from the table: words for analysed text,
    else an expression.
    """

    name: str
    key: str
    properties: dict
    select: Callable[[DataFrame], DataFrame]
    sql: dict[str, str]
    source: str = ""

    @property
    def mapping(self) -> Mapping:
        return parse_mapping({"properties": self.properties})


def _number(x: str) -> str:
    return f"'i:' || CAST({x} AS VARCHAR)"


TABLES = {
    "documents": Table("documents", "doc_id", {"text": TEXT, "lang": EXACT, "source": EXACT, "n_chars": INTEGER}, lambda d: d.select("doc_id", "text", "lang", "source", "n_chars"), {"text": "words:text", "lang": "lang", "source": "source", "n_chars": _number("n_chars"), "_all": "words:concat_ws(' ', lang, source, text)"}),
    "events": Table("events", "event_id", {"event_type": EXACT, "user_id": INTEGER, "ts": {"type": "date", "store": True}}, lambda d: d.select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts")), {"event_type": "event_type", "user_id": _number("user_id"), "ts": _number("epoch_us(ts)"), "_all": "words:coalesce(event_type, '')"}),
    "labels": Table("labels", "doc_id", {"quality": {"type": "boolean", "store": True}, "toxic": {"type": "boolean", "store": True}}, lambda d: d.select("doc_id", F.col("quality").cast("boolean").alias("quality"), F.col("toxic").cast("boolean").alias("toxic")), {"quality": "CASE WHEN quality <> 0 THEN 't' ELSE 'f' END", "toxic": "CASE WHEN toxic <> 0 THEN 't' ELSE 'f' END", "_all": "words:''"}),
    "orders": Table("orders", "o_orderkey", {"o_orderdate": {"type": "date", "store": True}, "o_orderpriority": TEXT}, lambda d: d.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), "o_orderpriority"), {"o_orderdate": _number("epoch_us(o_orderdate)"), "o_orderpriority": "words:o_orderpriority", "_all": "words:coalesce(o_orderpriority, '')"}),
    "part": Table("part", "p_partkey", {"p_name": TEXT, "p_brand": EXACT, "p_size": INTEGER}, lambda d: d.select("p_partkey", "p_name", "p_brand", F.col("p_size").cast("bigint").alias("p_size")), {"p_name": "words:p_name", "p_brand": "p_brand", "p_size": _number("p_size"), "_all": "words:concat_ws(' ', p_brand, p_name)"}),
    "turns": Table("turns", "key", {"text": TEXT, "role": EXACT}, lambda d: d.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text", "role"), {"text": "words:text", "role": "role"}, "(SELECT conv_id * 1000 + turn AS key, text, role FROM conversations)"),
}

_KEPT: dict[tuple[str, str, str], Index] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str, table: Table) -> DataFrame:
    return table.select(read(spark, sf_dir, "conversations" if table.name == "turns" else table.name))


def index(spark: SparkSession, sf_dir: str, name: str = "documents") -> Index:
    """The index of a whole table, built once a session and folder and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        table = TABLES[name]
        _KEPT[key] = keep(build(_rows(spark, sf_dir, table), table.mapping, table.key), fresh(spark, f"index-{name}"))
    return _KEPT[key]


# the same index in SQL

FOLDED = "replace(strip_accents(lower(w)), 'ß', 'ss')"


def words_sql(text: str) -> str:
    pattern = PLAIN_WORD.replace("'", "''")
    return f"list_filter(regexp_extract_all({text}, '{pattern}'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))"


def index_sql(table: Table, fields: set[str]) -> str:
    """CTEs docs, p (field, term, k, tf, n), fs, ts and s, which has the score of each posting."""
    rows = []
    for name in sorted(fields):
        how = table.sql[name]
        if how.startswith("words:"):
            rows.append(f"SELECT '{name}' AS field, k, list_transform({words_sql(how[6:])}, lambda w: {FOLDED}) AS terms FROM docs")
        else:
            rows.append(f"SELECT '{name}' AS field, k, [{how}] AS terms FROM docs WHERE ({how}) IS NOT NULL")
    return f"""docs AS (SELECT *, {table.key} AS k FROM {table.source or table.name}),
f AS MATERIALIZED ({" UNION ALL ".join(rows)}),
fs AS (SELECT field, count(*) AS n_docs, sum(len(terms)) AS n_tokens FROM f WHERE terms IS NOT NULL GROUP BY field),
p AS MATERIALIZED (SELECT field, term, k, count(*) AS tf, any_value(n) AS n FROM (SELECT field, k, len(terms) AS n, unnest(terms) AS term FROM f) GROUP BY field, term, k),
ts AS (SELECT field, term, count(*) AS df FROM p GROUP BY field, term),
s AS (SELECT p.field, p.term, p.k, ln(tf + 1) + 1 AS t, ln((n_docs + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1 AS idf,
      greatest(0, least(255, floor((sqrt(n::DOUBLE) - 1) * 3))) / 3.0::DOUBLE + 1 AS root, sqrt((n_tokens + 1.0::DOUBLE) / (n_docs + 1.0::DOUBLE)) AS average
      FROM p JOIN fs USING (field) JOIN ts USING (field, term))"""


BM25_SQL = "idf * 2.2::DOUBLE * (t / (t + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * root / average) + 1))"


class _Sql:
    """A query tree as SQL over the CTEs above; written apart from the Spark compiler."""

    def __init__(self, table: Table):
        self.table, self.leaves = table, {}

    def leaf(self, q: Term | Prefix) -> str:
        key = (type(q), q.field, q.term if isinstance(q, Term) else q.prefix, q.scorer.similarity)
        return self.leaves.setdefault(key, f"l{len(self.leaves)}")

    def match(self, q: Query) -> str:
        match q:
            case All():
                return "true"
            case Nothing():
                return "false"
            case Term() | Prefix():
                return f"{self.leaf(q)}.k IS NOT NULL"
            case Conjunction() | Disjunction() | DisMax():
                word = " AND " if isinstance(q, Conjunction) else " OR "
                return "(" + (word.join(map(self.match, q.queries)) or "false") + ")"
            case Filter():
                return f"({self.match(q.query)} AND {self.match(q.by)})"
            case Exclude():
                return f"({self.match(q.query)} AND NOT {self.match(q.what)})"

    def score(self, q: Query) -> str:
        match q:
            case All():
                return f"{q.score}::DOUBLE"
            case Term() | Prefix():
                return f"coalesce({self.leaf(q)}.score, 0) * {q.scorer.boost}::DOUBLE"
            case Conjunction() | Disjunction() if q.queries:
                return "((" + " + ".join(map(self.score, q.queries)) + f") / {len(q.queries)})"
            case DisMax() if q.queries:
                return "greatest(0.0::DOUBLE, " + ", ".join(map(self.score, q.queries)) + ")"
            case Filter() | Exclude():
                return self.score(q.query)
        return "0.0::DOUBLE"

    def ctes(self) -> str:
        fields = {k[1] for k in self.leaves}
        if any(k[0] is Prefix for k in self.leaves):
            fields |= set(self.table.sql)  # terms of all fields count
        out = [index_sql(self.table, fields)] if fields else [f"docs AS (SELECT *, {self.table.key} AS k FROM {self.table.source or self.table.name})"]
        for (kind, field, value, similarity), name in self.leaves.items():
            score = "t * idf" if isinstance(similarity, TfIdf) else BM25_SQL
            number = self.table.properties.get(field, TEXT)["type"] in ("integer", "date") and len(value) == 8
            text = f"i:{int.from_bytes(value, 'little', signed=True)}" if number else value.decode().replace("'", "''")
            if kind is Term:
                out.append(f"{name} AS (SELECT k, {score} AS score FROM s WHERE field = '{field}' AND term = '{text}')")
            else:
                out.append(f"{name} AS (SELECT k, sum({score}) / (SELECT count(DISTINCT term) FROM ts WHERE starts_with(term, '{text}')) AS score FROM s WHERE field = '{field}' AND starts_with(term, '{text}') GROUP BY k)")
        return ",\n".join(out)

    def query(self, q: Query, scored: bool = True, digits: int | None = 6) -> str:
        where, score = self.match(q), self.score(q) if scored else None
        joins = "".join(f" LEFT JOIN {n} ON {n}.k = docs.k" for n in self.leaves.values())
        got = f"docs.k AS {self.table.key if self.table.name != 'turns' else 'key'}" + (f", {score if digits is None else f'round({score}, {digits})'} AS score" if scored else "")
        return f"WITH {self.ctes()}\nSELECT {got} FROM docs{joins} WHERE {where}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def _searched(name: str, query: dict | Query, table: str = "documents") -> None:
    """All matches of a query with their scores."""
    t = TABLES[table]
    tree = query if isinstance(query, Query) else Parser(t.mapping.searchable(Settings())).parse(query)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = matches(index(spark, sf_dir, table), tree)
        return found.select(F.col("doc_key").cast("bigint").alias(t.key), F.round("score", 6).alias("score"))

    _add(name, run, _Sql(t).query(tree))


def _counted(name: str, query: dict | None) -> None:
    t = TABLES["documents"]
    tree = All() if query is None else Parser(t.mapping.searchable(Settings())).parse(query)
    _add(name, lambda spark, sf_dir: search.count(index(spark, sf_dir), tree), f"SELECT count(*) AS count FROM ({_Sql(t).query(tree, False)})")


_searched("match_single", {"match": {"text": "tion"}})
_searched("match_or", {"match": {"text": "the and"}})
_searched("match_and", {"match": {"text": {"query": "The of and", "operator": "and"}}})
_searched("match_boost", {"match": {"text": {"query": "the les", "boost": 2.5}}})
_searched("match_folded", {"match": {"text": "FÜR Él"}})
_searched("match_repeated_term", {"match": {"text": "the the die"}})
_searched("match_no_tokens", {"match": {"text": " ... "}})
_searched("match_not_analyzed", {"match": {"lang": "en"}})
_searched("match_integer_never", {"match": {"n_chars": "100"}})
_searched("multi_match_dismax", {"multi_match": {"query": "src1 the", "fields": ["text", "source"]}})
_searched("multi_match_boost_and", {"multi_match": {"query": "the of", "fields": ["text^2", "_all^0.5", "source^x"], "operator": "and", "boost": 1.5}})
_searched("multi_match_one_field", {"multi_match": {"query": "and", "fields": ["text^3"]}})
_searched("match_all_boost", {"match_all": {"boost": 3.5}})
_searched("match_none", {"match_none": {}})
_searched("term_string", {"term": {"lang": {"value": "fr", "boost": 2}}})
_searched("term_integer", {"term": {"user_id": 17}}, "events")
_searched("term_boolean", {"term": {"toxic": True}}, "labels")
_searched("term_boolean_as_text", {"term": {"quality": "f"}}, "labels")
_searched("term_date", {"term": {"o_orderdate": 852_076_800_000_000}}, "orders")
_searched("terms_in", {"in": {"lang": ["de", "es", "xx"]}})
_searched("terms_mixed_dropped", {"terms": {"user_id": [3, "3", 5, None, 2.5, [7], {"a": 1}]}}, "events")
_searched("terms_many", {"terms": {"n_chars": list(range(100, 400))}})
_MANY = ", ".join(f"'i:{n}'" for n in range(100, 400))
ORACLE["terms_many"] = f"WITH {index_sql(TABLES['documents'], {'n_chars'})} SELECT k AS doc_id, round({BM25_SQL} / 300, 6) AS score FROM s WHERE term IN ({_MANY})"
_searched("match_many", {"or": [{"match": {"text": {"query": " ".join(chr(97 + i % 26) + chr(97 + i // 26) for i in range(60)), "boost": 2.0}}}, {"filtered": {"query": {"match": {"text": {"query": "the of", "operator": "and"}}}, "filter": {"not": {"terms": {"source": [f"src{i}" for i in range(5)]}}}}}]})
_searched("prefix", {"prefix": {"text": "onth"}})
_searched("prefix_object_boost", {"prefix": {"text": {"prefix": "th", "boost": 2.0}}})
_searched("prefix_other_field_denominator", {"prefix": {"source": {"value": "src1"}}})
_searched("and_query", {"and": [{"match": {"text": "the"}}, {"term": {"lang": "en"}}, {"match": {"text": "of"}}]})
_searched("or_query", {"or": [{"term": {"lang": "de"}}, {"match": {"text": {"query": "les des", "operator": "and"}}}]})
_searched("not_query", {"not": {"match": {"text": "the und"}}})
_searched("filtered", {"filtered": {"query": {"match": {"text": "the thin"}}, "filter": {"term": {"source": "src3"}}}})
_searched("filtered_no_query", {"filtered": {"filter": {"prefix": {"source": "src1"}}}})
_searched("constant_score", {"constant_score": {"filter": {"match": {"text": "les"}}, "boost": 1.25}})
_searched("nested_bool", {"or": [{"and": [{"not": {"term": {"lang": "en"}}}, {"match": {"text": "et"}}]}, {"filtered": {"query": {"multi_match": {"query": "thin", "fields": ["text", "_all^2"]}}, "filter": {"not": {"prefix": {"source": "src1"}}}}}]})
_searched("empty_lists", {"or": [{"and": []}, {"terms": {"lang": []}}, {"term": {"lang": "es"}}]})
_searched("all_field_match", {"match": {"_all": "en src5 thin"}})
_searched("tfidf_match", Disjunction((Term("text", b"the", Scorer(TfIdf(), 1.5)), Term("text", b"of", Scorer(TfIdf())))))
_searched("exclude_and_boost", Term("text", b"the").exclude(Term("source", b"src2")).filter(Term("lang", b"en")).boost(2.0))
_searched("term_part_brand", {"and": [{"term": {"p_brand": "Brand#23"}}, {"or": [{"term": {"p_size": 10}}, {"not": {"term": {"p_size": 20}}}]}]}, "part")
_counted("count_all", None)
_counted("count_match", {"match": {"text": "the les"}})
_counted("count_not", {"not": {"and": [{"term": {"lang": "en"}}, {"match": {"text": "the"}}]}})


# top hits

_TOP = {"match": {"text": "the and of thin"}}


def _page(from_: int, size: int, fields: tuple[str, ...] = ()) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        page = search.search(index(spark, sf_dir), _TOP, from_, size, fields)
        return page.select(F.col("doc_key").cast("bigint").alias("doc_id"), F.round("score", 6).alias("score"), *fields)

    return run


def _page_sql(from_: int, size: int, fields: tuple[str, ...] = ()) -> str:
    """Ties go to the lesser key, which is text."""
    inner = _Sql(TABLES["documents"]).query(Parser(TABLES["documents"].mapping.searchable(Settings())).parse(_TOP), digits=None)
    top = f"SELECT doc_id, round(score, 6) AS score FROM ({inner}) ORDER BY round(score, 12) DESC, CAST(doc_id AS VARCHAR) LIMIT {size} OFFSET {from_}"
    return top if not fields else f"SELECT t.doc_id, t.score, {', '.join('d.' + f for f in fields)} FROM ({top}) t JOIN documents d ON d.doc_id = t.doc_id"


_add("top_k", _page(0, 10), _page_sql(0, 10))
_add("top_k_offset", _page(15, 25), _page_sql(15, 25))
_add("stored_fields", _page(0, 10, ("lang", "source", "n_chars", "text")), _page_sql(0, 10, ("lang", "source", "n_chars", "text")))


# analysis

GRAMS = {"ngram_2_3": Grams(2, 3), "edge_ngram_front": Grams(2, 4, "front"), "edge_ngram_back": Grams(2, 3, "back")}
_GRAM_SQL = {
    "ngram_2_3": "flatten(list_transform(range(0, len(w) - 1), lambda i: list_transform(range(2, least(3, len(w) - i) + 1), lambda z: substr(w, i + 1, z))))",
    "edge_ngram_front": "list_transform(range(2, least(4, len(w)) + 1), lambda z: substr(w, 1, z))",
    "edge_ngram_back": "list_transform(range(2, least(3, len(w)) + 1), lambda z: substr(w, len(w) - z + 1, z))",
}


def _token_counts(tokens: Callable[[Column], Column], table: str, column: str, df: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = {"documents": "doc_id", "part": "p_partkey"}[table]
        # the test tables have one row group, which would be analysed in one task
        rows = read(spark, sf_dir, table).select(key, column).repartition(spark.sparkContext.defaultParallelism)
        found = rows.select(F.col(key).alias("k"), F.explode(F.transform(tokens(F.col(column)), lambda t: t["term"])).alias("term"))
        if not df:
            return found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        return found.groupBy("term", "k").agg(F.count(F.lit(1)).alias("c")).groupBy("term").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("df"))

    return run


def _token_sql(change: str, table: str, column: str, df: bool = False) -> str:
    key = {"documents": "doc_id", "part": "p_partkey"}[table]
    more = ", count(DISTINCT k) AS df" if df else ""
    return f"SELECT term, count(*) AS n{more} FROM (SELECT k, {change} AS term FROM (SELECT {key} AS k, unnest({words_sql(column)}) AS w FROM {table})) GROUP BY term"


_add("tokenize_standard", _token_counts(STANDARD_TOKENIZER.tokens, "documents", "text", True), _token_sql("w", "documents", "text", True))
_add("tokenize_lowercase", _token_counts(LOWERCASE_TOKENIZER.tokens, "documents", "text", True), _token_sql("lower(w)", "documents", "text", True))
_add("filter_lowercase", _token_counts(Analyzer(STANDARD_TOKENIZER, (LOWERCASE,)).tokens, "documents", "text"), _token_sql("lower(w)", "documents", "text"))
_add("filter_asciifold", _token_counts(Analyzer(STANDARD_TOKENIZER, (ASCII_FOLDING,)).tokens, "documents", "text"), _token_sql("replace(strip_accents(w), 'ß', 'ss')", "documents", "text"))
_add("analyze_standard", _token_counts(STANDARD.tokens, "documents", "text"), _token_sql(FOLDED, "documents", "text"))
for _name, _grams in GRAMS.items():
    _add(_name, _token_counts(Tokenizer("standard", _grams).tokens, "part", "p_name"), _token_sql(f"unnest({_GRAM_SQL[_name]})", "part", "p_name"))
    _add(f"{_name}_filter", _token_counts(Analyzer(LOWERCASE_TOKENIZER, (TokenFilter("grams", _grams),)).tokens, "part", "p_name"), _token_sql(f"unnest({_GRAM_SQL[_name]})", "part", "p_name").replace("AS w FROM", "AS v FROM").replace("FROM (SELECT p_partkey AS k", "FROM (SELECT k, lower(v) AS w FROM (SELECT p_partkey AS k").replace("FROM part))", "FROM part)))"))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = TABLES["part"]
    rows = analyse(_rows(spark, sf_dir, table), table.mapping, table.key).where("field = 'p_name'")
    return rows.select(F.col("doc_key").cast("bigint").alias("p_partkey"), F.explode("tokens").alias("t")).select("p_partkey", F.col("t.term").cast("string").alias("term"), F.col("t.position").cast("bigint").alias("position"))


_add("token_positions", _positions, f"SELECT p_partkey, {FOLDED} AS term, position FROM (SELECT p_partkey, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS position FROM (SELECT p_partkey, {words_sql('p_name')} AS words FROM part))")


# the index itself

_ALL_FIELDS = index_sql(TABLES["documents"], set(TABLES["documents"].sql))


def _shown(term: Column) -> Column:
    """Terms of numbers as the SQL writes them, others as text."""
    h = F.hex(term)
    number = F.conv(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)]), 16, 10)
    return F.when(F.col("field") == "n_chars", F.concat(F.lit("i:"), number)).otherwise(term.cast("string"))


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).postings.select("field", _shown(F.col("term")).alias("term"), F.col("doc_key").cast("bigint").alias("doc_id"), F.col("tf").cast("bigint").alias("tf"), F.col("len_code").cast("bigint").alias("len_code"))


_CODE = "CAST(greatest(0, least(255, floor((sqrt(n::DOUBLE) - 1) * 3))) AS BIGINT)"
_add("postings", _postings, f"WITH {_ALL_FIELDS} SELECT field, term, k AS doc_id, tf, {_CODE} AS len_code FROM p")
_add("term_stats", lambda spark, sf_dir: index(spark, sf_dir).term_stats.select("field", _shown(F.col("term")).alias("term"), "df"), f"WITH {_ALL_FIELDS} SELECT field, term, df FROM ts")
_add("field_stats", lambda spark, sf_dir: index(spark, sf_dir).field_stats, f"WITH {index_sql(TABLES['documents'], set(TABLES['documents'].sql))} SELECT field, n_docs, CAST(n_tokens AS BIGINT) AS n_tokens FROM fs")
_add("field_length_codes", lambda spark, sf_dir: index(spark, sf_dir).postings.where("field = 'text'").groupBy("doc_key").agg(F.first("len_code").cast("bigint").alias("len_code")).select(F.col("doc_key").cast("bigint").alias("doc_id"), "len_code"), f"WITH {index_sql(TABLES['documents'], {'text'})} SELECT k AS doc_id, any_value({_CODE}) AS len_code FROM p GROUP BY k")

_BACK = {"settings": {"analysis": {"filter": {"grams": {"type": "edgeNGram", "min_gram": 2, "max_gram": 5}}, "analyzer": {"front": {"type": "custom", "tokenizer": "lowercase", "filter": ["grams"]}}}}, "mappings": {"part": {"properties": {"p_name": {"type": "string", "index_analyzer": "front", "search_analyzer": "standard"}}}}}


def _gram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tf of edge grams: what a word has of one gram counts once a position."""
    settings, mappings = parse_index(_BACK)
    own = build(read(spark, sf_dir, "part").select("p_partkey", "p_name"), mappings["part"], "p_partkey", settings)
    return own.postings.where("field = 'p_name'").select(F.col("doc_key").cast("bigint").alias("p_partkey"), F.col("term").cast("string").alias("term"), F.col("tf").cast("bigint").alias("tf"))


_add("gram_index", _gram_index, f"SELECT k AS p_partkey, term, count(*) AS tf FROM (SELECT k, unnest(list_transform(range(2, least(5, len(w)) + 1), lambda z: substr(lower(w), 1, z))) AS term FROM (SELECT p_partkey AS k, unnest({words_sql('p_name')}) AS w FROM part)) GROUP BY k, term")


# sets of documents

def _set(name: str, of: Callable[[Index, DataFrame, DataFrame], DataFrame], condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = index(spark, sf_dir)
        return of(own, sets.having(own, "text", b"the"), sets.having(own, "lang", b"en")).select(F.col("doc_key").cast("bigint").alias("doc_id"))

    _add(name, run, f"SELECT doc_id FROM (SELECT doc_id, list_contains(list_transform({words_sql('text')}, lambda w: {FOLDED}), 'the') AS a, lang = 'en' AS b FROM documents) WHERE {condition}")


_set("set_intersect", lambda i, a, b: sets.both(a, b), "a AND b")
_set("set_union", lambda i, a, b: sets.either(a, b), "a OR b")
_set("set_difference", lambda i, a, b: sets.without(a, b), "a AND NOT b")
_set("set_complement", lambda i, a, b: sets.complement(i, a), "NOT a")
_set("set_fold", lambda i, a, b: sets.fold(i, "or", [sets.fold(i, "and", [a, b, sets.complement(i, sets.fold(i, "or", []))]), sets.without(b, a), b]), "b")


# documents in and out

def _changed(spark: SparkSession, sf_dir: str) -> tuple[Engine, DataFrame, DataFrame]:
    """An engine with all documents; those labelled toxic put again, those of low quality to be deleted."""
    engine = Engine(spark, fresh(spark, "warehouse"))
    engine.create_index("documents", {"mappings": {"doc": {"properties": TABLES["documents"].properties}}})
    docs, labels = _rows(spark, sf_dir, TABLES["documents"]), read(spark, sf_dir, "labels")
    engine.upsert("documents", "doc", docs, "doc_id")
    again = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi").withColumn("text", F.lit("withdrawn text")).withColumn("n_chars", F.lit(14).cast("bigint"))
    return engine, again, labels.where("quality = 0").select(F.col("doc_id").cast("string").alias("doc_key"))


def _live(engine: Engine) -> DataFrame:
    return engine.stores["documents"].index().docs.select(F.col("doc_key").cast("bigint").alias("doc_id"), "text", "n_chars")


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, again, _ = _changed(spark, sf_dir)
    engine.upsert("documents", "doc", again, "doc_id")
    return _live(engine)


def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _, gone = _changed(spark, sf_dir)
    engine.stores["documents"].delete(gone)
    return _live(engine)


def _optimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, again, gone = _changed(spark, sf_dir)
    engine.upsert("documents", "doc", again, "doc_id")
    engine.stores["documents"].delete(gone)
    engine.optimize("documents")
    own = engine.stores["documents"].index()
    return matches(own, search.read(own, {"match": {"text": "withdrawn the"}})).select(F.col("doc_key").cast("bigint").alias("doc_id"), F.round("score", 6).alias("score"))


_TOXIC, _LOW = "doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)", "doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)"
_PUT = f"(SELECT doc_id, CASE WHEN {_TOXIC} THEN 'withdrawn text' ELSE text END AS text, CASE WHEN {_TOXIC} THEN 14 ELSE n_chars END AS n_chars FROM documents)"
_add("upsert_latest_wins", _upsert, f"SELECT * FROM {_PUT}")
_add("delete_tombstone", _delete, f"SELECT doc_id, text, n_chars FROM documents WHERE NOT {_LOW}")
_AFTER = Table("after", "doc_id", {"text": TEXT}, lambda d: d, {"text": "words:text"}, f"(SELECT * FROM {_PUT} WHERE NOT {_LOW})")
_add("optimize_search", _optimize, _Sql(_AFTER).query(Parser({"text": STANDARD}).parse({"match": {"text": "withdrawn the"}})))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, again, gone = _changed(spark, sf_dir)
    engine.upsert("documents", "doc", again, "doc_id")
    engine.stores["documents"].delete(gone)
    return engine.stores["documents"].segment_stats()


_add("segment_stats", _segments, f"SELECT 1::BIGINT AS segment, count(*) AS total_docs, count(*) FILTER ({_TOXIC} OR {_LOW}) AS deleted_docs FROM documents UNION ALL SELECT 2, count(*) FILTER ({_TOXIC}), count(*) FILTER ({_TOXIC} AND {_LOW}) FROM documents")


def _updated(spark: SparkSession, sf_dir: str) -> Index:
    """What a store tells of documents that were put again and deleted, without any merge."""
    engine, again, gone = _changed(spark, sf_dir)
    engine.upsert("documents", "doc", again, "doc_id")
    engine.stores["documents"].delete(gone)
    return engine.stores["documents"].index()


_add("store_field_stats", lambda spark, sf_dir: _updated(spark, sf_dir).field_stats.where("field = 'text'"), f"WITH {index_sql(_AFTER, {'text'})} SELECT field, n_docs, CAST(n_tokens AS BIGINT) AS n_tokens FROM fs")
_add("store_term_stats", lambda spark, sf_dir: _updated(spark, sf_dir).term_stats.where("field = 'text'").select("field", F.col("term").cast("string").alias("term"), "df"), f"WITH {index_sql(_AFTER, {'text'})} SELECT field, term, df FROM ts")


def _store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _updated(spark, sf_dir)
    return matches(own, search.read(own, {"match": {"text": "withdrawn the"}})).select(F.col("doc_key").cast("bigint").alias("doc_id"), F.round("score", 6).alias("score"))


_add("store_search", _store_search, ORACLE["optimize_search"])


def _maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments after a tier of three small ones was merged beside the large one."""
    engine, again, gone = _changed(spark, sf_dir)
    few = again.orderBy("doc_id").limit(9)
    for i in range(3):
        engine.upsert("documents", "doc", few.where(F.pmod("doc_id", F.lit(3)) == i), "doc_id")
    engine.maintain()
    return engine.stores["documents"].segment_stats()


_add("merge_full_tier", _maintained, f"WITH few AS (SELECT doc_id FROM documents WHERE {_TOXIC} ORDER BY doc_id LIMIT 9) SELECT 1::BIGINT AS segment, count(*) AS total_docs, count(*) FILTER (doc_id IN (SELECT doc_id FROM few)) AS deleted_docs FROM documents UNION ALL SELECT 5, count(*), 0 FROM few")

_ENGINES: dict[tuple[str, str], Engine] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """Indices of documents and conversations and an alias of both, made once a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ENGINES:
        made = Engine(spark, fresh(spark, "engine"))
        for name in ("documents", "turns"):
            made.create_index(name, {"mappings": {"doc": {"properties": TABLES[name].properties}}})
            made.upsert(name, "doc", _rows(spark, sf_dir, TABLES[name]), TABLES[name].key)
        made.names.put_alias("both", ["documents", "turns"])
        _ENGINES[key] = made
    return _ENGINES[key]


_BOTH = {"match": {"text": "the thin"}}


def _alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query over two indices; scores are by each one's own statistics."""
    return engine(spark, sf_dir).hits("both", _BOTH).select("index", F.col("doc_key").cast("bigint").alias("doc_id"), F.round("score", 6).alias("score"))


_MATCH = Parser({"text": STANDARD}).parse(_BOTH)
_ALIAS_SQL = f"SELECT 'documents' AS index, doc_id, score FROM ({_Sql(TABLES['documents']).query(_MATCH)}) UNION ALL SELECT 'turns', key, score FROM ({_Sql(TABLES['turns']).query(_MATCH)})"
_add("alias_union_search", _alias, _ALIAS_SQL)
_add("engine_count", lambda spark, sf_dir: spark.createDataFrame([("both", engine(spark, sf_dir).count("both", _BOTH)), ("all", engine(spark, sf_dir).count("documents"))], "what string, n bigint"), f"SELECT 'both' AS what, count(*) AS n FROM ({_ALIAS_SQL}) UNION ALL SELECT 'all', count(*) FROM documents")


def _engine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response of the engine: its page of hits with stored fields, and hits.total on each."""
    found = engine(spark, sf_dir).search("documents", _TOP, from_=5, size=20, fields=["lang", "n_chars", "nope"])["hits"]
    rows = [(int(h["_id"]), round(h["_score"], 6), h["fields"]["lang"][0], h["fields"]["n_chars"][0], found["total"]) for h in found["hits"]]
    return spark.createDataFrame(rows, "doc_id bigint, score double, lang string, n_chars bigint, total bigint")


_add("engine_search", _engine_search, f"SELECT *, 20::BIGINT AS total FROM ({_page_sql(5, 20, ('lang', 'n_chars'))})")


def _get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their keys, one of which isn't there."""
    rows = [(k, d is not None, (d or {}).get("lang"), (d or {}).get("text")) for k in ("1", "2", "17", "nope") for d in [engine(spark, sf_dir).get_document("documents", "doc", k)]]
    return spark.createDataFrame(rows, "k string, found boolean, lang string, text string")


_add("get_document", _get, "SELECT k, doc_id IS NOT NULL AS found, lang, text FROM (VALUES ('1'), ('2'), ('17'), ('nope')) v(k) LEFT JOIN documents ON CAST(doc_id AS VARCHAR) = k")


# fixed cases with their expected rows


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


#: Texts and their words by UAX #29, as its rules give them; | parts words.
WORD_CASES = {"a\u00adb": "a\u00adb", "l\u2018eau": "l\u2018eau", "d\u2019\u00e9t\u00e9": "d\u2019\u00e9t\u00e9", "a\u2024b": "a\u2024b", "1\u066c2": "1\u066c2", '\u05d0"\u05d1': '\u05d0"\u05d1', "\u05d0'": "\u05d0'", "a' b": "a|b", "\u24b6": "\u24b6", "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35": "\u0e2a|\u0e27\u0e31|\u0e2a|\u0e14\u0e35", "\u30cf\u30c1\u516c\u3053\u3093": "\u30cf\u30c1|\u516c|\u3053|\u3093", "a:b a.b a,b": "a:b|a.b|a|b", "1:2 1.2 1,2": "1|2|1.2|1,2", "a.1 3a": "a|1|3a", "_ a_b __": "a_b", "can't 'tis": "can't|tis", "e\u0301a": "e\u0301a", "ab\u200dcd": "ab\u200dcd", "i\u2079": "i|\u2079", "\ud55c\uad6d \uc5b4": "\ud55c\uad6d|\uc5b4", "": ""}


def _word_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(WORD_CASES)], "n int, text string")
    return rows.select("n", F.array_join(F.transform(STANDARD_TOKENIZER.tokens(F.col("text")), lambda t: t["term"]), "|").alias("words"))


_add("word_boundaries", _word_cases, _values(list(enumerate(WORD_CASES.values())), "n, words"))

_FOLD_CASES = {"\u00c6\u00d8\u00de\u00df": "AEOTHss", "\ufb03 \u2474": "ffi (1)", "\u2460\u2469\u24b6": "110A", "\uff21\uff5a\uff11": "Az1", "\u0141\u0111\u0131": "Ldi", "\u00ab\u201c\u2019\u2014": '""\'-', "\u1e9e\u1efa\ua735": "SSLLao", "\u01c4\u01c9": "DZlj", "na\u00efve": "naive", "\u043a\u03b1": "\u043a\u03b1"}


def _fold_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphgrid.functions.folding import fold

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(_FOLD_CASES)], "n int, text string")
    return rows.select("n", fold(F.col("text")).alias("folded"))


_add("ascii_folding", _fold_cases, _values(list(enumerate(_FOLD_CASES.values())), "n, folded"))

_COERCED = {"properties": {"s": {"type": "string", "store": True}, "n": {"type": "integer", "store": True}, "b": {"type": "boolean", "store": True}, "d": {"type": "date", "store": True}}}
_JSON_CASES = [
    ("number", {"s": 12, "b": "yes"}), ("float", {"s": 1.5, "b": "true"}), ("array", {"s": ["one two", None, "three"], "b": 1}), ("null", {"s": None, "n": None, "b": False}), ("offset", {"d": "2016-07-23T16:15:00+01:00", "n": -5, "b": True}),
    ("fraction", {"d": "1969-12-31T23:59:59.999999999Z", "n": 9223372036854775807, "b": "no"}), ("empty", {}),
]


def _coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON values as they are stored: numbers and arrays as strings, lenient booleans, instants with offsets."""
    mapping = parse_mapping(_COERCED)
    own = build(sources.rows(spark, _JSON_CASES, mapping), mapping, sources.KEY)
    return own.docs.select(F.col("doc_key").alias("k"), "s", *[c.cast("string").alias(n) for n, c in (("n", F.col("n")), ("b", F.col("b")), ("d", F.unix_micros("d")))])


_add("json_coercion", _coerced, _values([("number", "12", None, "true", None), ("float", "1.5", None, "false", None), ("array", "one two three", None, "false", None), ("null", None, None, "false", None), ("offset", None, "-5", "true", "1469286900000000"), ("fraction", None, "9223372036854775807", "false", "-1"), ("empty", None, None, None, None)], "k, s, n, b, d"))


def _array_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions go on from one element of an array to the next."""
    mapping = parse_mapping(_COERCED)
    found = analyse(sources.rows(spark, _JSON_CASES, mapping), mapping, sources.KEY).where("field = 's'")
    return found.select(F.col("doc_key").alias("k"), F.explode("tokens").alias("t")).select("k", F.col("t.term").cast("string").alias("term"), "t.position")


_add("array_positions", _array_positions, _values([("number", "12", 1), ("float", "1.5", 1), ("array", "one", 1), ("array", "two", 2), ("array", "three", 3)], "k, term, position"))


def _administration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an engine answers to the operations on indices, mappings, fields and aliases, before and after a restart."""
    own = Engine(spark, fresh(spark, "administration"))
    said: list[tuple[str, str]] = []
    tell = lambda what, x: said.append((f"{len(said):02d} {what}", json.dumps(x, sort_keys=True)))
    tell("create", own.create_index("a", {"mappings": {"m": {"properties": {"t": {"type": "string"}}}}, "settings": {"analysis": {"filter": {"g": {"type": "edgeNGram", "side": "back", "min_gram": 2, "max_gram": 3}}}}}))
    tell("create again", own.create_index("a"))
    tell("filters", own.get_index("a")["a"]["settings"]["analysis"]["filter"])
    tell("mapping", own.put_mapping("a", {"n": {"properties": {"t": {"type": "string"}, "u": {"type": "integer"}}}}))
    tell("conflict", own.put_mapping("a", {"n": {"properties": {"t": {"type": "integer"}}}}))
    tell("mappings", sorted(own.get_index("a")["a"]["mappings"]))
    tell("alias", own.put_alias("x", "a"))
    tell("alias of a name", own.put_alias("a", "a"))
    tell("get alias", own.get_alias("x"))
    tell("get alias of an index", own.get_alias("x", "b"))
    tell("aliases", own.list_aliases())
    tell("remove field", own.remove_field("a", "u"))
    tell("refresh", own.refresh("a"))
    own.put_document("a", "m", "1", {"t": "one"})
    again = Engine(spark, own.warehouse)
    tell("restart", [sorted(again.stores), again.count("x"), sorted(again.stores["a"].mapping.fields)])
    tell("index over an alias", again.create_index("x"))
    tell("aliases", again.list_aliases())
    tell("drop", again.delete_index("a"))
    tell("left", sorted(Engine(spark, own.warehouse).stores))
    return spark.createDataFrame(said, "step string, answer string")


_YES, _NO = '{"acknowledged": true}', '{"acknowledged": false}'
_ANSWERS = [("create", _YES), ("create again", _YES), ("filters", '{"asciifolding": {"type": "asciifolding"}, "g": {"max_gram": 3, "min_gram": 2, "side": "back", "type": "edgeNGram"}, "lowercase": {"type": "lowercase"}}'), ("mapping", _YES), ("conflict", _NO), ("mappings", '["m", "n"]'), ("alias", _YES), ("alias of a name", _NO), ("get alias", '{"a": {"aliases": {"x": {}}}}'), ("get alias of an index", "{}"), ("aliases", '{"a": {"aliases": {"x": {}}}}'), ("remove field", _YES), ("refresh", _YES), ("restart", '[["a"], 1, ["t"]]'), ("index over an alias", _YES), ("aliases", '{"a": {"aliases": {}}, "x": {"aliases": {}}}'), ("drop", _YES), ("left", '["x"]')]
_add("administration", _administration, _values([(f"{i:02d} {w}", a) for i, (w, a) in enumerate(_ANSWERS)], "step, answer"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _rows(spark, sf_dir, TABLES["documents"]).repartition(spark.sparkContext.defaultParallelism)
    action = F.to_json(F.struct(F.struct(F.col("doc_id").cast("string").alias("_id"), F.lit("doc").alias("_type"), F.lit("documents").alias("_index")).alias("index")))
    return docs.select(F.concat(action, F.lit("\n"), F.to_json(F.struct("text", "lang", "source", "n_chars"))).alias("value"))


def _bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = TABLES["documents"].mapping
    rows = sources.parse_documents(sources.bulk(_bodies(spark, sf_dir)).select("id", "document"), mapping)
    return rows.select(F.col(sources.KEY).cast("bigint").alias("doc_id"), F.array_join("lang", " ").alias("lang"), F.array_join("source", " ").alias("source"), "n_chars", F.array_join("text", " ").alias("text"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as bulk files through a stream into an index; a file is a request, so it has so many documents at most at any size of the table."""
    folder = fresh(spark, "bulk")
    _bodies(spark, sf_dir).write.option("maxRecordsPerFile", 1000).text(f"{folder}/in")
    engine = Engine(spark, f"{folder}/warehouse")
    engine.create_index("documents", {"mappings": {"doc": {"properties": TABLES["documents"].properties}}})
    stream_bulk(engine, f"{folder}/in", f"{folder}/checkpoint").awaitTermination()
    return engine.stores["documents"].index().docs.select(F.col("doc_key").cast("bigint").alias("doc_id"), "lang", "source", "n_chars", "text")


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as bulk bodies that don't name their index, one of which isn't valid; what each action came to, counted."""
    own = Engine(spark, fresh(spark, "scoped"))
    own.create_index("turns", {"mappings": {"doc": {"properties": TABLES["turns"].properties}}})
    turns = _rows(spark, sf_dir, TABLES["turns"]).where("text IS NOT NULL")
    action = F.concat(F.lit('{"index": {"_type": "doc", "_id": "'), F.col("key").cast("string"), F.lit('"}}'))
    bodies = turns.select(F.concat(action, F.lit("\n"), F.to_json(F.struct("text", "role"))).alias("value")).union(spark.createDataFrame([('{"index": {"_type": "doc", "_id": "bad"}}\n{"text": {}}',)], "value string"))
    out = own.bulk(bodies, "turns")
    return out["items"].groupBy("status").agg(F.count(F.lit(1)).alias("n")).unionByName(spark.createDataFrame([("live", own.count("turns"))], "status string, n bigint"))


_add("bulk_scoped", _scoped, "SELECT 'created' AS status, count(*) AS n FROM conversations WHERE text IS NOT NULL UNION ALL SELECT 'failed', 1 UNION ALL SELECT 'live', count(*) FROM conversations WHERE text IS NOT NULL")

_SAME = "SELECT doc_id, lang, source, n_chars, text FROM documents"
_add("bulk_ndjson_parse", _bulk, _SAME)
_add("stream_bulk", _stream, _SAME)
