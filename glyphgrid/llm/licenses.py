"""Licence scan: ordered regex rules behind a keyword prefilter, overlaps resolved.

A text's keywords are found in one Aho-Corasick pass; only rules whose keyword
is there run, over the whole text.  Of the matches, those of higher priority
stand and hide every lower one that overlaps them; among matches of one
priority, one that lies within another is dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrid.llm.common import per_slice
from glyphgrid.llm.license_rules import RULES


@dataclass(frozen=True)
class Rule:
    number: int
    license: str
    priority: int
    keyword: str
    pattern: str

    @property
    def regex(self) -> re.Pattern:
        # ASCII case folding only, so that a match always holds its keyword in lower case
        spaced = self.pattern.replace("[- ]", r"(?:-|\s+)").replace(" ", r"\s+").replace(r"\s+?", r"\s*")
        return re.compile(spaced, re.IGNORECASE | re.ASCII)


def parse(lines: str = RULES) -> list[Rule]:
    rules = []
    for line in lines.strip().splitlines():
        name, priority, keyword, pattern = line.split("|", 3)
        rules.append(Rule(len(rules), name, int(priority), keyword, pattern))
    return rules


class Scanner:
    def __init__(self, rules: list[Rule] | None = None):
        self.rules = parse() if rules is None else rules
        self.regexes = [r.regex for r in self.rules]
        by: dict[str, list[int]] = {}
        for r in self.rules:
            by.setdefault(r.keyword, []).append(r.number)
        self.words = ahocorasick.Automaton()
        for word, numbers in by.items():
            self.words.add_word(word, numbers)
        self.words.make_automaton()

    def raw(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) of all matches."""
        wanted: dict[int, None] = {}
        for _, numbers in self.words.iter(" ".join(text.lower().replace("-", " ").split())):
            wanted.update(dict.fromkeys(numbers))
        return [(m.start(), m.end(), n) for n in sorted(wanted) for m in self.regexes[n].finditer(text)]

    def resolve(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        kept: list[tuple[int, int, int]] = []
        above: list[tuple[int, int]] = []  # disjoint and sorted: what higher priorities cover
        for level in sorted({self.rules[n].priority for *_, n in found}, reverse=True):
            free = []
            for s, e, n in found:
                if self.rules[n].priority == level:
                    i = bisect_left(above, (s + 1,)) - 1
                    if not (i >= 0 and above[i][1] > s) and not (i + 1 < len(above) and above[i + 1][0] < e):
                        free.append((s, e, n))
            stay, reach = [], -1
            for s, e, n in sorted(free, key=lambda x: (x[0], -x[1], x[2])):
                if e > reach:
                    stay.append((s, e, n))
                    reach = e
            kept += stay
            merged: list[tuple[int, int]] = []
            for s, e in sorted(above + [(s, e) for s, e, _ in stay]):
                if merged and s <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
                else:
                    merged.append((s, e))
            above = merged
        return sorted(kept)

    def scan(self, text: str | None) -> list[tuple[int, int, int]]:
        return self.resolve(self.raw(text)) if text else []


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, license, rule, priority, start, end, match): a row for each detection that stands.

    start and end are character offsets.  Of equal intervals of one priority the
    earlier rule's stands.  Null and empty texts and texts without a detection
    give no rows; repeated rows are scanned repeatedly; a null doc_id is carried
    along; texts are scanned whole; other columns are ignored.
    """
    made: list[Scanner] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Scanner(rules))
        own, doc = made[0].rules, b.column("doc_id").to_pylist()
        rows = [(doc[i], own[n].license, n, own[n].priority, s, e, t[s:e]) for i, t in enumerate(b.column("text").to_pylist()) if t for s, e, n in made[0].scan(t)]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names=["doc_id", "license", "rule", "priority", "start", "end", "match"])

    kind = "doc_id bigint, license string, rule int, priority int, start bigint, end bigint, match string"
    return docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(per_slice(run), kind)


def _re2(pattern: str) -> tuple[str, str]:
    """A rule's pattern without its closing negative lookahead, which RE2 lacks, and what that forbids."""
    pattern = pattern.replace(r"(?:(?!\n\s*\n|neither\s+the\s+name\s+of)[\s\S])+?", r"(?:[^\n]|\n[ \t\r]*[^\s])+?")
    at = pattern.rfind("(?!")
    return (pattern, "") if at < 0 else (pattern[:at], pattern[at + 3 : -1])


def sql() -> str:
    """scan() in DuckDB SQL over the view documents.

    Every match is found with what lies before it, so that lengths add up to
    offsets; what a lookahead forbids is matched too where it is there, and the
    match left out.
    """
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = []
    for r in parse():
        own, forbidden = _re2(r.regex.pattern)
        rows.append(f"({r.number}, {quote(r.license)}, {r.priority}, {quote(r.keyword)}, {quote(f'(?is)(.*?)({own})((?:{forbidden})?)')})")
    stays = lambda level, free: f"s{level} AS MATERIALIZED (SELECT * FROM (SELECT *, max(e) OVER (PARTITION BY row_ ORDER BY s, e DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {free}) WHERE reach IS NULL OR e > reach)"
    apart = lambda level, above: f"(SELECT * FROM m WHERE priority = {level} AND NOT EXISTS (FROM ({above}) h WHERE h.row_ = m.row_ AND m.s < h.e AND h.s < m.e))"
    return f"""
WITH rules(rule, license, priority, keyword, pattern) AS (VALUES {", ".join(rows)}),
d AS MATERIALIZED (SELECT row_number() OVER () AS row_, doc_id, text, trim(regexp_replace(replace(lower(text), '-', ' '), '\\s+', ' ', 'g')) AS plain FROM documents WHERE text IS NOT NULL),
hit AS MATERIALIZED (SELECT row_, doc_id, text, rule, license, priority, regexp_extract_all(text, pattern, 1) AS before, regexp_extract_all(text, pattern, 2) AS own, regexp_extract_all(text, pattern, 3) AS after FROM d JOIN rules ON contains(plain, keyword)),
part AS (SELECT row_, doc_id, rule, license, priority, generate_subscripts(own, 1) AS i, unnest(before) AS b, unnest(own) AS o, unnest(after) AS a FROM hit),
m AS MATERIALIZED (SELECT row_, doc_id, rule, license, priority, CAST(e - length(o) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, o FROM (SELECT *, sum(length(b) + length(o) + length(a)) OVER (PARTITION BY row_, rule ORDER BY i) - length(a) AS e FROM part) WHERE a = ''),
{stays(3, "(SELECT * FROM m WHERE priority = 3)")},
{stays(2, apart(2, "SELECT * FROM s3"))},
{stays(1, apart(1, "SELECT * FROM s3 UNION ALL SELECT * FROM s2"))}
SELECT doc_id, license, rule, priority, s AS start, e AS "end", o AS match FROM (SELECT * FROM s3 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s1)"""
