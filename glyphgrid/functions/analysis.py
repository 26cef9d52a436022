"""Analyzers: text to ARRAY<STRUCT<term STRING, position INT>>, in Arrow batches and on the driver.

Word boundaries of UAX #29 are beyond what the JVM's expressions know, so texts go
to Python once, in batches, through the code that also analyses query texts.
Lowercasing and folding change all words of a text in one pass.  Configuration is
plain data that reads from and writes to JSON.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphgrid.functions.folding import fold_text
from glyphgrid.functions.words import words

#: Words as engines with RE2 can find them: like words() for scripts without rules of their own, but for marks and rare signs.
PLAIN_WORD = r"(?:[\p{L}\p{M}]+(?:['’.:·][\p{L}\p{M}]+)*|\p{N}+(?:[.,;'’]\p{N}+)*|_+)+"
TOKENS = "array<struct<term:string,position:int>>"


@dataclass(frozen=True)
class Grams:
    """Grapheme n-grams of a word; edge is None, front or back."""

    min_gram: int = 1
    max_gram: int = 2
    edge: str | None = None

    def of_text(self, word: str) -> list[str]:
        g = list(word) if word.isascii() else regex.findall(r"\X", word)
        n, lo = len(g), max(self.min_gram, 1)
        if self.max_gram == 0 or n < lo:
            return []
        if lo > self.max_gram:
            return ["".join(g[-lo:] if self.edge == "back" else g[:lo])]
        if self.edge == "front":
            return ["".join(g[:s]) for s in range(lo, min(self.max_gram, n) + 1)]
        if self.edge == "back":
            return ["".join(g[n - s :]) for s in range(lo, min(self.max_gram, n) + 1)]
        return ["".join(g[i : i + s]) for i in range(n - lo + 1) for s in range(lo, min(self.max_gram, n - i) + 1)]


#: Terms of a text, and their positions where these aren't 1, 2, 3 and so on.
Tokens = tuple[list[str], list[int] | None]


@dataclass(frozen=True)
class Tokenizer:
    """standard or lowercase words, or the grams of each word; grams share its position."""

    kind: str = "standard"
    grams: Grams | None = None

    def split(self, text: str) -> Tokens:
        found: Tokens = (words(text), None)
        if self.kind == "lowercase":
            found = LOWERCASE.change(found)
        return found if self.grams is None else TokenFilter("grams", self.grams).change(found)

    def tokens(self, text: Column) -> Column:
        return Analyzer(self).tokens(text)

    def tokens_of(self, text: str) -> list[tuple[str, int]]:
        return Analyzer(self).tokens_of(text)


@dataclass(frozen=True)
class TokenFilter:
    """lowercase, asciifolding, or the grams of each token."""

    kind: str
    grams: Grams | None = None

    def change(self, tokens: Tokens) -> Tokens:
        terms, at = tokens
        if not terms:
            return tokens
        if self.grams is None:
            # no word holds a line break, so all are changed as one string
            return self.of_lines("\n".join(terms)).split("\n"), at
        out: list[str] = []
        positions: list[int] = []
        for i, t in enumerate(terms):
            own = self.grams.of_text(t)
            out += own
            positions += [i + 1 if at is None else at[i]] * len(own)
        return out, positions

    def of_lines(self, terms: str) -> str:
        """The same of terms, one a line, where it makes no grams."""
        return terms.lower() if self.kind == "lowercase" else fold_text(terms)


@dataclass(frozen=True)
class Analyzer:
    tokenizer: Tokenizer = Tokenizer()
    filters: tuple[TokenFilter, ...] = field(default=())

    def split(self, text: str) -> Tokens:
        out = self.tokenizer.split(text)
        for f in self.filters:
            out = f.change(out)
        return out

    def tokens(self, text: Column) -> Column:
        """The analysed text; null for a null text."""
        return _column(self.split)(text)

    def tokens_of(self, text: str) -> list[tuple[str, int]]:
        """The same for one string, on the driver: for query texts."""
        terms, at = self.split(text)
        return list(zip(terms, range(1, len(terms) + 1) if at is None else at))

    @property
    def one_per_position(self) -> bool:
        return self.tokenizer.grams is None and all(f.grams is None for f in self.filters)


def split_list(values: list[str | None], analyzer: Analyzer | None) -> Tokens:
    """Tokens of the elements in order, positions going on from one to the next; null elements have none.

    Without an analyzer each element is one token.
    """
    terms: list[str] = []
    positions: list[int] = []
    last = 0
    for v in values:
        if v is not None:
            own, at = ([v], None) if analyzer is None else analyzer.split(v)
            terms += own
            positions += range(last + 1, last + 1 + len(own)) if at is None else [p + last for p in at]
            last = positions[-1] if own else last
    return terms, positions


def list_tokens(values: Column, analyzer: Analyzer | None) -> Column:
    """split_list() of an array<string> column."""
    return _column(lambda x: split_list(x, analyzer))(values)


def _column(split: Callable[..., Tokens]) -> Callable[[Column], Column]:
    @F.arrow_udf(TOKENS)
    def run(values: pa.Array) -> pa.Array:
        offsets, terms, positions, null = [0], [], [], []
        for x in values.to_pylist():
            null.append(x is None)
            if x is not None:
                own, at = split(x)
                terms += own
                positions.append(np.arange(1, len(own) + 1, dtype=np.int32) if at is None else np.array(at, np.int32))
            offsets.append(len(terms))
        at = np.concatenate(positions) if positions else np.zeros(0, np.int32)
        made = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(at, pa.int32())], ["term", "position"])
        # from_arrays reads a null offset as a null list
        starts = pa.array(offsets, pa.int32(), mask=np.array([*null, False]))
        return pa.ListArray.from_arrays(starts, made)

    return run


STANDARD_TOKENIZER, LOWERCASE_TOKENIZER = Tokenizer("standard"), Tokenizer("lowercase")
LOWERCASE, ASCII_FOLDING = TokenFilter("lowercase"), TokenFilter("asciifolding")
STANDARD = Analyzer(STANDARD_TOKENIZER, (LOWERCASE, ASCII_FOLDING))
