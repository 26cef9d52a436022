"""Scoring arithmetic as Columns, in double precision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def term_frequency(tf: Column) -> Column:
    return F.log1p(tf.cast("double")) + 1


def inverse_frequency(docs: Column, with_term: Column) -> Column:
    return F.log((docs + 1) / (with_term + 1)) + 1


def length_code(tokens: Column) -> Column:
    """A field's length in one byte, by its square root in thirds."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.sqrt(tokens.cast("double")) - 1) * 3))).cast("int")


def root_length(code: Column) -> Column:
    """The square root of the length that a code stands for."""
    return code / F.lit(3.0) + 1


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75

    def score(self, tf: Column, code: Column, tokens: Column, docs: Column, with_term: Column) -> Column:
        """tf is damped by a logarithm and the length ratio by a square root; 1 is added below."""
        t = term_frequency(tf)
        ratio = root_length(code) / F.sqrt((tokens + 1) / (docs + 1))
        below = t + self.k1 * ((1 - self.b) + self.b * ratio) + 1
        return inverse_frequency(docs, with_term) * (self.k1 + 1) * (t / below)


@dataclass(frozen=True)
class TfIdf:
    def score(self, tf: Column, code: Column, tokens: Column, docs: Column, with_term: Column) -> Column:
        return term_frequency(tf) * inverse_frequency(docs, with_term)
