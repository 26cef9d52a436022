"""Set algebra on document keys, as semi and anti joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrid.functions.terms import literal
from glyphgrid.operators.index import Index


def having(index: Index, field: str, term: bytes) -> DataFrame:
    """(doc_key) of the documents whose field has the term."""
    return index.postings.where((F.col("field") == field) & (F.col("term") == literal(term))).select("doc_key")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_key", "left_semi")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_key", "left_anti")


def complement(index: Index, a: DataFrame) -> DataFrame:
    return without(index.docs.select("doc_key"), a)


def fold(index: Index, how: str, sets: list[DataFrame]) -> DataFrame:
    """and or or over any number of sets; none is the empty set."""
    if not sets:
        return index.docs.select("doc_key").where(F.lit(False))
    return reduce(both if how == "and" else either, sets)
