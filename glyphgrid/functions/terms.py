"""Terms: the bytes that values of every type are indexed as."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def term_of(value: str | bool | int | datetime) -> bytes:
    """UTF-8; t or f; 64-bit little-endian; for instants, that of the microseconds since 1970."""
    if isinstance(value, str):
        return value.encode("utf-8")
    if isinstance(value, bool):
        return b"t" if value else b"f"
    if isinstance(value, datetime):
        gone = value.astimezone(timezone.utc) - _EPOCH
        value = (gone.days * 86_400 + gone.seconds) * 1_000_000 + gone.microseconds
    return value.to_bytes(8, "little", signed=True)


def text_term(text: Column) -> Column:
    return text.cast("binary")


def integer_term(number: Column) -> Column:
    h = F.lpad(F.hex(number.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)]))


def boolean_term(flag: Column) -> Column:
    return F.when(flag, F.lit("t")).otherwise(F.lit("f")).cast("binary")


def instant_term(instant: Column) -> Column:
    return integer_term(F.unix_micros(instant.cast("timestamp")))


def after(prefix: bytes) -> bytes | None:
    """The least bytes greater than all that begin with prefix; None where there are none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def literal(term: bytes) -> Column:
    return F.lit(bytearray(term))


def begins_with(term: Column, prefix: bytes) -> Column:
    """A byte range, which Parquet filters can use where startswith on binary can't."""
    out, top = term >= literal(prefix), after(prefix)
    return out if top is None else out & (term < literal(top))
