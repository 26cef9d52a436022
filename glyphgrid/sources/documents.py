"""JSON documents to rows: strict coercion by a mapping, and NDJSON bulk bodies."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgrid.operators.index import FieldValueError
from glyphgrid.plans.mapping import ALL, Field, Mapping

KEY = "_key"
_RFC3339 = re.compile(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)")
_ARROW = {"string": pa.list_(pa.string()), "integer": pa.int64(), "boolean": pa.bool_(), "date": pa.timestamp("us", "UTC")}
_SPARK = {"string": "array<string>", "integer": "bigint", "boolean": "boolean", "date": "timestamp"}


def instant(text: str) -> datetime:
    """An RFC 3339 instant; finer digits than microseconds are cut off."""
    if not _RFC3339.fullmatch(text):
        raise ValueError(text)
    return datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text.upper()))


def coerce(name: str, value: Any, f: Field) -> Any:
    """A JSON value as its field's; strings come as lists.  Booleans are lenient: what isn't true or yes is false."""
    if f.type == "boolean":
        return value is True or value == "yes"
    if f.type == "string":
        if isinstance(value, list) and all(v is None or isinstance(v, str) for v in value):
            return [v for v in value if v is not None]
        if isinstance(value, str):
            return [value]
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return [json.dumps(value)]
    elif f.type == "integer":
        if isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63:
            return value
    elif isinstance(value, str):
        try:
            return instant(value)
        except ValueError:
            pass
    raise FieldValueError(f"FieldValueError: {name} of type {f.type} doesn't take {json.dumps(value)}")


def prepare(key: str, document: dict[str, Any], mapping: Mapping) -> dict[str, Any]:
    """The row of a document.  Null is a missing field; a field that isn't mapped is an error; nested ones are passed over."""
    row: dict[str, Any] = {KEY: key}
    texts = []
    for name, value in sorted(document.items()):
        if value is None or name in mapping.nested:
            continue
        if name not in mapping.fields:
            raise FieldValueError(f"FieldDoesntExist: {name}")
        f = mapping.fields[name]
        if f.indexed or f.stored:
            row[name] = coerce(name, value, f)
        if f.indexed and f.in_all and isinstance(value, str):
            texts.append(value)
    if ALL not in mapping.fields:
        row[ALL] = " ".join(texts)
    return row


def row_schema(mapping: Mapping) -> str:
    own = [f"`{n}` {_SPARK[f.type]}" for n, f in mapping.fields.items()]
    return ", ".join([f"{KEY} string", *own, *([f"{ALL} string"] if ALL not in mapping.fields else [])])


def _arrow(rows: list[dict], mapping: Mapping) -> pa.RecordBatch:
    kinds = {KEY: pa.string(), **{n: _ARROW[f.type] for n, f in mapping.fields.items()}} | ({} if ALL in mapping.fields else {ALL: pa.string()})
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in kinds.items()], names=list(kinds))


def rows(spark: SparkSession, documents: list[tuple[str, dict]], mapping: Mapping) -> DataFrame:
    """A few documents as a DataFrame, checked on the driver."""
    made = [prepare(k, d, mapping) for k, d in documents]
    table = _arrow(made, mapping).to_pydict()
    return spark.createDataFrame(list(zip(*table.values())), row_schema(mapping))


def _lines(body: str) -> Iterator[str]:
    """body.split("\\n"), one line at a time."""
    at = 0
    while (to := body.find("\n", at)) >= 0:
        yield body[at:to]
        at = to + 1
    yield body[at:]


#: Characters of documents that are held as Python objects at once.
HELD = 4_000_000


def _slices(batch: pa.RecordBatch, column: str, most: int = HELD) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of a text column, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64) + 100)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def actions(body: str) -> Iterator[tuple[int, dict, str]]:
    """(line, parameters, document line) of a bulk body.

    Lines come in pairs, an action and its document.  Actions but index are
    passed over without a document line; reading ends at the first empty line.
    """
    lines = iter(enumerate(_lines(body)))
    for number, line in lines:
        if not line.strip():
            return
        action = json.loads(line)
        if not isinstance(action, dict) or len(action) != 1:
            raise ValueError(f"bulk line {number + 1}: not one action")
        kind, parameters = next(iter(action.items()))
        if kind == "index":
            _, document = next(lines, (0, ""))
            if not document.strip():
                raise ValueError(f"bulk line {number + 2}: no document")
            yield number, parameters, document


def bulk(bodies: DataFrame, index: str | None = None) -> DataFrame:
    """(request, line, index, type, id, document, error) of bulk bodies in a column value, one request a row.

    Actions are in order of a column request, if there is one, and of their lines.
    index stands for actions that don't name one.  A line that is no action gives
    a row with its error and ends its body, as what follows can't be told apart; an
    action without _id, _type or _index gives one too, and reading goes on.
    """
    request = F.col("request").cast("string") if "request" in bodies.columns else F.lit("")
    names = ["request", "line", "index", "type", "id", "document", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):  # one body is text at a time
                request, body = b.column("request")[row].as_py(), b.column("value")[row].as_py()
                made: list[tuple] = []
                held = 0

                def out() -> pa.RecordBatch:
                    cols = list(zip(*made))
                    made.clear()
                    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(cols)], names=names)

                number = -1
                try:
                    for number, p, d in actions(body):
                        where = (p.get("_index", index), p.get("_type"), p.get("_id"))
                        missing = [n for n, v in zip(("_index", "_type", "_id"), where) if v is None]
                        made.append((request, number, *(None if v is None else str(v) for v in where), d, f"ExpectedKey: {', '.join(missing)}" if missing else None))
                        held += len(d) + 100
                        if held >= HELD:
                            held = 0
                            yield out()
                except (ValueError, AttributeError) as e:
                    made.append((request, number + 1, None, None, None, None, f"BadAction: {e}"))
                if made:
                    yield out()

    return bodies.select(request.alias("request"), F.col("value").cast("string").alias("value")).where("value IS NOT NULL").mapInArrow(run, "request string, line bigint, index string, type string, id string, document string, error string")


def read_bulk(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """bulk() of the files in a folder, each one request, in order of their names."""
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("request"))
    return bulk(files, index)


ERROR = "_error"


def parse_documents(documents: DataFrame, mapping: Mapping, strict: bool = True) -> DataFrame:
    """The rows of documents (id, document), with their other columns.

    strict raises where one doesn't fit the mapping; else such a row has the
    reason in a column _error and nothing but its key.
    """
    more = [c for c in documents.columns if c not in ("id", "document")]
    kind = ", ".join([row_schema(mapping), *([] if strict else [f"{ERROR} string"]), *[f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in more]])

    def one(key: str, text: str) -> dict[str, Any]:
        try:
            return prepare(key, _object(text), mapping)
        except ValueError as e:
            if strict:
                raise
            return {KEY: key, ERROR: str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in _slices(batch, "document")):
            made = [one(k, d) for k, d in zip(b.column("id").to_pylist(), b.column("document").to_pylist())]
            out = _arrow(made, mapping)
            errors = [] if strict else [pa.array([r.get(ERROR) for r in made], pa.string())]
            yield pa.RecordBatch.from_arrays([*out.columns, *errors, *(b.column(c) for c in more)], names=[*out.schema.names, *([] if strict else [ERROR]), *more])

    return documents.select("id", "document", *more).mapInArrow(run, kind)


def _object(text: str) -> dict[str, Any]:
    found = json.loads(text)
    if not isinstance(found, dict):
        raise FieldValueError("ExpectedObject")
    return found


def schema_of(mapping: Mapping) -> T.StructType:
    return mapping.schema()
