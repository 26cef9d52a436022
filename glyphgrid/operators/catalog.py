"""The engine: indices, mappings and aliases by name, and documents in and out of them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrid.operators import search as searching
from glyphgrid.operators.index import build
from glyphgrid.plans.mapping import parse_index, parse_mapping
from glyphgrid.plans.query import Query
from glyphgrid.sources import documents
from glyphgrid.sources.store import GRACE_SECONDS, Files, Store


_ALIASES = "aliases.json"


class NotFound(KeyError):
    pass


def _last(rows: DataFrame, key: Column, order: Column, columns: Sequence[str]) -> DataFrame:
    """Of the rows with one key the last by order, with these columns; hot keys are reduced before they meet."""
    name = "_glyphgrid_row"
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    return rows.groupBy(key.alias("_glyphgrid_key")).agg(F.max_by(whole, F.struct(order.isNotNull(), order)).alias(name)).select(f"{name}.*")


def _single(rows: DataFrame, key: Column, order: Column, columns: Sequence[str]) -> DataFrame:
    """_last(), written once; rows as they are where no key comes twice, which the keys alone tell, so that whole rows aren't shuffled."""
    if rows.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return rows.select(*[F.col(f"`{c}`") for c in columns])
    return _written(rows.sparkSession, _last(rows, key, order, columns), "last")


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder once, as several jobs read it."""
    from glyphgrid.sources.shared import fresh

    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


class Names:
    """Index names and aliases in one namespace."""

    def __init__(self) -> None:
        self.indices: set[str] = set()
        self.aliases: dict[str, list[str]] = {}

    def add(self, name: str) -> bool:
        """A new index; an alias of that name goes.  False where there is one."""
        self.aliases.pop(name, None)
        new = name not in self.indices
        self.indices.add(name)
        return new

    def remove(self, name: str) -> None:
        """An index and its places in aliases; aliases that become empty go."""
        self.indices.discard(name)
        for alias, of in list(self.aliases.items()):
            self.aliases[alias] = [i for i in of if i != name]
            if name in of and not self.aliases[alias]:
                del self.aliases[alias]

    def put_alias(self, name: str, of: Sequence[str]) -> bool:
        if name in self.indices:
            return False
        self.aliases[name] = list(of)
        return True

    def find(self, name: str) -> list[str]:
        return [name] if name in self.indices else list(self.aliases.get(name, []))

    def of(self, index: str) -> list[str]:
        return sorted(a for a, of in self.aliases.items() if index in of)


class Engine:
    """A warehouse folder of indices and aliases."""

    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.warehouse, self.names = spark, warehouse.rstrip("/"), Names()
        self.stores: dict[str, Store] = {}
        self.files = Files(spark, self.warehouse)
        for name in self.files.folders():
            if Store.is_one(spark, f"{self.warehouse}/{name}"):
                self.stores[name] = Store.open(spark, f"{self.warehouse}/{name}")
                self.names.add(name)
        if self.files.exists(_ALIASES):
            for alias, of in json.loads(self.files.read(_ALIASES)).items():
                self.names.put_alias(alias, [i for i in of if i in self.stores])

    def _keep_aliases(self) -> None:
        self.files.replace(_ALIASES, json.dumps(self.names.aliases))

    def _store(self, name: str) -> Store:
        if name not in self.stores:
            raise NotFound(name)
        return self.stores[name]

    # indices, mappings, aliases

    def create_index(self, name: str, body: dict | None = None) -> dict:
        """An index that exists already is left as it is."""
        if name not in self.stores:
            settings, mappings = parse_index(body or {})
            self.stores[name] = Store.create(self.spark, f"{self.warehouse}/{name}", settings, mappings)
        if name in self.names.aliases:
            self.names.add(name)
            self._keep_aliases()
        self.names.add(name)
        return {"acknowledged": True}

    def get_index(self, name: str) -> dict:
        store = self._store(name)
        return {name: {"aliases": {a: {} for a in self.names.of(name)}, "mappings": store.manifest["mappings"], "settings": store.manifest["settings"]}}

    def delete_index(self, name: str) -> dict:
        self._store(name).files.remove()
        del self.stores[name]
        if self.names.of(name):
            self.names.remove(name)
            self._keep_aliases()
        self.names.remove(name)
        return {"acknowledged": True}

    def refresh(self, name: str) -> dict:
        """What is written is visible already."""
        self._store(name)
        return {"acknowledged": True}

    def put_mapping(self, index: str, body: dict) -> dict:
        """body is one mapping by its name."""
        name, mapping = next(iter(body.items()))
        return {"acknowledged": self._store(index).put_mapping(name, parse_mapping(mapping))}

    def remove_field(self, index: str, field: str) -> dict:
        """Takes a field out of the index's mappings and searches."""
        return {"acknowledged": self._store(index).remove_field(field)}

    def put_alias(self, alias: str, selector: str) -> dict:
        """The alias stands for the selector's indices; an unknown selector gives an empty one."""
        done = self.names.put_alias(alias, self.names.find(selector))
        if done:
            self._keep_aliases()
        return {"acknowledged": done}

    def get_alias(self, alias: str, index: str | None = None) -> dict:
        found = self.names.find(alias)
        if index is not None:
            found = [i for i in found if i == index]
        return {i: {"aliases": {alias: {}}} for i in found}

    def list_aliases(self) -> dict:
        return {i: {"aliases": {a: {} for a in self.names.of(i)}} for i in sorted(self.names.indices)}

    # documents

    def _mapping(self, index: str, kind: str):
        store = self._store(index)
        if kind not in store.mappings:
            raise NotFound(f"{index}/{kind}")
        return store, store.mappings[kind]

    def put_document(self, index: str, kind: str, key: str, document: dict | None) -> dict:
        """Adds or replaces a document; one without fields is a document too."""
        if document is None:
            raise NotFound("No data")
        store, mapping = self._mapping(index, kind)
        rows = documents.rows(self.spark, [(key, document)], mapping)
        store.append(build(rows, mapping, documents.KEY, store.settings))
        return {}

    def get_document(self, index: str, kind: str, key: str) -> dict | None:
        """The stored fields, or None."""
        store, _ = self._mapping(index, kind)
        found = store.index().docs.where(F.col("doc_key") == key).first()
        return None if found is None else {k: v for k, v in found.asDict().items() if k != "doc_key" and v is not None}

    def delete_document(self, index: str, kind: str, key: str) -> bool:
        store, _ = self._mapping(index, kind)
        if store.index().docs.where(F.col("doc_key") == key).isEmpty():
            return False
        store.delete(self.spark.createDataFrame([(key,)], "doc_key string"))
        return True

    def upsert(self, index: str, kind: str, rows: DataFrame, key: str, seq: str | None = None) -> int:
        """Columns of a DataFrame as documents; of rows with one key the last by seq counts.  The new segment."""
        store, mapping = self._mapping(index, kind)
        own = rows.where(F.col(f"`{key}`").isNotNull())
        order = F.col(f"`{seq}`") if seq else F.lit(0)
        columns = [c for c in rows.columns if c != seq]
        return store.append(build(_single(own, F.col(f"`{key}`").cast("string"), order, columns), mapping, key, store.settings))

    def bulk(self, bodies: DataFrame, index: str | None = None) -> dict:
        """Bulk bodies (value[, request]): {"took": number of actions, "errors": whether any failed, "items": DataFrame}.

        items has a row (request, line, index, type, id, status, error) for each
        action: created, or why it failed.  One that fails leaves the others as
        they are.  Of one key the last valid action counts.  A segment is written
        for each index and mapping instead of one for each document.
        """
        found = _written(self.spark, documents.bulk(bodies, index), "bulk")
        groups = found.where("error IS NULL").groupBy("index", "type").count().collect()
        items = [found.where("error IS NOT NULL").drop("document")]
        for g in groups:
            own = found.where((F.col("index") == g["index"]) & (F.col("type") == g["type"]) & F.col("error").isNull())
            try:
                store, mapping = self._mapping(g["index"], g["type"])
            except NotFound as e:
                items.append(own.drop("document").withColumn("error", F.lit(f"NotFound: {e.args[0]}")))
                continue
            parsed = _written(self.spark, documents.parse_documents(own.select("request", "line", "id", "document"), mapping, strict=False), "bulk")
            row = [c for c in parsed.columns if c not in ("request", "line", documents.ERROR)]
            good = parsed.where(F.col(documents.ERROR).isNull())
            if not good.isEmpty():
                last = _single(good, F.col(documents.KEY), F.struct("request", "line"), row)
                store.append(build(last, mapping, documents.KEY, store.settings))
            items.append(parsed.select("request", "line", F.lit(g["index"]).alias("index"), F.lit(g["type"]).alias("type"), F.col(documents.KEY).alias("id"), F.col(documents.ERROR).alias("error")))
        all_ = reduce(DataFrame.unionByName, items).select("request", "line", "index", "type", "id", F.when(F.col("error").isNull(), "created").otherwise("failed").alias("status"), "error")
        n = all_.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad")).first()
        return {"took": n["n"], "errors": n["bad"] > 0, "items": all_}

    def bulk_request(self, body: str, index: str | None = None) -> dict:
        """One body, as a request brings it: {"took": n, "errors": ..., "items": [{"create": {"_index", "_type", "_id"[, "error"]}}]} in order."""
        out = self.bulk(self.spark.createDataFrame([(body,)], "value string"), index)
        rows = out["items"].orderBy("line").collect()
        return out | {"items": [{"create": {"_index": r["index"], "_type": r["type"], "_id": r["id"]} | ({"error": r["error"]} if r["error"] else {})} for r in rows]}

    def optimize(self, index: str) -> None:
        self._store(index).optimize()

    def maintain(self, grace: float = GRACE_SECONDS) -> list[str]:
        """Merges each index's tier of segments that has become full, and removes what earlier merges replaced; the names of those merged."""
        done = []
        for name, store in sorted(self.stores.items()):
            store.reload()
            if tier := store.due():
                store.merge(tier)
                done.append(name)
            store.purge(grace)
        return done

    # queries

    def _each(self, name: str) -> list[str]:
        found = self.names.find(name)
        if not found and name not in self.names.aliases:
            raise NotFound(name)
        return found

    def count(self, name: str, query: Query | dict | str | None = None) -> int:
        """Matches in an index or in all of an alias."""
        return sum(searching.count(self.stores[i].index(), query).first()["count"] for i in self._each(name))

    def hits(self, name: str, query: Query | dict | str) -> DataFrame:
        """(index, doc_key, score) of all matches; scores are by each index's own statistics."""
        from glyphgrid.plans.compile import matches

        each = []
        for i in self._each(name):
            own = self.stores[i].index()
            each.append(matches(own, searching.read(own, query)).select(F.lit(i).alias("index"), "doc_key", "score"))
        if not each:
            return self.spark.createDataFrame([], "index string, doc_key string, score double")
        return reduce(DataFrame.unionByName, each)

    def search(self, name: str, query: Query | dict | str, from_: int = 0, size: int = 10, fields: Sequence[str] = ()) -> dict:
        """A page of hits with the stored fields asked for."""
        found = self._each(name)
        if len(found) == 1:
            return searching.response(searching.search(self.stores[found[0]].index(), query, from_, size, fields))
        page = self.hits(name, query).orderBy(F.desc("score"), "index", "doc_key").offset(from_).limit(size)
        return searching.response(page.drop("index"))
