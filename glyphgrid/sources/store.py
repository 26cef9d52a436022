"""An index on disk: immutable Parquet segments under numbered manifests.

A segment's tables never change.  Deletes are rows (doc_key, segment) of the
documents that were live, with what the statistics lose by them; so statistics of
live documents are sums of small tables, and no query counts postings.  Every change
is a manifest of the next number, which only one writer can create; who comes late
starts again from the other's.  merge() writes the live rows of some segments as
one; what it replaces stays until purge(), for those who read it.  All access goes
through Hadoop's file systems, so a store may lie in any folder that the cluster
shares.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrid.operators.index import Index, lengths_of, pack, posting_blocks, spread_blocks, term_counts, unpack
from glyphgrid.plans.mapping import Mapping, Settings, parse_index, settings_json

#: So many deleted documents, as manifests count them, are broadcast at most; more meet the tables in a shuffle.
BROADCAST_KEYS = 1_000_000
GRACE_SECONDS, KEPT_MANIFESTS = 3600.0, 20


class Files:
    """The few file operations that a manifest needs."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self._jvm, self._conf, self.folder = jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder.rstrip("/")
        self._fs = jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(self._conf)

    def path(self, name: str = "") -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A file that appears whole; FileExistsError where there is one of that name."""
        beside = f".{name}.{uuid.uuid4().hex}"
        self._write(beside, text)
        try:
            self._rename(beside, name, False)
        except Py4JJavaError as e:
            self.remove(beside)
            if "FileAlreadyExists" in str(e.java_exception):
                raise FileExistsError(name) from None
            raise

    def replace(self, name: str, text: str) -> None:
        """Writes beside the file and renames over it."""
        beside = f".{name}.{uuid.uuid4().hex}"
        self._write(beside, text)
        self._rename(beside, name, True)

    def _write(self, name: str, text: str) -> None:
        stream = self._fs.create(self.path(name), False)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()

    def _rename(self, old: str, new: str, over: bool) -> None:
        jvm = self._jvm
        kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = jvm.java.lang.reflect.Array.newInstance(kind, 1)
        options[0] = jvm.java.lang.Enum.valueOf(kind, "OVERWRITE" if over else "NONE")
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri(), self._conf).rename(self.path(old), self.path(new), options)

    def remove(self, name: str = "") -> None:
        self._fs.delete(self.path(name), True)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path())) if self.exists() else []

    def folders(self) -> list[str]:
        if not self.exists():
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path()) if s.isDirectory())


class Conflict(RuntimeError):
    """Another writer's manifest came first."""


class Store:
    """One index's segments and metadata."""

    def __init__(self, spark: SparkSession, folder: str, manifest: dict[str, Any], number: int):
        self.spark, self.files = spark, Files(spark, folder)
        self._take(manifest, number)

    def _take(self, manifest: dict[str, Any], number: int) -> None:
        self.manifest, self.number = manifest, number
        self.settings, self.mappings = parse_index({"settings": manifest["settings"], "mappings": manifest["mappings"]})

    @classmethod
    def create(cls, spark: SparkSession, folder: str, settings: Settings | None = None, mappings: dict[str, Mapping] | None = None) -> Store:
        manifest = {"settings": settings_json(settings or Settings()), "mappings": {n: m.to_json() for n, m in (mappings or {}).items()}, "segments": [], "deletes": [], "next": 1, "removed": {}, "retired": []}
        Files(spark, folder).create(_name(1), json.dumps(manifest))
        return cls(spark, folder, manifest, 1)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Store:
        number, manifest = cls._latest(Files(spark, folder))
        return cls(spark, folder, manifest, number)

    @staticmethod
    def is_one(spark: SparkSession, folder: str) -> bool:
        return bool(_numbers(Files(spark, folder)))

    @staticmethod
    def _latest(files: Files) -> tuple[int, dict[str, Any]]:
        numbers = _numbers(files)
        if not numbers:
            raise FileNotFoundError(files.folder)
        return numbers[-1], json.loads(files.read(_name(numbers[-1])))

    def reload(self) -> None:
        """Goes on from the latest manifest, other writers' too."""
        number, manifest = self._latest(self.files)
        if number != self.number:
            self._take(manifest, number)

    def _commit(self, **changes: Any) -> None:
        """The next manifest; Conflict where another writer has written it, so that none is lost."""
        manifest = self.manifest | changes
        try:
            self.files.create(_name(self.number + 1), json.dumps(manifest))
        except FileExistsError:
            raise Conflict(self.files.folder) from None
        self._take(manifest, self.number + 1)

    def _retry(self, change: Callable[[], Any]) -> Any:
        """change() on the latest manifest, again for as long as others come first."""
        while True:
            self.reload()
            try:
                return change()
            except Conflict:
                continue

    # mappings

    def put_mapping(self, name: str, mapping: Mapping) -> bool:
        """Adds or replaces a mapping; False where a field has another type or other uses already, or had before its removal."""

        def change() -> bool:
            known = {n: (f.type, f.indexed, f.stored) for m in self.mappings.values() for n, f in m.fields.items()}
            known |= {n: tuple(r["kind"]) for n, r in self.manifest["removed"].items()}
            if any(n in known and known[n] != (f.type, f.indexed, f.stored) for n, f in mapping.fields.items()):
                return False
            self._commit(mappings=self.manifest["mappings"] | {name: mapping.to_json()})
            return True

        return self._retry(change)

    def remove_field(self, name: str) -> bool:
        """Takes a field out of all mappings; what segments hold of it isn't read again.  False where there is none."""

        def change() -> bool:
            own = [f for m in self.mappings.values() for n, f in m.fields.items() if n == name]
            if not own:
                return False
            left = {k: Mapping({n: f for n, f in m.fields.items() if n != name}, m.nested).to_json() for k, m in self.mappings.items()}
            gone = {"kind": [own[0].type, own[0].indexed, own[0].stored], "segments": [s["id"] for s in self.manifest["segments"]]}
            self._commit(mappings=left, removed=self.manifest["removed"] | {name: gone})
            return True

        return self._retry(change)

    @property
    def mapping(self) -> Mapping:
        """All mappings' fields; one name is one field throughout."""
        fields, nested = {}, {}
        for m in self.mappings.values():
            fields |= m.fields
            nested |= m.nested
        return Mapping(fields, nested)

    # writing

    def _path(self, name: str, table: str) -> str:
        return f"{self.files.folder}/{name}/{table}"

    def _write(self, docs: DataFrame, packed: DataFrame) -> tuple[str, int]:
        """A segment's folder and number of documents; packed vectors are written first, and all else is made from what was.

        Documents by term aren't a table of their own, as blocks tell how many they have.
        """
        segment = f"segment-{uuid.uuid4().hex}"
        own = lambda df: df.drop("segment").withColumn("segment", F.lit(segment))
        write = lambda df, table: df.write.mode("overwrite").option("compression", "zstd").parquet(self._path(segment, table))
        write(own(packed), "packed")
        write(own(docs), "docs")
        found = self.spark.read.parquet(self._path(segment, "packed"))
        write(own(posting_blocks(found)), "blocks")
        write(own(found.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))).coalesce(1), "field_stats")
        return segment, self.spark.read.parquet(self._path(segment, "docs")).count()

    def append(self, index: Index, replaces: bool = True) -> int:
        """Adds a segment, whose number comes back; with replaces its documents take the place of those that have their keys."""
        segment, rows = self._write(index.docs, index.packed)

        def change() -> int:
            deletes, number = list(self.manifest["deletes"]), self.manifest["next"]
            if replaces and self.manifest["segments"]:
                gone = self._delete(self.spark.read.parquet(self._path(segment, "docs")).select("doc_key"))
                deletes += [gone] if gone else []
            self._commit_with(deletes, segments=[*self.manifest["segments"], {"id": segment, "number": number, "docs": rows}], next=number + 1)
            return number

        return self._retry(change)

    def _commit_with(self, deletes: list[dict[str, Any]], **changes: Any) -> None:
        """A commit of new deletes, which are removed again if another writer comes first."""
        old = [d["id"] for d in self.manifest["deletes"]]
        try:
            self._commit(deletes=deletes, **changes)
        except Conflict:
            for d in deletes:
                if d["id"] not in old:
                    self.files.remove(d["id"])
            raise

    def _delete(self, keys: DataFrame) -> dict[str, Any] | None:
        """Writes which live documents have these keys, and what the statistics lose with them."""
        name = f"deletes-{uuid.uuid4().hex}"
        hit = self._live("docs").select("doc_key", "segment").join(keys, "doc_key", "left_semi")
        hit.write.parquet(self._path(name, "keys"))
        hit = self.spark.read.parquet(self._path(name, "keys"))
        per = {r["segment"]: r["n"] for r in hit.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not per:
            self.files.remove(name)
            return None
        few = F.broadcast(hit) if sum(per.values()) <= BROADCAST_KEYS else hit
        lost = self._table("packed", list(per)).join(few, ["doc_key", "segment"], "left_semi")
        lost.groupBy("segment", "field").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(self._path(name, "field_stats"))
        term_counts(lost).write.parquet(self._path(name, "term_stats"))
        return {"id": name, "docs": per}

    def delete(self, keys: DataFrame) -> None:
        """Hides the documents with these doc_keys."""

        def change() -> None:
            gone = self._delete(keys.select("doc_key").distinct()) if self.manifest["segments"] else None
            if gone:
                self._commit_with([*self.manifest["deletes"], gone])

        self._retry(change)

    # reading

    def _table(self, name: str, segments: list[str] | None = None) -> DataFrame | None:
        """A table of segments (all by default), without fields that were removed after them."""
        ids = [s["id"] for s in self.manifest["segments"]] if segments is None else segments
        if not ids:
            return None
        table = self._read(name, ids)
        for field, gone in self.manifest["removed"].items():
            old = [s for s in gone["segments"] if s in ids]
            if old and name == "docs":
                table = table.withColumn(field, F.when(~F.col("segment").isin(old), F.col(field))) if field in table.columns and field in self.mapping.fields else table.drop(field)
            elif old:
                table = table.where(~((F.col("field") == field) & F.col("segment").isin(old)))
        return table

    def _read(self, name: str, ids: list[str]) -> DataFrame:
        """A table of segments as it is; segments that were written with vectors and single postings are read as those."""
        if name == "term_stats":
            return self._counts(ids)
        read = lambda name, ids: self.spark.read.option("mergeSchema", str(name == "docs").lower()).parquet(*[self._path(s, name) for s in ids])
        now, before = {"packed": ("packed", "vectors"), "postings": ("blocks", "postings")}.get(name, (name, name))
        old = [s for s in ids if now != before and not self.files.exists(f"{s}/{now}")]
        own = [s for s in ids if s not in old]
        found = [spread_blocks(read(now, own)) if name == "postings" else read(now, own)] if own else []
        if old:
            found.append(read(before, old) if name == "postings" else pack(read(before, old)))
        return reduce(DataFrame.unionByName, found)

    def _counts(self, ids: list[str]) -> DataFrame:
        """(segment, field, term, df) in rows that add up to the documents by term: one for each block, or what segments of earlier forms have."""
        forms = {"blocks": F.col("n").cast("bigint"), "term_stats": F.col("df"), "postings": F.lit(1).cast("bigint")}
        having: dict[str, list[str]] = {}
        for s in ids:
            having.setdefault(next(t for t in forms if self.files.exists(f"{s}/{t}")), []).append(s)
        each = [self.spark.read.parquet(*[self._path(s, t) for s in own]).select("segment", "field", "term", forms[t].alias("df")) for t, own in having.items()]
        return reduce(DataFrame.unionByName, each)

    def _gone(self, table: str, segments: list[str] | None = None) -> DataFrame | None:
        """A table of the deletes that concern segments."""
        ids = {s["id"] for s in self.manifest["segments"]} if segments is None else set(segments)
        names = [d["id"] for d in self.manifest["deletes"] if ids & set(d["docs"])]
        if not names:
            return None
        return self.spark.read.parquet(*[self._path(n, table) for n in names]).where(F.col("segment").isin(sorted(ids)))

    def _live(self, name: str, segments: list[str] | None = None) -> DataFrame | None:
        table, gone = self._table(name, segments), self._gone("keys", segments)
        if table is None or gone is None:
            return table
        known = sum(n for d in self.manifest["deletes"] for n in d["docs"].values())
        return table.join(F.broadcast(gone) if known <= BROADCAST_KEYS else gone, ["doc_key", "segment"], "left_anti")

    def _stats(self, segments: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(field_stats, term_stats) of live documents: the segments' summed, less what deletes took from them."""
        out = []
        for table, by, counts in (("field_stats", ["field"], ["n_docs", "n_tokens"]), ("term_stats", ["field", "term"], ["df"])):
            own, gone = self._table(table, segments), self._gone(table, segments)
            own = own.select(*by, *counts)
            if gone is not None:
                own = own.unionByName(gone.select(*by, *[(-F.col(c)).alias(c) for c in counts]))
            out.append(own.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts]).where(F.col(counts[0]) > 0))
        return out[0], out[1]

    def index(self) -> Index:
        """The live documents as an Index: a snapshot, as segments don't change and stay for a time after a merge."""
        self.reload()
        docs = self._live("docs")
        if docs is None:
            empty = self.spark.createDataFrame
            stored = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.mapping.schema() if f.name in self.mapping.fields and self.mapping.fields[f.name].stored)
            docs = empty([], "doc_key string" + (", " + stored if stored else ""))
            return Index(docs, empty([], "doc_key string, field string, n_tokens bigint"), empty([], "field string, term binary, doc_key string, tf int, len_code int"), self.mapping, self.settings)
        packed = self._live("packed").drop("segment")
        out = Index(docs.drop("segment"), lengths_of(packed), self._live("postings").drop("segment"), self.mapping, self.settings, unpack(packed), packed)
        out.__dict__["field_stats"], out.__dict__["term_stats"] = self._stats()
        return out

    def segment_stats(self) -> DataFrame:
        """(segment, total_docs, deleted_docs), from what the manifest counts."""
        self.reload()
        gone: dict[str, int] = {}
        for d in self.manifest["deletes"]:
            for s, n in d["docs"].items():
                gone[s] = gone.get(s, 0) + n
        rows = [(s["number"], s["docs"], gone.get(s["id"], 0)) for s in self.manifest["segments"]]
        return self.spark.createDataFrame(rows, "segment bigint, total_docs bigint, deleted_docs bigint")

    # maintenance

    def merge(self, segments: list[str]) -> None:
        """One segment of the live documents of these; their tables stay for readers until purge().

        Vectors are copied and their postings sorted anew, not analysed again.
        """

        def touching() -> list[str]:
            return [d["id"] for d in self.manifest["deletes"] if set(segments) & set(d["docs"])]

        while True:
            self.reload()
            if not set(segments) <= {s["id"] for s in self.manifest["segments"]} or not segments:
                return
            base = touching()
            made, rows = self._write(self._live("docs", segments), self._live("packed", segments))
            while True:
                self.reload()
                if touching() != base or not set(segments) <= {s["id"] for s in self.manifest["segments"]}:
                    self.files.remove(made)  # others deleted from these segments, or merged them
                    break
                left = [s for s in self.manifest["segments"] if s["id"] not in segments]
                ids = {s["id"] for s in left}
                deletes = [d | {"docs": {s: n for s, n in d["docs"].items() if s in ids}} for d in self.manifest["deletes"]]
                retired = [*segments, *[d["id"] for d in deletes if not d["docs"]]]
                removed = {f: r | {"segments": [s for s in r["segments"] if s in ids]} for f, r in self.manifest["removed"].items()}
                number = self.manifest["next"]
                try:
                    self._commit(segments=[*left, {"id": made, "number": number, "docs": rows}], deletes=[d for d in deletes if d["docs"]], removed={f: r for f, r in removed.items() if r["segments"]}, retired=[*self.manifest["retired"], *[{"name": n, "at": time.time()} for n in retired]], next=number + 1)
                    return
                except Conflict:
                    continue

    def optimize(self) -> None:
        """One segment of all live documents."""
        self.reload()
        self.merge([s["id"] for s in self.manifest["segments"]])

    def due(self, least: int = 3) -> list[str]:
        """The segments of the tier, by powers of ten of their documents, that has most of them, if these are so many."""
        tiers: dict[int, list[str]] = {}
        for s in self.manifest["segments"]:
            tiers.setdefault(len(str(max(s["docs"], 1))), []).append(s["id"])
        most = max(tiers.values(), key=len, default=[])
        return most if len(most) >= least else []

    def purge(self, older: float = GRACE_SECONDS) -> None:
        """Removes tables that merges replaced so many seconds ago, and all but the latest manifests."""

        def change() -> None:
            gone = [r for r in self.manifest["retired"] if r["at"] <= time.time() - older]
            if gone:
                self._commit(retired=[r for r in self.manifest["retired"] if r not in gone])
            for r in gone:
                self.files.remove(r["name"])
            for n in _numbers(self.files)[:-KEPT_MANIFESTS]:
                self.files.remove(_name(n))

        self._retry(change)


def _name(number: int) -> str:
    return f"manifest-{number:012d}.json"


def _numbers(files: Files) -> list[int]:
    return sorted(int(n[9:21]) for n in files.names() if n.startswith("manifest-") and n.endswith(".json"))
