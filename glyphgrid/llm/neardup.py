"""Near-duplicate pairs and groups: MinHash signatures under a multi-index Hamming join.

A text's signature has K positions of 16 bits (b-bit MinHash of its word
trigrams, b = 16).  Documents of one signature are a class; two classes are linked
when their signatures differ in at most RADIUS positions.  The positions are split
into CHUNKS chunks, each allowed ERRORS differing positions: a pair within
RADIUS < CHUNKS * (ERRORS + 1) has a chunk with at most ERRORS, so both share a key
made of that chunk with those positions masked.  All masks are enumerated, so no
pair is missed.  A pair counts in the bucket of the first key that it shares, so
each is found once and nothing need be made distinct.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrid.llm.common import cut, per_slice, runs
from glyphgrid.llm.wordhash import _BASE, _MIX1, _MIX2, mix, ngrams, word_hashes

K, RADIUS, CHUNKS, ERRORS, SHINGLE = 64, 26, 14, 1, 3
#: So many ids of documents to drop, 16 bytes each in memory, are broadcast at most; more meet the texts in a shuffle.
BROADCAST_IDS = 1_000_000
#: A bucket of more members is split into tiles of about so many, whose pairs are compared in tasks of their own.
TILE = 4096
_AT = np.uint64(63)
_SEEDS = mix(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BLANK = np.uint64(0xD6E8FEB86659FD93)
#: What signatures() calls visible: a character other than ASCII white space.
VISIBLE = r"[^\t-\r\x1c-\x20]"


def signatures(texts: list[str | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(rows, K) positions, and which rows have one: those with a visible character.

    Words are compared in lower case without punctuation; a text that has no
    word but is not blank stands for itself as one shingle.
    """
    out, there = np.zeros((len(texts), K), np.uint16), np.zeros(len(texts), bool)
    low = [t.lower() if t else "" for t in texts]
    for first, offsets, h in word_hashes(low):
        grams, to = ngrams(h, offsets, shingle)
        full = np.flatnonzero(np.diff(to))
        if len(full):
            at = to[full]
            for k in range(K):
                least = np.minimum.reduceat((grams ^ _SEEDS[k]) * (_SEEDS[k] | np.uint64(1)), at)
                out[first + full, k] = mix(least) >> np.uint64(48)
            there[first + full] = True
    bare = [i for i, t in enumerate(low) if not there[i] and t.strip()]
    if bare:
        for first, _, h in word_hashes(["x" + low[i].strip().encode("utf-8", "replace").hex() for i in bare]):
            for j, x in enumerate(h):
                out[bare[first + j]] = mix(_SEEDS ^ x ^ _BLANK) >> np.uint64(48)
                there[bare[first + j]] = True
    return out, there


def chunks(k: int = K, parts: int = CHUNKS) -> list[np.ndarray]:
    return np.array_split(np.arange(k), parts)


def masked_keys(sigs: np.ndarray, parts: int = CHUNKS, errors: int = ERRORS) -> np.ndarray:
    """(rows, keys): a key for each chunk and each choice of `errors` masked positions in it; its low 6 bits tell its column."""
    keys = []
    for chunk in chunks(sigs.shape[1], parts):
        for masked in combinations(range(len(chunk)), min(errors, len(chunk) - 1)):
            x = np.full(len(sigs), mix(np.array([len(keys) + 1], np.uint64))[0], np.uint64)
            for i, p in enumerate(chunk):
                if i not in masked:
                    x = mix((x ^ sigs[:, p].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
            keys.append((x & ~_AT) | np.uint64(len(keys)))
    assert len(keys) <= 64
    return np.stack(keys, 1)


def components(sigs: np.ndarray, radius: int) -> np.ndarray:
    """For each row the first row of its component in the graph of pairs within radius.

    Breadth-first, each row compared only with rows not yet reached: all pairs
    are decided, while a tight group of n costs about n comparisons.
    """
    root = np.full(len(sigs), -1)
    rest = np.arange(len(sigs))
    while len(rest):
        start = rest[0]
        root[start], rest, frontier = start, rest[1:], [start]
        while frontier and len(rest):
            i = frontier.pop()
            near = (sigs[rest] != sigs[i]).sum(1) <= radius
            if near.any():
                root[rest[near]] = start
                frontier.extend(rest[near])
                rest = rest[~near]
    return root


def near_pairs(sigs: np.ndarray, starts: np.ndarray, sides: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (i, j, distance) of the pairs within radius inside each bucket of rows, i before j.

    Buckets are the rows between starts.  Where a bucket's sides are 1 and 2 only
    pairs across count.
    """
    ends = np.append(starts[1:], len(sigs))
    size = ends - starts
    for s in np.unique(size[(size > 1) & (size <= 32)]):
        # small buckets of one size are compared all at once
        i, j = np.triu_indices(s, 1)
        at = starts[size == s]
        for part in np.array_split(at, max(1, len(at) * len(i) // 100_000)):
            a, b = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
            d = (sigs[a] != sigs[b]).sum(1)
            ok = (d <= radius) & ((sides[a] == 0) | (sides[a] != sides[b]))
            yield a[ok], b[ok], d[ok]
    for s, e in zip(starts[size > 32], ends[size > 32]):
        strip = max(1, (1 << 22) // ((e - s) * sigs.shape[1]))
        for at in range(s, e, strip):
            to = min(e, at + strip)
            d = np.zeros((to - at, e - at), np.uint8)
            for k in range(sigs.shape[1]):
                d += sigs[at:to, k, None] != sigs[None, at:e, k]
            a, b = np.nonzero(d <= radius)
            ok = (b > a) & ((sides[at + a] == 0) | (sides[at + a] != sides[at + b]))
            a, b = a[ok], b[ok]
            yield a + at, b + at, d[a, b].astype(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, node, sig) for rows with a doc_id and a text that is not blank; node tells signatures apart in 64 bits."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sigs, there = signatures(b.column("text").to_pylist())
        out = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.tobytes() for x in sigs], pa.binary())], names=["doc_id", "sig"])
        return out.filter(pa.array(there))

    own = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return own.mapInArrow(per_slice(run), "doc_id bigint, sig binary").select("doc_id", F.xxhash64("sig").alias("node"), "sig")


def classes(signed: DataFrame) -> DataFrame:
    """(node, sig, rep, far, n_rows): a row for each signature, with its least and greatest doc_id."""
    return signed.groupBy("node", "sig").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("far"), F.count(F.lit(1)).alias("n_rows"))


def _sig_matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, K)


def _keyed(nodes: DataFrame) -> DataFrame:
    def explode(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = masked_keys(_sig_matrix(b))
        node = np.repeat(b.column("node").to_numpy(), keys.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], names=["key", "node"])

    return nodes.select("sig", "node").mapInArrow(per_slice(explode, 4000), "key bigint, node bigint")


def buckets(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """(bucket, at, side, node): who shares a key with whom, buckets of one membership once, under their first key.

    A key of more than tile members comes out as pairs of tiles: members of the
    same tile have side 0, those of two tiles 1 and 2.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "at", "node"]
        for b in runs(batches, "key", tile):
            if isinstance(b, int):  # the key of a hot run, whose members aren't held here
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([-1], pa.int32()), pa.array([None], pa.int64())], names=names)
                continue
            key, node = b.column("key").to_numpy(), b.column("node").to_numpy()
            starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
            size = np.diff(np.append(starts, len(key)))
            # a bucket is named by its members, so that equal ones fall together below
            name = np.add.reduceat(mix(node.view(np.uint64)), starts)
            many = np.repeat(size > 1, size)
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mix(name), size)[many].view(np.int64)), pa.array((key[many] & 63).astype(np.int32)), pa.array(node[many])], names=names)

    keyed = _keyed(nodes)
    found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(shared, "bucket bigint, at int, node bigint")
    found = cut(found.groupBy("bucket", "node").agg(F.min("at").alias("at")))
    whole = found.where("node IS NOT NULL").select("bucket", "at", F.lit(0).alias("side"), "node")
    hot = found.where("node IS NULL").select(F.col("bucket").alias("key"))
    count = hot.count()
    if not count:
        return whole
    hot = F.broadcast(hot) if count <= BROADCAST_IDS else hot
    own = cut(keyed.join(hot, "key"))
    sizes = own.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("bigint").alias("tiles"))
    sizes = F.broadcast(sizes) if count <= BROADCAST_IDS else sizes
    placed = own.join(sizes, "key").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
    lo, hi = F.least("tile", "other"), F.greatest("tile", "other")
    side = F.when(F.col("tile") == F.col("other"), 0).when(F.col("tile") < F.col("other"), 1).otherwise(2)
    return whole.unionByName(met.select(F.xxhash64("key", lo, hi).alias("bucket"), F.col("key").bitwiseAND(F.lit(63)).cast("int").alias("at"), side.alias("side"), "node"))


def _linked(nodes: DataFrame, radius: int, tile: int, what: str) -> DataFrame:
    """What is found of pairs within radius.

    pairs: (a, b, distance), each once, a < b, by rep.  edges: (a, b), enough of them to connect all
    pairs.  links: those edges and, where b is null, how many pairs the class a has in a bucket.
    """
    assert radius < CHUNKS * (ERRORS + 1)
    members = buckets(nodes, tile).join(nodes.select("node", "sig", "rep"), "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, "bucket"):
            bucket, node, rep, at, sides = (b.column(c).to_numpy() for c in ("bucket", "node", "rep", "at", "side"))
            sigs = _sig_matrix(b)
            starts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if what != "pairs":
                root = np.concatenate([s + components(sigs[s:e], radius) for s, e in zip(starts, np.append(starts[1:], len(bucket)))])
                off = np.flatnonzero(root != np.arange(len(root)))
                out.append((rep[root[off]], rep[off], np.zeros(len(off), np.int64)))
            if what != "edges":
                keys, tally = masked_keys(sigs), np.zeros(len(bucket), np.int64)
                for i, j, d in near_pairs(sigs, starts, sides, radius):
                    for part in np.array_split(np.arange(len(i)), max(1, len(i) // 50_000)):
                        x, y = i[part], j[part]
                        here = np.argmax(keys[x] == keys[y], 1) == at[x]
                        x, y = x[here], y[here]
                        if what == "pairs":
                            out.append((rep[x], rep[y], d[part][here]))
                        else:
                            tally += np.bincount(x, minlength=len(tally)) + np.bincount(y, minlength=len(tally))
                if what == "links":
                    some = np.flatnonzero(tally)
                    yield _rows(node[some], None, tally[some])
            for x, y, d in out:
                yield _rows(np.minimum(x, y), np.maximum(x, y), d)

    return members.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(link, "a bigint, b bigint, n bigint")


def _rows(a: np.ndarray, b: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), pa.array(n.astype(np.int64))], names=["a", "b", "n"])


def pairs(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b, distance): every pair of classes whose signatures differ in at most radius positions, once.

    a and b are the least doc_ids of the two classes, a <= b (equal only where one
    doc_id has both texts).  Documents of one class have distance 0 and aren't
    listed; classes() tells who is in which.  Null and blank texts and null
    doc_ids have no class; an empty table gives no pairs.
    """
    nodes = cut(classes(cut(sign(docs))))
    return _linked(nodes, radius, tile, "pairs").withColumnRenamed("n", "distance")


def connected(pairs: DataFrame) -> DataFrame:
    """(node, root) for the nodes of pairs (a, b); root is the least node of the component.

    Alternating large-star and small-star steps (Kiveris et al. 2014) until the
    edges stay the same; each round is written to the checkpoint folder.
    """
    now = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        now = cut(small.distinct())
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, class_id, group_id, n_rows, n_links, keep) for every document that has a near copy.

    class_id is the least doc_id with the document's signature, n_rows how many
    rows have that signature, n_links how many other classes are within radius of
    it.  group_id is the least doc_id of all documents joined by chains of links;
    keep is true for that one alone.  Documents without a near copy do not appear,
    nor do rows with a null doc_id or a null or blank text.  Rows that repeat a
    doc_id count as one document, with the least class_id and the sums over the
    classes of its texts.  Texts are signed whole; columns but doc_id and text
    are ignored.
    """
    return _groups(cut(sign(docs)), radius, tile, True)


def _groups(signed: DataFrame, radius: int, tile: int, counted: bool) -> DataFrame:
    nodes = cut(classes(signed))
    found = cut(_linked(nodes, radius, tile, "links" if counted else "edges"))
    near = found.where("b IS NOT NULL").select("a", "b")
    if counted:
        per = nodes.select("node", "rep", "far", "n_rows").join(found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links")), "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
        per = per.where("rep <> far OR n_links > 0")
    else:
        linked = near.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        own = nodes.select("node", "rep", "far", F.lit(0).alias("n_rows"), F.lit(0).alias("n_links"))
        per = own.where("rep <> far").unionByName(own.where("rep = far").join(linked, "rep", "left_semi"))
    inside = signed.select("doc_id", "node").join(per, "node").groupBy("doc_id", "node").agg(*[F.first(c).alias(c) for c in ("rep", "n_rows", "n_links")])
    by_doc = cut(inside.groupBy("doc_id").agg(F.min("rep").alias("class_id"), F.max("rep").alias("last"), F.sum("n_rows").alias("n_rows"), F.sum("n_links").alias("n_links")))
    # documents with texts of several classes join these
    several = by_doc.where("class_id <> last").select("doc_id", F.col("class_id").alias("a"))
    if not several.isEmpty():
        near = near.unionByName(inside.select("doc_id", F.col("rep").alias("b")).join(several, "doc_id").select("a", "b").where("a <> b"))
    root = connected(near)
    out = by_doc.join(root, by_doc["class_id"] == root["node"], "left").withColumn("group_id", F.coalesce("root", "class_id"))
    return out.select("doc_id", "class_id", "group_id", "n_rows", "n_links", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def drop_near(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """docs without the near copies: of each group the document of least doc_id stays.

    Rows without a doc_id or with a null or blank text stay as they are, also
    where their doc_id is dropped.  Of rows that repeat a doc_id that stays, with
    visible texts, one stays: that of least text, then least by the other columns
    that have an order.
    """
    signed = cut(sign(docs))
    gone = cut(_groups(signed, radius, tile, False).where(~F.col("keep")).select("doc_id").distinct())
    twice = cut(signed.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    name, seen = "_glyphgrid_doc_id", F.col("text").rlike(VISIBLE)
    key = F.col("doc_id").cast("bigint")
    repeated = not twice.isEmpty()
    out = (gone.unionByName(twice).distinct() if repeated else gone).withColumnRenamed("doc_id", name)
    small = out.count() <= BROADCAST_IDS
    once = docs.join(F.broadcast(out) if small else out, (key == out[name]) & seen, "left_anti")
    if not repeated:
        return once
    again = twice.join(gone, "doc_id", "left_anti").withColumnRenamed("doc_id", name)
    shown = docs.where(seen).join(F.broadcast(again) if small else again, key == again[name], "left_semi")
    ordered = [F.col("text"), *[F.col(f"`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and kind != "variant"]]
    first = shown.groupBy(key.alias(name)).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(*ordered)).alias("_glyphgrid_row"))
    return once.unionByName(first.select("_glyphgrid_row.*"))


def sql(what: str = "groups", radius: int = RADIUS) -> str:
    """groups() or pairs() in DuckDB SQL over the view documents: signatures from the texts, all pairs of them, and their closure."""
    mask, base = "18446744073709551615::UHUGEINT", f"{int(_BASE)}::UHUGEINT"
    mul = lambda x, y: f"CAST((({x})::UHUGEINT * {y}::UHUGEINT) & {mask} AS UBIGINT)"
    mixed = lambda x, n: f"{x} AS {n}0, xor({n}0, {n}0 >> 30) AS {n}1, {mul(f'{n}1', int(_MIX1))} AS {n}2, xor({n}2, {n}2 >> 27) AS {n}3, {mul(f'{n}3', int(_MIX2))} AS {n}4, xor({n}4, {n}4 >> 31) AS {n}"
    horner = lambda values, start: f"CAST(list_reduce({values}, lambda x, y: (x * {base} + y) & {mask}, {start}) AS UBIGINT)"
    coded = "list_reverse(list_transform(range(0, length(code) // 2), lambda i: (CAST('0x' || substr(code, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) + 1)::UHUGEINT))"
    seeds = ", ".join(f"({k}, {int(s)}::UBIGINT)" for k, s in enumerate(_SEEDS))
    step = f"(x * {base} + y) & {mask}"
    result = "SELECT doc_id, class_id, group_id, n_rows, n_links, doc_id = group_id AS keep FROM doc JOIN grouped USING (doc_id)"
    if what == "pairs":
        result = "SELECT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, distance FROM pair JOIN (SELECT DISTINCT one, rep FROM inside) x ON x.one = a JOIN (SELECT DISTINCT one, rep FROM inside) y ON y.one = b"
    return f"""
WITH RECURSIVE seed(k, s) AS (VALUES {seeds}),
d AS MATERIALIZED (SELECT row_number() OVER () AS row_, doc_id, lower(text) AS low, regexp_extract_all(low, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') AS found, regexp_replace(low, '^\\s+|\\s+$', '', 'g') AS bare FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
own AS MATERIALIZED (SELECT row_, doc_id, len(found) > 0 AS plain, CASE WHEN len(found) > 0 THEN found ELSE ['x' || lower(hex(encode(bare)))] END AS found FROM d WHERE len(found) > 0 OR bare <> ''),
w AS MATERIALIZED (SELECT row_, plain, len(found) AS n, unnest(found) AS word, generate_subscripts(found, 1) AS i FROM own),
h AS MATERIALIZED (SELECT word, {mixed(horner(coded, "0::UHUGEINT"), "h")} FROM (SELECT word, hex(encode(word)) AS code FROM (SELECT DISTINCT word FROM w))),
t AS MATERIALIZED (SELECT row_, plain, n, i, h FROM w JOIN h USING (word)),
g0 AS (SELECT row_, CAST(({base} * (({base} * h + lead(h) OVER o) & {mask}) + lead(h, 2) OVER o) & {mask} AS UBIGINT) AS x, i + {SHINGLE - 1} <= n AS whole FROM t WHERE plain AND n >= {SHINGLE} WINDOW o AS (PARTITION BY row_ ORDER BY i)),
g1 AS (SELECT row_, x FROM g0 WHERE whole UNION ALL SELECT row_, CAST(list_reduce(list(h::UHUGEINT ORDER BY i), lambda x, y: {step}, any_value(n)::UHUGEINT) AS UBIGINT) FROM t WHERE plain AND n < {SHINGLE} GROUP BY row_),
g AS MATERIALIZED (SELECT DISTINCT row_, m FROM (SELECT row_, {mixed("x", "m")} FROM g1)),
least AS (SELECT row_, k, min({mul("xor(m, s)", "(s | 1::UBIGINT)")}) AS x FROM g, seed GROUP BY row_, k),
sig AS MATERIALIZED (SELECT row_, k, m >> 48 AS v FROM (SELECT row_, k, {mixed("x", "m")} FROM (SELECT row_, k, x FROM least UNION ALL SELECT row_, k, xor(xor(s, h), {int(_BLANK)}::UBIGINT) FROM t, seed WHERE NOT plain))),
text_ AS (SELECT row_, string_agg(v, ',' ORDER BY k) AS sig FROM sig GROUP BY row_),
inside AS MATERIALIZED (SELECT DISTINCT doc_id, sig, count(*) OVER (PARTITION BY sig) AS n_rows, min(doc_id) OVER (PARTITION BY sig) AS rep, max(doc_id) OVER (PARTITION BY sig) AS far, min(row_) OVER (PARTITION BY sig) AS one FROM text_ JOIN own USING (row_)),
p AS MATERIALIZED (SELECT c.one, k, v FROM (SELECT DISTINCT one FROM inside) c JOIN sig ON sig.row_ = c.one),
pair AS MATERIALIZED (SELECT a.one AS a, b.one AS b, {K} - count(*) AS distance FROM p a JOIN p b ON a.k = b.k AND a.v = b.v AND a.one < b.one GROUP BY a.one, b.one HAVING {K} - count(*) <= {radius}),
link AS (SELECT one, count(*) AS n FROM (SELECT a AS one FROM pair UNION ALL SELECT b FROM pair) GROUP BY one),
doc AS MATERIALIZED (SELECT doc_id, min(rep) AS class_id, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_links FROM inside LEFT JOIN link USING (one) WHERE rep <> far OR n > 0 GROUP BY doc_id),
edge AS MATERIALIZED (SELECT a, b FROM pair UNION SELECT b, a FROM pair UNION SELECT x.one, y.one FROM inside x JOIN inside y ON x.doc_id = y.doc_id AND x.one <> y.one),
reach AS (SELECT a AS one, a AS other FROM edge UNION SELECT reach.one, edge.b FROM reach JOIN edge ON edge.a = reach.other),
root AS (SELECT r.one, min(i.rep) AS root FROM reach r JOIN inside i ON i.one = r.other GROUP BY r.one),
grouped AS (SELECT doc_id, min(coalesce(root, rep)) AS group_id FROM inside LEFT JOIN root USING (one) GROUP BY doc_id)
{result}"""
