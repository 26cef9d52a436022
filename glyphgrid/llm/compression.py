"""Language-model scoring by compression: zstandard sizes under two dictionaries.

A dictionary holds the words that save most in a corpus, the best last, where
references are cheapest.  Both are of one size, which grows with the corpora
(fitting()).  What a text's bytes cost under the general dictionary
less what they cost under the in-domain one, over their sum, is its score:
positive where the text is more like the domain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrid.llm.common import cut, per_slice

#: The least size of a dictionary, and the part of both corpora's words that it has above that.
DICTIONARY_BYTES, SHARE, LEVEL = 1 << 17, 1024, 3


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the whole of column text; words are what lies between ASCII white space."""
    words = texts.where(F.col("text").isNotNull()).select(F.explode(F.split("text", "[ \\t\\n\\r\\f]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def fitting(*counted: DataFrame) -> int:
    """The size of dictionaries of all these word_counts(): a fixed share of their bytes, so that it grows as they do."""
    total = sum(c.agg(F.sum(F.col("n") * (F.octet_length("word") + 1))).first()[0] or 0 for c in counted)
    return max(DICTIONARY_BYTES, total // SHARE)


def dictionary(texts: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """The words of greatest count times length (ties: the lesser word), as many as fit in size bytes, from all rows."""
    return filled(cut(word_counts(texts)), size)


def filled(counted: DataFrame, size: int) -> bytes:
    """dictionary() of word counts.

    Words come to the driver only down to the saving at which size bytes are
    reached, which a histogram of savings tells, and as Arrow batches.  Without
    words the dictionary is empty.
    """
    width = F.octet_length("word") + 1
    saving = F.col("n") * width
    counted = counted.where(width <= size)
    step = F.floor(F.log2(saving) * 64).cast("int")
    room, least = size, None
    # a row for each step of about 1 % in saving, some thousands at most
    for row in counted.groupBy(step.alias("step")).agg(F.sum(width).alias("bytes")).orderBy(F.desc("step")).collect():
        least, room = row["step"], room - row["bytes"]
        if room <= 0:
            break
    if least is None:
        return b""
    top = counted.where(step >= least).select("word", saving.alias("saving")).orderBy(F.desc("saving"), "word").select(F.col("word").cast("binary").alias("word"))
    chosen, room = [], size
    for batch in top.toArrow().to_batches():
        for w in batch.column(0).to_pylist():
            if len(w) + 1 > room:
                return b"".join(reversed(chosen))
            chosen.append(w + b" ")
            room -= len(w) + 1
    return b"".join(reversed(chosen))


def compressor(content: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    frame = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
    if len(content) > 1 << 17:
        # a level's own window and tables reach no further back than some 100 KB of a dictionary
        bits = (len(content) - 1).bit_length()
        wide = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(content), window_log=min(bits + 1, 30), hash_log=min(max(bits - 1, 17), 28), chain_log=min(max(bits - 2, 16), 28), **frame)
        held.precompute_compress(compression_params=wide)
        return zstandard.ZstdCompressor(compression_params=wide, dict_data=held)
    if held:
        held.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=held, **frame)


def sizes(raw: list[bytes], by: zstandard.ZstdCompressor) -> np.ndarray:
    return np.fromiter((len(by.compress(x)) for x in raw), np.int64, len(raw))


def score(docs: DataFrame, in_domain: bytes, general: bytes, level: int = LEVEL) -> DataFrame:
    """(doc_id, n_bytes, in_domain_bytes, general_bytes, score) for every row of docs.

    Texts are compressed whole.  A null text counts as an empty one; an empty
    text scores 0.  Repeated rows are scored repeatedly, a null doc_id is carried
    along and other columns are ignored.
    """
    # two dictionaries, a small share of the corpora
    held = docs.sparkSession.sparkContext.broadcast((in_domain, general))
    made: list[zstandard.ZstdCompressor] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.extend(compressor(x, level) for x in held.value)
        raw = [(t or "").encode("utf-8", "replace") for t in b.column("text").to_pylist()]
        own, other = (sizes(raw, by) for by in made)
        n = np.array([len(x) for x in raw], np.int64)
        got = np.where(n > 0, (other - own) / np.maximum(other + own, 1), 0.0)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x) for x in (n, own, other, got))], names=["doc_id", "n_bytes", "in_domain_bytes", "general_bytes", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(per_slice(run), "doc_id bigint, n_bytes bigint, in_domain_bytes bigint, general_bytes bigint, score double")


def cross_entropy(docs: DataFrame, domain: DataFrame, size: int | None = None, level: int = LEVEL) -> DataFrame:
    """score() of docs with dictionaries from all texts of domain and of docs; without a size, of the one fitting() both."""
    own, general = (cut(word_counts(x)) for x in (domain, docs))
    size = size or fitting(own, general)
    return score(docs, filled(own, size), filled(general, size), level)
