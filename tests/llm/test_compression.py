from collections import Counter

import zstandard

from glyphgrid.llm import compression


def brute_dictionary(texts, size):
    counts = Counter(w for t in texts if t for w in __import__("re").split("[ \t\n\r\f]+", t) if w)
    out, room = [], size
    for w in sorted(counts, key=lambda w: (-counts[w] * (len(w.encode()) + 1), w.encode())):
        b = w.encode() + b" "
        if len(b) <= size:
            if len(b) > room:
                break
            out.append(b)
            room -= len(b)
    return b"".join(reversed(out))


def test_scores_are_those_of_plain_compression(spark, edge, edge_rows, empty):
    domain = spark.createDataFrame([("the cat sat on the mat w1 w2 w3",), (None,), ("",), ("the the cat",)], "text string")
    mine, general = brute_dictionary([r["text"] for r in domain.collect()], 1 << 12), brute_dictionary([t for _, t, _ in edge_rows], 1 << 12)
    assert compression.dictionary(domain, 1 << 12) == mine
    assert compression.dictionary(edge, 1 << 12) == general

    def size(raw, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw))

    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["in_domain_bytes"], r["general_bytes"], round(r["score"], 9)) for r in compression.cross_entropy(edge, domain, 1 << 12).collect()))
    want = []
    for i, t, _ in edge_rows:
        raw = (t or "").encode()
        a, b = size(raw, mine), size(raw, general)
        want.append((i is not None, i or 0, len(raw), a, b, round((b - a) / (a + b), 9) if raw else 0.0))
    assert got == sorted(want)
    assert compression.cross_entropy(empty, domain).count() == 0
    assert compression.cross_entropy(edge, domain.limit(0)).count() == len(edge_rows)


def test_in_domain_texts_score_higher(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{'chat' if i % 2 else 'news'}{(i * 7 + j * j) % 90}" for j in range(60))) for i in range(60)], "doc_id bigint, text string")
    domain = docs.where("doc_id % 2 = 1").select("text")
    # the general dictionary has room for half of either vocabulary
    rows = compression.cross_entropy(docs, domain, 640).collect()
    mean = lambda odd: sum(r["score"] for r in rows if r["doc_id"] % 2 == odd) / 30
    assert mean(1) > mean(0) + 0.01


def test_dictionaries_grow_with_the_corpora(spark, monkeypatch):
    monkeypatch.setattr(compression, "DICTIONARY_BYTES", 64)
    monkeypatch.setattr(compression, "SHARE", 4)
    held = []
    monkeypatch.setattr(compression, "score", lambda docs, own, general, level: held.append((own, general)) or docs)
    domain = spark.createDataFrame([(" ".join(f"chat{i}" for i in range(100)),)], "text string")
    for n in (100, 1000):
        docs = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(n)))], "doc_id bigint, text string")
        compression.cross_entropy(docs, domain)
        size = sum(len(w) + 1 for w in [f"chat{i}" for i in range(100)] + [f"word{i}" for i in range(n)]) // 4
        assert held[-1] == (brute_dictionary([domain.first()["text"]], size), brute_dictionary([docs.first()["text"]], size))
    assert len(held[1][1]) > 5 * len(held[0][1])
    compression.cross_entropy(domain.limit(0).selectExpr("1L AS doc_id", "text"), domain.limit(0))
    assert held[-1] == (b"", b"")


def test_a_large_dictionary_is_reached_to_its_far_end():
    words = [f"{(i * 2654435761) % 2**32:08x}{(i * 40503 + 7) % 65536:04x}".encode() for i in range(100_000)]
    content = b" ".join(words)
    near, far, other = b" ".join(words[-999::3]), b" ".join(words[:999:3]), b" ".join(w[::-1] for w in words[:999:3])
    cost = [len(compression.compressor(content).compress(x)) for x in (near, far, other)]
    assert cost[0] < 0.8 * cost[2] and cost[1] < 0.8 * cost[2]
