"""Vectorised word hashing over UTF-8 bytes, shared by the text operators.

A batch of texts is laid out as one byte array; word boundaries come from a
256-entry class table and every word's 64-bit polynomial hash from one prefix
sum, so no Python object is made per word.  Texts are taken whole: a long one
is hashed in pieces cut between words and the pieces are joined again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PIECE = 1 << 18
_POW: list[np.ndarray] = []

_BYTES = np.arange(256)
WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
SPACE = np.isin(_BYTES, [0, 9, 10, 11, 12, 13, 32])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        m = max(n, PIECE + 4096)
        up, down = np.full(m, _BASE, np.uint64), np.full(m, _INV, np.uint64)
        up[0] = down[0] = 1
        _POW[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POW[0], _POW[1]


def _hash_bytes(b: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the maximal runs of equal non-zero kind."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate(([0], change))
    ends = np.append(change, len(b))
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    up, down = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * down[starts])


def word_hashes(texts: Sequence[str | None], symbols: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first text, offsets, hashes) for consecutive groups of texts.

    ``hashes[offsets[i]:offsets[i + 1]]`` are the words of text ``first + i`` in
    order.  Words are runs of letters and digits; with ``symbols`` runs of other
    visible characters count too.  A null text has no words.
    """
    kinds = WORD.astype(np.uint8)
    if symbols:
        kinds = np.where(WORD, 1, np.where(SPACE, 0, 2)).astype(np.uint8)
    i = 0
    while i < len(texts):
        parts, size, j = [], 0, i
        while j < len(texts) and (j == i or size < PIECE):
            raw = (texts[j] or "").encode("utf-8", "replace")
            parts.append(raw)
            size += len(raw) + 1
            j += 1
            if size > PIECE and j - i > 1:  # the long one goes alone, next time
                parts.pop()
                j -= 1
                break
        if len(parts) == 1 and len(parts[0]) > PIECE:
            raw, at, found = parts[0], 0, []
            while at < len(raw):
                to = min(len(raw), at + PIECE)
                while to < len(raw) and not SPACE[raw[to]]:
                    to += 1
                b = np.frombuffer(raw, np.uint8, to - at, at)
                found.append(_hash_bytes(b, kinds[b])[1])
                at = to
            h = np.concatenate(found)
            yield i, np.array([0, len(h)]), h
        else:
            b = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
            starts, h = _hash_bytes(b, kinds[b])
            at = np.zeros(len(parts) + 1, np.int64)
            np.cumsum([len(p) + 1 for p in parts], out=at[1:])
            yield i, np.searchsorted(starts, at), h
        i = j


def ngrams(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word runs inside each text, and their offsets.

    A text with at least one but fewer than n words counts as a single run.
    """
    lens = np.diff(offsets)
    out = np.where(lens >= n, lens - n + 1, np.minimum(lens, 1))
    to = np.zeros(len(out) + 1, np.int64)
    np.cumsum(out, out=to[1:])
    if not to[-1]:
        return np.zeros(0, np.uint64), to
    acc = h.copy()
    for k in range(1, n):
        acc[: len(h) - k] = acc[: len(h) - k] * _BASE + h[k:]
    at = np.repeat(offsets[:-1] - to[:-1], out) + np.arange(to[-1])
    g = acc[at]
    for d in np.flatnonzero((lens > 0) & (lens < n)):
        v = np.uint64(lens[d])
        for x in h[offsets[d] : offsets[d + 1]]:
            v = np.uint64((int(v) * int(_BASE) + int(x)) & 0xFFFFFFFFFFFFFFFF)
        g[to[d]] = v
    return mix(g), to
