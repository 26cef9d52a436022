"""The words of a text by Unicode's default word boundaries (UAX #29), those with a letter or digit.

The rules are written as regular expressions over the classes of wordbreak.py; a
character's marks and format characters go with it.  Texts whose letters are Latin
and without combining marks, most of the bytes of many corpora, take a pattern of
their own that gives the same words faster, and split_all() finds the words of many
such texts at once, without a string for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from glyphgrid.functions import wordbreak as wb


def _set(ranges: str) -> str:
    return "".join("-".join(f"\\U{int(x, 16):08x}" for x in span.split("-")) for span in ranges.split())


_NEWLINE = r"\n\r\x0b\x0c\x85  "


def _below(ranges: str, top: int) -> str:
    return " ".join(r for r in ranges.split() if int(r.split("-")[-1], 16) <= top)


class _Rules:
    """The patterns over the characters up to a code point; beyond it there must be none in the text."""

    def __init__(self, top: int):
        l, h, n, x, k, e, alone, ea, ml, mn, mb = (_set(_below(r, top)) for r in (wb.LETTER, wb.HEBREW, wb.NUMERIC, wb.JOINER, wb.KATAKANA, wb.EXTEND, wb.ALONE, wb.EXTEND_ALNUM, wb.MID_LETTER, wb.MID_NUM, wb.MID_BOTH))
        a, ml, mn = l + h, ml + mb + "'", mn + mb + "'"

        def pattern(letters: str) -> re.Pattern:
            numbers = f"[{n}][{n}{e}]*(?:[{mn}][{e}]*[{n}][{n}{e}]*)*"
            core = f"(?:(?:{letters}|{numbers})+|[{k}][{k}{e}]*)"
            joined = f"[{x}][{x}{e}]*"
            # what has no class is a word by itself, and so is a mark of letter kind with whatever it hangs on
            rest = f"[{alone}][{e}]*|[^{_NEWLINE}][{e}]*?[{ea}][{e}]*|[{ea}][{e}]*"
            return re.compile(f"{core}(?:{joined}{core})*(?:{joined})?|{joined}(?:{core}(?:{joined})?)*|{rest}")

        self.general = pattern(f"[{a}][{a}{e}]*(?:[{ml}][{e}]*[{a}][{a}{e}]*)*")
        # within Hebrew a quote may end a word, and a double quote may stand between letters
        unit = f"(?:[{l}][{e}]*|[{h}][{e}]*(?:\"[{e}]*(?=[{h}])|'[{e}]*(?![{n}{x}]))?)"
        self.hebrew = pattern(f"{unit}+(?:[{ml}][{e}]*{unit}+)*")
        self.alnum = re.compile(f"[^\\W_]|[{alone}{ea}{_set(_below(wb.LETTER_ALNUM, top))}]")


_TOP = 0xFFFF
_BASIC = _Rules(_TOP)
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_HEBREW = re.compile(f"[{_set(wb.HEBREW)}]")


#: What a character is, as bits; a mark between two letters or two digits is three above these.
_L, _N, _JOINS, _ML, _MN, _UNKNOWN = 1, 2, 4, 8, 16, 32


def _latin() -> tuple[re.Pattern, re.Pattern, re.Pattern, np.ndarray]:
    """The pattern for Latin letters, one that finds what it doesn't know in the basic plane, one for all planes, and the bits of the basic plane's characters with, last, those of all others."""
    l = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
    ml, mn = (f"[{_set(r)}{_set(wb.MID_BOTH)}']" for r in (wb.MID_LETTER, wb.MID_NUM))
    inner = f"(?:[_0-9{l}]+|(?<=[{l}]){ml}(?=[{l}])|(?<=[0-9]){mn}(?=[0-9]))*"
    known = f"0-9_{l}"
    classes = "".join(map(_set, (wb.LETTER, wb.HEBREW, wb.NUMERIC, wb.JOINER, wb.KATAKANA, wb.EXTEND, wb.ALONE)))
    foreign = f"(?![{known}])[{classes}]"
    # a set within the basic plane is a table, searched several times faster than ranges behind a look-ahead
    plane = "".join(chr(c) for c in range(0x10000) if c < 0xD800 or c > 0xDFFF)
    basic = "".join(f"\\U{ord(c):08x}" for c in re.findall(foreign, plane))
    bits = np.zeros(0x10001, np.uint8)
    for bit, of in ((_L, f"[{l}]"), (_N, "[0-9]"), (_JOINS, "_"), (_ML, ml), (_MN, mn), (_UNKNOWN, foreign)):
        bits[[ord(c) for c in re.findall(of, plane)]] |= bit
    bits[-1] = _UNKNOWN
    return re.compile(f"[0-9{l}]{inner}|_+[0-9{l}]{inner}"), re.compile(f"[{basic}]"), re.compile(foreign), bits


_LATIN, _FOREIGN, _FOREIGN_ASTRAL, _BITS = _latin()
_ALL: list[_Rules] = []


def words(text: str) -> list[str]:
    """The words in order."""
    if text.isascii() or not (_FOREIGN.search(text) or _ASTRAL.search(text) and _FOREIGN_ASTRAL.search(text)):
        return _LATIN.findall(text)
    rules = _BASIC
    if _ASTRAL.search(text):
        if not _ALL:
            _ALL.append(_Rules(0x10FFFF))
        rules = _ALL[0]
    found = (rules.hebrew if _HEBREW.search(text) else rules.general).findall(text)
    # joiners and modifier symbols alone are no word
    return [w for w in found if w[0].isalnum() or rules.alnum.search(w)]


#: Characters that are split at once, unless one text has more.
_AT_ONCE = 1 << 20


def split_all(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """(place of its text, word) of every word of texts, in no order: the same words as words() finds."""
    rows, found = [np.zeros(0, np.int64)], []
    plain = np.array([t.isascii() for t in texts], bool)
    for place in (np.flatnonzero(plain), np.flatnonzero(~plain)):
        for at, some in _groups([texts[i] for i in place]):
            row, own = _split(some)
            rows.append(place[row + at])
            found += own
    return np.concatenate(rows), pa.chunked_array(found, pa.string()).combine_chunks() if found else pa.array([], pa.string())


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts of about _AT_ONCE characters together, with the place of the first."""
    first = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t) > _AT_ONCE:
            yield first, texts[first:i]
            first, n = i, 0
        n += len(t) + 1
    if n:
        yield first, texts[first:]


def _split(texts: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
    """A word is a run of letters, digits and underscores with the marks between two letters or two digits, but not of underscores alone, which is what _LATIN says."""
    joined = "\n".join(texts)
    data = np.frombuffer(joined.encode(), np.uint8)
    points = data if len(data) == len(joined) else np.minimum(np.frombuffer(joined.encode("utf-32-le"), np.uint32), len(_BITS) - 1)
    bits = np.append(_BITS[points], np.uint8(0))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    starts = np.append(0, ends[:-1])
    # texts with other letters are split one by one
    slow = np.unique(np.searchsorted(ends, np.flatnonzero(bits & _UNKNOWN), "right"))
    apart = [words(texts[i]) for i in slow]
    for i in slow:
        bits[starts[i] : ends[i]] = 0
    held = np.zeros(len(points) + 2, bool)  # held[i + 1]: whether a word has character i
    held[1:-1] = (bits[:-1] & (_L | _N | _JOINS)) != 0
    held[2:-1] |= (bits[:-2] & bits[2:] & (bits[1:-1] >> 3) & (_L | _N)) != 0
    edges = np.flatnonzero(held[1:] != held[:-1])
    begins = edges[::2]
    lone = np.flatnonzero(bits[begins] & _JOINS)
    if len(lone):
        runs = edges.reshape(-1, 2)
        lone = lone[(np.bitwise_or.reduceat(bits, runs[lone].ravel())[::2] & (_L | _N)) == 0]
        for a, b in runs[lone]:
            held[a + 1 : b + 1] = False
        edges = np.delete(runs, lone, 0).ravel()
        begins = edges[::2]
    inside = held[1:-1]
    if len(data) > len(points):
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.append(0, np.cumsum(width, dtype=np.int64))
        sizes = np.diff(at[edges])[::2]
        inside = np.repeat(inside, width)
    else:
        sizes = np.diff(edges)[::2]
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    fast = pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    row = np.repeat(np.arange(len(texts)), np.diff(np.append(np.searchsorted(begins, starts), len(begins))))
    return np.concatenate([row, np.repeat(slow, np.array([len(x) for x in apart], np.int64))]), [fast, *[pa.array(x, pa.string()) for x in apart]]
