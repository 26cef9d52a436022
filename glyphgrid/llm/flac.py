"""FLAC: a decoder to PCM blocks with seekable sample offsets, and an encoder for round trips.

Frames are found by their headers, whose checksum tells them from other bytes, so
that all frames of many streams are decoded at once: Rice codes and linear
prediction, which go on from one sample to the next, run in lock-step over them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrid.llm.common import per_slice


def _table(poly: int, bits: int) -> list[int]:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for x in range(256):
        c = x << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return out


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)
_SPAN = 4096


def _spread(table: list[int]) -> np.ndarray:
    """(_SPAN, 256): what a byte adds to the CRC that so many more bytes follow."""
    step, out = np.array(table, np.uint16), np.empty((_SPAN, 256), np.uint16)
    out[0] = step
    for d in range(1, _SPAN):
        out[d] = (out[d - 1] << np.uint16(8)) ^ step[out[d - 1] >> np.uint16(8)]
    return out


_CRC16_AT = _spread(_CRC16)
#: Bytes of streams that are decoded together, and bytes that may follow for a frame's end.
GROUP, SLACK = 1 << 20, 1 << 21
_SIZES = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}
_RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


class BadFrame(ValueError):
    """A frame that can't be read."""


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: bytes) -> int:
    """CRCs are linear: each byte's part is looked up by its place, and all are added."""
    c, raw = 0, np.frombuffer(data, np.uint8)
    for at in range(0, len(raw), _SPAN):
        part = raw[at : at + _SPAN]
        n = len(part)
        own = int(np.bitwise_xor.reduce(_CRC16_AT[np.arange(n - 1, -1, -1), part]))
        # what came before is a word added to the first two bytes
        high = _CRC16_AT[n - 1, c >> 8]
        low = _CRC16_AT[n - 2, c & 0xFF] if n > 1 else (c & 0xFF) << 8
        c = own ^ int(high) ^ int(low)
    return c


class Subframe:
    """Warm-up samples, residual and predictor, until restore() has filled samples."""

    def __init__(self, samples: np.ndarray | None, wasted: int, order: int = 0, shift: int = 0, coefficients: list[int] | None = None, residual: np.ndarray | None = None, fixed: bool = False):
        self.samples, self.wasted, self.order, self.shift, self.coefficients, self.residual, self.fixed = samples, wasted, order, shift, coefficients, residual, fixed


class _Group:
    """Bytes of one or more streams as bits, with where the next one is."""

    def __init__(self, data: bytes):
        self.data = data
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        n = len(self.bits)
        self.next = np.full(n + 64, n, np.int32)
        ones = np.flatnonzero(self.bits)
        gaps = np.diff(ones, prepend=-1)
        self.next[: gaps.sum()] = np.repeat(ones, gaps)
        padded = np.frombuffer(data + bytes(16), np.uint8).astype(np.uint64)
        self.words = np.zeros(len(data) + 1, np.uint64)
        for i in range(8):
            self.words |= padded[i : i + len(self.words)] << np.uint64(56 - 8 * i)

    def uint(self, at: int, n: int) -> int:
        last = at + n
        if last > len(self.bits):
            raise BadFrame("the stream ends within a frame")
        return int.from_bytes(self.data[at >> 3 : (last + 7) >> 3], "big") >> (-last & 7) & ((1 << n) - 1)

    def sint(self, at: int, n: int) -> int:
        v = self.uint(at, n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def ints(self, at: int, count: int, n: int) -> np.ndarray:
        """So many signed n-bit numbers."""
        if not n or not count:
            return np.zeros(count, np.int64)
        if at + count * n > len(self.bits):
            raise BadFrame("the stream ends within a frame")
        rows = self.bits[at : at + count * n].reshape(count, n).astype(np.int64)
        v = rows @ (np.int64(1) << np.arange(n - 1, -1, -1, dtype=np.int64))
        return np.where(rows[:, 0] == 1, v - (1 << n), v)

    def rice(self, at: Sequence[int], counts: Sequence[int], ks: Sequence[int]) -> tuple[list[np.ndarray], np.ndarray]:
        """(numbers, end) of lanes of Rice codes: zeros up to a one, then k bits, folded to signed."""
        order = np.argsort(-np.array(counts, np.int64), kind="stable")
        p, count, k = (np.array(x, np.int64)[order] for x in (at, counts, ks))
        lanes, top = len(p), int(count[0]) if len(count) else 0
        ends, from_, step = np.zeros((top, lanes), np.int64), np.zeros((top, lanes), np.int64), k + 1
        last = len(self.bits)
        for t, m in enumerate(np.searchsorted(-count, -np.arange(top), side="left").tolist()):
            here = p[:m]
            from_[t, :m] = here
            q = self.next[np.minimum(here, last)]
            ends[t, :m] = q
            p[:m] = q + step[:m]
        v = ends - from_
        if lanes and k.any():
            # the k bits after each one, out of the eight bytes from where they begin
            at = np.minimum(ends + 1, last)
            low = self.words[at >> 3] << (at & 7).astype(np.uint64)
            # a shift by 64 isn't defined, so it is done in two
            low = low >> np.uint64(1) >> (63 - k).astype(np.uint64)
            v = v << k | low.astype(np.int64)
        v = (v >> 1) ^ -(v & 1)
        out, end = [np.zeros(0, np.int64)] * lanes, np.empty(lanes, np.int64)
        for lane, to in enumerate(order.tolist()):
            out[to] = v[: count[lane], lane].copy()
            end[to] = p[lane]
        return out, end


def _begin(g: _Group, at: int, n: int, depth: int) -> tuple[Subframe, int, int, int]:
    """A subframe before its residual, where that begins, its number of partitions (0 for none) and their parameters' width."""
    if g.uint(at, 1):
        raise BadFrame("a subframe begins with 1")
    kind, wasted = g.uint(at + 1, 6), 0
    flag = g.uint(at + 7, 1)
    at += 8
    if flag:
        wasted = int(g.next[at]) - at + 1
        at += wasted
        depth -= wasted
    if depth < 1:
        raise BadFrame("all bits wasted")
    if kind == 0:
        return Subframe(np.full(n, g.sint(at, depth), np.int64), wasted), at + depth, 0, 0
    if kind == 1:
        return Subframe(g.ints(at, n, depth), wasted), at + n * depth, 0, 0
    if 8 <= kind <= 12:
        order, fixed = kind - 8, True
    elif kind >= 32:
        order, fixed = kind - 31, False
    else:
        raise BadFrame("reserved subframe type")
    if order > n:
        raise BadFrame("more warm-up samples than the block has")
    warm = g.ints(at, order, depth)
    at += order * depth
    shift, coefficients = 0, FIXED[order] if fixed else []
    if not fixed:
        precision = g.uint(at, 4) + 1
        if precision == 16:
            raise BadFrame("reserved precision")
        shift = g.sint(at + 4, 5)
        if shift < 0:
            raise BadFrame("negative shift")
        coefficients = g.ints(at + 9, order, precision).tolist()
        at += 9 + order * precision
    method, parts = g.uint(at, 2), 1 << g.uint(at + 2, 4)
    if method > 1:
        raise BadFrame("reserved residual coding")
    if n % parts or n // parts < order:
        raise BadFrame("partitions don't divide the block")
    return Subframe(None, wasted, order, shift, coefficients, warm, fixed), at + 6, parts, 5 if method else 4


def _decode(g: _Group, frames: list[dict]) -> None:
    """Fills the subframes of frames (at: bit of the body in g) and their end; those that can't be read get none."""
    live = [f for f in frames]
    for c in range(max((f["count"] for f in frames), default=0)):
        open_ = []
        for f in live:
            if c < f["count"] and f["subframes"] is not None:
                try:
                    depth = f["depth"] + (c == {8: 1, 9: 0, 10: 1}.get(f["channels"], -1))
                    sub, f["at"], parts, width = _begin(g, f["at"], f["n"], depth)
                    f["subframes"].append(sub)
                    if parts:
                        open_.append((f, sub, parts, width, [sub.residual]))
                except BadFrame:
                    f["subframes"] = None
        i = 0
        while open_:
            lanes = []
            for f, sub, parts, width, found in open_:
                try:
                    count, k = f["n"] // parts - (sub.order if i == 0 else 0), g.uint(f["at"], width)
                    f["at"] += width
                    if k == (1 << width) - 1:
                        bits = g.uint(f["at"], 5)
                        found.append(g.ints(f["at"] + 5, count, bits))
                        f["at"] += 5 + count * bits
                    else:
                        lanes.append((f, found, count, k))
                except BadFrame:
                    f["subframes"] = None
            if lanes:
                got, ends = g.rice([f["at"] for f, *_ in lanes], [x[2] for x in lanes], [x[3] for x in lanes])
                for (f, found, _, _), x, end in zip(lanes, got, ends.tolist()):
                    found.append(x)
                    f["at"] = end
                    if end > len(g.bits):
                        f["subframes"] = None
            i += 1
            for f, sub, parts, _, found in open_:
                if i == parts and f["subframes"] is not None:
                    sub.residual = np.concatenate(found)
            open_ = [x for x in open_ if x[2] > i and x[0]["subframes"] is not None]
    restore([s for f in frames for s in f["subframes"] or ()])


def restore(subframes: Sequence[Subframe], lanes: int = 256) -> None:
    """Fills the samples of predicted subframes: sums for fixed predictors, else those of one order in lock-step."""
    by: dict[int, list[Subframe]] = {}
    for s in subframes:
        if s.samples is None and s.fixed:
            x, state, w = s.residual[s.order :], [], s.residual[: s.order]
            for _ in range(s.order):
                state.append(int(w[-1]))
                w = np.diff(w)
            for last in reversed(state):
                x = last + np.cumsum(x)
            s.samples = np.concatenate([s.residual[: s.order], x])
        elif s.samples is None:
            by.setdefault(s.order, []).append(s)
    for order, own in by.items():
        own.sort(key=lambda s: len(s.residual))
        for at in range(0, len(own), lanes):
            part = own[at : at + lanes]
            x = np.zeros((max(len(s.residual) for s in part), len(part)), np.int64)
            for i, s in enumerate(part):
                x[: len(s.residual), i] = s.residual
            c = np.array([s.coefficients[::-1] for s in part], np.int64).T
            shift = np.array([s.shift for s in part], np.int64)
            for t in range(order, len(x)):
                x[t] += (x[t - order : t] * c).sum(0) >> shift
            for i, s in enumerate(part):
                s.samples = x[: len(s.residual), i].copy()


def _header(data: bytes, at: int, rate: int, depth: int, fixed_size: int) -> dict:
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise BadFrame("no frame sync")
    variable, b2, b3 = data[at + 1] & 1, data[at + 2], data[at + 3]
    p = at + 4
    lead = data[p]
    extra = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    if lead >= 0x80 and not 1 <= extra <= 6 or p + 1 + extra + 5 > len(data):
        raise BadFrame("bad frame number")
    number = lead if not extra else lead & ((1 << (6 - extra)) - 1)
    for b in data[p + 1 : p + 1 + extra]:
        if b & 0xC0 != 0x80:
            raise BadFrame("bad frame number")
        number = number << 6 | b & 0x3F
    p += 1 + extra
    code = b2 >> 4
    if code in (6, 7):
        width = code - 5
        size = int.from_bytes(data[p : p + width], "big") + 1
        p += width
    elif code in _SIZES:
        size = _SIZES[code]
    else:
        raise BadFrame("reserved block size")
    code = b2 & 15
    if code in _RATES:
        rate = _RATES[code]
    elif code in (12, 13, 14):
        width = 1 if code == 12 else 2
        rate = int.from_bytes(data[p : p + width], "big") * {12: 1000, 13: 1, 14: 10}[code]
        p += width
    elif code == 15:
        raise BadFrame("bad sample rate")
    channels, code = b3 >> 4, b3 >> 1 & 7
    if channels > 10 or code == 3 or b3 & 1:
        raise BadFrame("reserved bits")
    depth = _DEPTHS.get(code, depth)
    if p >= len(data) or crc8(data[at:p]) != data[p]:
        raise BadFrame("header checksum")
    return {"offset": number if variable else number * (fixed_size or size), "n": size, "rate": rate, "channels": channels, "depth": depth, "body": p + 1}


def open_stream(data: bytes) -> tuple[dict, list[dict], int]:
    """Stream info, the frames that have a valid header, and where the first is due."""
    start = 0
    if data[:3] == b"ID3" and len(data) > 10:
        start = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9])
    if data[start : start + 4] != b"fLaC":
        raise BadFrame("no FLAC stream")
    info, at, last = {"rate": 0, "depth": 16, "channels": 0, "total": 0, "md5": b"", "min": 0, "max": 0}, start + 4, False
    while not last and at + 4 <= len(data):
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0 and len(body) >= 34:
            packed = int.from_bytes(body[10:18], "big")
            info = {"min": int.from_bytes(body[:2], "big"), "max": int.from_bytes(body[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "depth": (packed >> 36 & 31) + 1, "total": packed & ((1 << 36) - 1), "md5": body[18:34]}
        at += 4 + size
    found, first = [], at
    at = data.find(b"\xff", at)
    while at >= 0:
        try:
            h = _header(data, at, info["rate"], info["depth"], info["min"] if info["min"] == info["max"] else 0)
            found.append(h | {"byte": at, "count": h["channels"] + 1 if h["channels"] < 8 else 2, "subframes": [], "ok": False})
        except BadFrame:
            pass
        at = data.find(b"\xff", at + 1)
    return info, found, first


def _settle(data: bytes, found: list[dict], at: int, upto: int, info: dict) -> tuple[list[dict], int]:
    """(frames, where the next is due): decoded frames in order, those within an intact one left out.

    Bytes from at to upto that no frame accounts for come as a frame without subframes.
    """
    out: list[dict] = []

    def gap(start: int) -> None:
        out.append({"byte": start, "subframes": [], "ok": False, "offset": None, "n": None, "rate": info["rate"], "channels": None, "depth": info["depth"]})

    for i, f in enumerate(found):
        if f["byte"] < at:
            continue
        if f["byte"] > at:
            gap(at)
        following, end = found[i + 1]["byte"] if i + 1 < len(found) else upto, f["end"]
        if f["subframes"] is None or end + 2 > len(data):
            # its header is sound, its samples can't be read
            gap(f["byte"])
            at = following
            continue
        f["ok"] = crc16(data[f["byte"] : end]) == int.from_bytes(data[end : end + 2], "big")
        out.append(f)
        # a damaged frame may seem longer than it is: the next header is its end
        at = end + 2 if f["ok"] else min(end + 2, following)
    if at < upto:
        gap(at)
    return out, max(at, upto)


def frames_of(streams: list[bytes]) -> Iterator[tuple[int, dict | None, list[dict]]]:
    """Yields (stream, info, frames) in order, a long stream in several parts; info is None for what is no stream."""
    opened: list[tuple[int, dict, list[dict], int]] = []
    size = 0

    def flush() -> Iterator[tuple[int, dict | None, list[dict]]]:
        nonlocal size
        group = _Group(b"".join(streams[i] for i, *_ in opened))
        base = 0
        for i, _, found, _ in opened:
            for f in found:
                f["at"] = (base + f["body"]) * 8
            base += len(streams[i])
        _decode(group, [f for _, _, found, _ in opened for f in found])
        base = 0
        for i, info, found, at in opened:
            for f in found:
                f["end"] = -(-f["at"] // 8) - base
            base += len(streams[i])
            yield i, info, _settle(streams[i], found, at, len(streams[i]), info)[0]
        opened.clear()
        size = 0

    for i, data in enumerate(streams):
        try:
            info, found, at = open_stream(data)
        except BadFrame:
            yield from flush()
            yield i, None, []
            continue
        if len(data) > GROUP:
            yield from flush()
            yield from _long(i, data, info, found, at)
            continue
        if size + len(data) > GROUP:
            yield from flush()
        opened.append((i, info, found, at))
        size += len(data)
    yield from flush()


def _long(i: int, data: bytes, info: dict, found: list[dict], at: int) -> Iterator[tuple[int, dict | None, list[dict]]]:
    """A long stream, its frames decoded by groups of so many bytes."""
    k = 0
    while k < len(found) or at < len(data):
        to = k
        while to < len(found) and found[to]["byte"] < found[k]["byte"] + GROUP:
            to += 1
        some = found[k:to]
        if some:
            start = some[0]["byte"]
            for f in some:
                f["at"] = (f["body"] - start) * 8
            _decode(_Group(data[start : start + GROUP + SLACK]), some)
            for f in some:
                f["end"] = -(-f["at"] // 8) + start
        out, at = _settle(data, some, at, found[to]["byte"] if to < len(found) else len(data), info)
        yield i, info, out
        k = to
        while k < len(found) and found[k]["byte"] < at:
            k += 1
    if not found and at >= len(data):
        yield i, info, []


def parse(data: bytes) -> tuple[dict, list[dict]]:
    """Stream info and frames of a FLAC stream.

    A frame has offset, n, rate, channels, depth, byte, subframes and ok.  What
    can't be read has no subframes; reading goes on at the next valid header.
    """
    info, frames = None, []
    for _, got, some in frames_of([data]):
        if got is None:
            raise BadFrame("no FLAC stream")
        info = got
        frames += some
    return info, frames


def channels(frame: dict) -> np.ndarray:
    """(samples, channels) of a frame whose subframes are restored."""
    x = [s.samples << s.wasted for s in frame["subframes"]]
    if frame["channels"] == 8:
        x[1] = x[0] - x[1]
    elif frame["channels"] == 9:
        x[0] = x[0] + x[1]
    elif frame["channels"] == 10:
        mid, side = x[0] << 1 | x[1] & 1, x[1]
        x = [(mid + side) >> 1, (mid - side) >> 1]
    return np.stack(x, 1)


def pcm_bytes(x: np.ndarray, depth: int) -> bytes:
    """Signed little-endian samples, channels interleaved, in the least whole number of bytes."""
    width = -(-depth // 8)
    return np.ascontiguousarray(x.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


_KIND = "block bigint, sample_offset bigint, n_samples bigint, byte_offset bigint, sample_rate int, channels int, bits int, crc_ok boolean, stream_ok boolean, pcm binary"
_TYPES = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.bool_(), pa.bool_(), pa.binary()]


def decode(media: DataFrame, column: str = "flac") -> DataFrame:
    """The other columns of media with (block, sample_offset, n_samples, byte_offset, sample_rate, channels, bits, crc_ok, stream_ok, pcm), a row for each frame.

    sample_offset is a block's first sample in the stream, so that a range is
    read by seek() without decoding what is before it; pcm has signed
    little-endian samples, channels interleaved.  crc_ok tells that header and
    frame checksums agree; a frame that disagrees is marked and decoded all the
    same, up to the next valid header; bytes that can't be read give null offset
    and pcm.  stream_ok stands in a stream's last row: whether its number of
    samples and MD5 are those of its header and all frames are sound (null where
    the header has neither).  Null or empty media and streams without frames or
    samples give no rows; bytes that are no FLAC stream, or a header that promises
    samples alone, give one row with crc_ok false and the rest null.  Rows that are
    repeated are decoded repeatedly.  Columns of media named like an output column
    are replaced.
    """
    made = [x.split(" ")[0] for x in _KIND.split(", ")]
    kept = [c for c in media.columns if c != column and c.lower() not in made]
    kind = ", ".join([f"`{c}` {media.schema[c].dataType.simpleString()}" for c in kept] + [_KIND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from one(batch.slice(at, 256))

    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = b.column(b.schema.names.index("_glyphgrid_flac")).to_pylist()
        rows = [i for i, x in enumerate(raw) if x]
        at, out, size = [], [], 0
        state: dict = {}

        def batch_of() -> pa.RecordBatch:
            where = pa.array(at, pa.int64())
            cols = [b.column(i).take(where) for i in range(len(kept))] + [pa.array(c, t) for c, t in zip(zip(*out), _TYPES)]
            return pa.RecordBatch.from_arrays(cols, names=kept + made)

        def close() -> None:
            if state:
                info, own = state["info"], state["last"]
                known = bool(info["total"] or info["md5"].strip(b"\0"))
                if own is None and info["total"]:
                    at.append(state["row"])
                    out.append((None, None, None, None, None, None, None, False, False, None))
                elif own is not None and known:
                    sound = state["sound"] and info["total"] in (0, state["n"]) and (not info["md5"].strip(b"\0") or state["md5"].digest() == info["md5"])
                    at.append(state["row"])
                    out.append((*own[:8], sound, own[9]))
                elif own is not None:
                    at.append(state["row"])
                    out.append(own)
            state.clear()

        for k, info, frames in frames_of([raw[i] for i in rows]):
            i = rows[k]
            if state.get("row") != i:
                close()
                if info is None:
                    at.append(i)
                    out.append((None, None, None, None, None, None, None, False, None, None))
                    continue
                state.update(row=i, info=info, last=None, sound=True, n=0, block=0, md5=hashlib.md5())
            for f in frames:
                if state["last"] is not None:
                    at.append(i)
                    out.append(state["last"])
                x = channels(f) if f["subframes"] else None
                pcm = None if x is None else pcm_bytes(x, f["depth"])
                state["last"] = (state["block"], f["offset"], f["n"], f["byte"], f["rate"], None if x is None else x.shape[1], f["depth"], f["ok"], None, pcm)
                state["block"] += 1
                state["sound"] &= f["ok"]
                if x is not None:
                    state["n"] += len(x)
                    state["md5"].update(pcm)
                    size += len(pcm)
                f["subframes"] = None
                if size > GROUP * 8:
                    yield batch_of()
                    at.clear()
                    out.clear()
                    size = 0
        close()
        if out:
            yield batch_of()

    return media.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").alias("_glyphgrid_flac")).mapInArrow(run, kind)


def seek(blocks: DataFrame, first: int, last: int) -> DataFrame:
    """The blocks that hold any of the samples first to last - 1; a filter on their offsets."""
    return blocks.where((F.col("sample_offset") < last) & (F.col("sample_offset") + F.col("n_samples") > first))


# the encoder


@lru_cache(maxsize=4096)
def _put(value: int, width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(value.to_bytes((width + 7) // 8, "big"), np.uint8))[-width:]


def _put_ints(x: np.ndarray, width: int) -> np.ndarray:
    return ((x[:, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8).ravel()


def _put_rice(x: np.ndarray, k: int) -> np.ndarray:
    v = (x << 1) ^ (x >> 63)
    end = np.cumsum((v >> k) + 1 + k)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    one = end - k - 1
    out[one] = 1
    if k:
        out[(one[:, None] + np.arange(1, k + 1)).ravel()] = (v[:, None] >> np.arange(k - 1, -1, -1) & 1).ravel()
    return out


def _predictor(x: np.ndarray, order: int, precision: int = 12) -> tuple[list[int], int]:
    """Quantised coefficients and shift by Levinson-Durbin recursion."""
    f = x.astype(np.float64)
    r = [float(f[: len(f) - i] @ f[i:]) for i in range(order + 1)]
    c, err = [0.0] * order, r[0] * 1.0000001 + 1e-9
    for i in range(order):
        k = (r[i + 1] - sum(c[j] * r[i - j] for j in range(i))) / err
        c[: i + 1] = [c[j] - k * c[i - 1 - j] for j in range(i)] + [k]
        err *= max(1 - k * k, 1e-9)
    a = np.array(c)
    shift = int(max(0, min(14, precision - 1 - np.ceil(np.log2(max(np.abs(a).max(), 1e-9) + 1e-12)) - 1)))
    top = (1 << (precision - 1)) - 1
    return np.clip(np.round(a * (1 << shift)), -top - 1, top).astype(int).tolist(), shift


def _residual(x: np.ndarray, c: Sequence[int], shift: int) -> np.ndarray:
    order, n = len(c), len(x)
    guess = np.zeros(n - order, np.int64)
    for i, a in enumerate(c):
        guess += a * x[order - 1 - i : n - 1 - i]
    return x[order:] - (guess >> shift)


def _put_subframe(x: np.ndarray, depth: int, lpc: int, kind: str | None, parts: int, escape: bool) -> np.ndarray:
    n, wasted = len(x), 0
    if kind is None and (x == x[0]).all():
        return np.concatenate([_put(0, 8), _put(int(x[0]) & ((1 << depth) - 1), depth)])
    while not (x & 1).any() and wasted < depth - 1:
        x, wasted = x >> 1, wasted + 1
    depth -= wasted
    tail = [_put(1, wasted)] if wasted else []
    flag = [_put(1 if wasted else 0, 1), *tail]
    tried, rest = [], x
    for o in range(min(5, n)):
        tried.append((f"fixed{o}", FIXED[o], 0, rest))
        rest = np.diff(rest)
    if lpc and n > lpc:
        c, shift = _predictor(x, lpc)
        tried.append(("lpc", c, shift, _residual(x, c, shift)))
    if kind:
        tried = [t for t in tried if t[0] == kind] or tried
    name, c, shift, res = min(tried, key=lambda t: float(np.abs(t[3]).sum()) + len(t[1]) * (1 << (depth - 2)) * 0.01)
    if kind == "verbatim":
        return np.concatenate([_put(1, 7), *flag, _put_ints(x, depth)])
    order = len(c)
    out = [_put(0, 1), _put(8 + order if name != "lpc" else 31 + order, 6), *flag, _put_ints(x[:order], depth)]
    if name == "lpc":
        out += [_put(11, 4), _put(shift & 31, 5), _put_ints(np.array(c), 12)]
    while parts and (n % (1 << parts) or n >> parts <= order):
        parts -= 1
    each = n >> parts
    cut = [res[max(0, i * each - order) : (i + 1) * each - order] for i in range(1 << parts)]
    ks = [max(0, int(np.log2(max(np.abs(p).mean() if len(p) else 0, 0.5)) + 1)) for p in cut]
    wide = max(ks) > 14
    out += [_put(1 if wide else 0, 2), _put(parts, 4)]
    for i, (p, k) in enumerate(zip(cut, ks)):
        if escape and i == 0:
            width = int(max(int(np.abs(p).max()) if len(p) else 0, 1)).bit_length() + 1
            out += [_put(31 if wide else 15, 5 if wide else 4), _put(width, 5), _put_ints(p, width)]
        else:
            out += [_put(k, 5 if wide else 4), _put_rice(p, k)]
    return np.concatenate(out)


def encode(x: np.ndarray, rate: int = 16000, depth: int = 16, block: int = 4096, lpc: int = 8, stereo: int | None = None, kind: str | None = None, parts: int = 2, escape: bool = False) -> bytes:
    """A FLAC stream of integer samples (n,) or (n, channels).

    stereo: 8, 9 or 10 for left/side, side/right, mid/side.  kind: verbatim,
    fixed0 to fixed4 or lpc instead of what seems smallest.
    """
    x = np.asarray(x, np.int64)
    x = x[:, None] if x.ndim == 1 else x
    n, count = x.shape
    packed = rate << 44 | (count - 1) << 41 | (depth - 1) << 36 | n
    out = [b"fLaC\x80\x00\x00\x22", block.to_bytes(2, "big") * 2, bytes(6), packed.to_bytes(8, "big"), hashlib.md5(pcm_bytes(x, depth)).digest()]
    code = {v: k for k, v in _DEPTHS.items()}.get(depth, 0)
    for number, at in enumerate(range(0, n, block)):
        part = x[at : at + block]
        if number < 0x80:
            coded = bytes([number])
        else:
            tail, v = [], number
            while v >= 1 << (6 - len(tail)):
                tail.append(0x80 | v & 0x3F)
                v >>= 6
            coded = bytes([(0xFF << (7 - len(tail))) & 0xFF | v, *reversed(tail)])
        head = bytes([0xFF, 0xF8, 7 << 4, (stereo or count - 1) << 4 | code << 1]) + coded + (len(part) - 1).to_bytes(2, "big")
        head += bytes([crc8(head)])
        chans = [part[:, i] for i in range(count)]
        if stereo:
            side = chans[0] - chans[1]
            chans = {8: [chans[0], side], 9: [side, chans[1]], 10: [(chans[0] + chans[1]) >> 1, side]}[stereo]
        subs = [_put_subframe(c, depth + (i == {8: 1, 9: 0, 10: 1}.get(stereo, -1)), lpc, kind, parts, escape) for i, c in enumerate(chans)]
        frame = head + np.packbits(np.concatenate(subs)).tobytes()
        out += [frame, crc16(frame).to_bytes(2, "big")]
    return b"".join(out)


def spoken(turns: DataFrame, text: str = "text", block: int = 1024) -> DataFrame:
    """turns with a column flac in place of the text: its UTF-8 bytes as signed 8-bit samples.

    The test tables hold no audio; this gives a media column of known content.
    A null text has null media.  A column flac of turns is replaced.
    """
    kept = [c for c in turns.columns if c not in (text, "flac")]
    kind = ", ".join([f"`{c}` {turns.schema[c].dataType.simpleString()}" for c in kept] + ["flac binary"])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        made = [None if t is None else encode(np.frombuffer(t.encode("utf-8", "replace"), np.int8), 8000, 8, block, lpc=4, parts=1) for t in b.column(len(kept)).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(made, pa.binary())], names=[*kept, "flac"])

    return turns.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).mapInArrow(per_slice(run, 256), kind)
