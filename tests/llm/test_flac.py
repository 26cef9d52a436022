import hashlib

import numpy as np
import pytest

from glyphgrid.llm import flac

T = np.arange(9001)
SOUND = (8000 * np.sin(T / 17) + 3000 * np.sin(T / 5.3) + np.random.default_rng(0).normal(0, 30, len(T))).astype(int)


def round_trip(x, **k):
    data = flac.encode(x, **k)
    info, frames = flac.parse(data)
    flac.restore([s for f in frames for s in f["subframes"]])
    x = np.asarray(x)
    x = x[:, None] if x.ndim == 1 else x
    y = np.concatenate([flac.channels(f) for f in frames]) if frames else np.zeros((0, x.shape[1]), int)
    assert all(f["ok"] for f in frames) and y.shape == x.shape and (y == x).all()
    assert hashlib.md5(flac.pcm_bytes(y, k.get("depth", 16))).digest() == info["md5"]
    assert [f["offset"] for f in frames] == list(range(0, len(x), k.get("block", 4096)))


@pytest.mark.parametrize("kind", [None, "verbatim", "fixed0", "fixed1", "fixed2", "fixed3", "fixed4", "lpc"])
@pytest.mark.parametrize("escape", [False, True])
def test_predictors(kind, escape):
    round_trip(SOUND, kind=kind, escape=escape, lpc=8 if kind != "fixed0" else 0)


@pytest.mark.parametrize("depth", [8, 12, 16, 20, 24])
def test_depths_and_wasted_bits(depth):
    x = np.random.default_rng(depth).integers(-(1 << (depth - 1)), 1 << (depth - 1), 3000)
    x[:2] = [-(1 << (depth - 1)), (1 << (depth - 1)) - 1]
    for y in (x, x >> 3 << 3):
        round_trip(y, depth=depth)
        for stereo in (None, 8, 9, 10):
            round_trip(np.stack([y, -y - 1], 1), depth=depth, stereo=stereo)


def test_lengths_and_frame_numbers():
    for x in (np.zeros(5000, int), np.zeros(0, int), np.array([5]), np.stack([SOUND] * 5, 1)):
        round_trip(x)
    round_trip(np.arange(40_000) % 200, block=16)  # numbers of several bytes
    round_trip(SOUND, lpc=32, parts=5)


def test_checksums_are_those_of_bitwise_division():
    def slow(data, poly, bits):
        c = 0
        for b in data:
            for i in range(7, -1, -1):
                top = (c >> (bits - 1)) & 1
                c = (c << 1) & ((1 << bits) - 1)
                if top ^ (b >> i & 1):
                    c ^= poly
        return c

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 100):
        data = rng.bytes(n)
        assert flac.crc8(data) == slow(data, 0x07, 8) and flac.crc16(data) == slow(data, 0x8005, 16)
    assert flac.crc8(b"123456789") == 0xF4 and flac.crc16(b"123456789") == 0xFEE8


def test_damage_is_marked_and_reading_goes_on():
    data = bytearray(flac.encode(SOUND, block=1000))
    at = flac.parse(bytes(data))[1][3]["byte"]
    data[at + 40] ^= 0x10
    assert [f["ok"] for f in flac.parse(bytes(data))[1]] == [True] * 3 + [False] + [True] * 6
    data = bytearray(flac.encode(SOUND, block=1000))
    data[at] = 0
    frames = flac.parse(bytes(data))[1]
    assert [f["offset"] for f in frames][:6] == [0, 1000, 2000, None, 4000, 5000]
    cut = flac.parse(flac.encode(SOUND, block=1000)[: at + 50])[1]
    assert [f["offset"] for f in cut] == [0, 1000, 2000, None]


def test_damage_that_changes_a_frame_s_length_loses_no_other_frame():
    """A Rice parameter or partition that reads on past the frame's end: the next header ends it."""
    clean = flac.encode(SOUND, block=1000)
    want = [(f["offset"], flac.channels(f).tobytes()) for f in flac.parse(clean)[1]]
    frames = flac.parse(clean)[1]
    rng = np.random.default_rng(3)
    for _ in range(60):
        k = int(rng.integers(0, len(frames)))
        lo, hi = frames[k]["byte"] + 7, frames[k + 1]["byte"] if k + 1 < len(frames) else len(clean)
        data = bytearray(clean)
        data[int(rng.integers(lo, min(lo + 30, hi)))] ^= int(rng.integers(1, 256))
        got = {f["offset"]: flac.channels(f).tobytes() for f in flac.parse(bytes(data))[1] if f["ok"]}
        assert got == dict(want[:k] + want[k + 1 :])


# from the appendix of RFC 9639: streams that another encoder made, with the samples printed there
RFC_1 = "664c61438000002210001000 00000f00000f0ac442f00000 00013e84b41807dc69030758 6a3dad1a2e0ffff869180000 bf0358fd03128baa9a"
RFC_2 = "664c61438000002200100010 0000170000440ac442f00000 0013d5b0564975e98b8d8b93 0422757b8103 fff86998000f9912 086701623d1442998f5df70d 6fe00c17caeb21000ee7a77a 24a1590c1217b603097b784f aa9a33d285e070ad5b1b4851 b4010d99d2cd1a68f1e6b810"
RFC_3 = "664c61438000002210001000 00001f00001f07d000700000 0018f8f9e396f5cbcfc6dc80 7f9977906b32fff868020017 e944004f6f313d1047d227cb 6d090831452bdc2822228057 a3"
SAMPLES_1 = [[25588, 10416]]
SAMPLES_2 = list(zip([10372, 18041, 14942, 17876, 15627, 17899, 16242, 18077, 16824, 18263, 17295, -14418, -15201, -14508, -15195, -14818], [6070, 10545, 8743, 10449, 9143, 10463, 9502, 10569, 9840, 10680, 10113, -8428, -8895, -8476, -8896, -8653]))
SAMPLES_3 = [[x] for x in (0, 79, 111, 78, 8, -61, -90, -68, -13, 42, 67, 53, 13, -27, -46, -38, -12, 14, 24, 19, 6, -4, -5, 0)]


def test_streams_of_the_standard(spark):
    """Verbatim stereo, fixed prediction with a side channel, and linear prediction; header, frame and MD5 checksums agree."""
    media = spark.createDataFrame([(i, bytearray(bytes.fromhex(x))) for i, x in enumerate((RFC_1, RFC_2, RFC_3), 1)], "id int, flac binary")
    got = {r["id"]: r for r in flac.decode(media).collect()}
    for i, want, depth in ((1, SAMPLES_1, 16), (2, SAMPLES_2, 16), (3, SAMPLES_3, 8)):
        assert bytes(got[i]["pcm"]) == np.array(want).astype("<i2" if depth == 16 else "i1").tobytes()
        assert got[i]["crc_ok"] and got[i]["bits"] == depth and got[i]["channels"] == len(want[0]) and got[i]["sample_offset"] == 0
    # the second stream's last frame isn't here, which its total tells
    assert [got[i]["stream_ok"] for i in (1, 2, 3)] == [True, False, True]
    assert [got[i]["sample_rate"] for i in (1, 2, 3)] == [44100, 44100, 32000]


def test_stream_checks(spark):
    clean = flac.encode(SOUND, block=1000)
    at = flac.parse(clean)[1][7]["byte"]
    bad = bytearray(clean)
    bad[30] ^= 1  # the MD5 itself
    none = bytearray(clean)
    none[26:42] = bytes(16)
    rows = [(1, clean), (2, clean[:at]), (3, bytes(bad)), (4, bytes(none)), (5, clean[:42])]
    got = flac.decode(spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id int, flac binary")).collect()
    last = {r["id"]: r["stream_ok"] for r in sorted(got, key=lambda r: r["block"] or 0)}
    assert last == {1: True, 2: False, 3: False, 4: True, 5: False}
    assert all(r["stream_ok"] is None for r in got if r["id"] == 1 and r["block"] < 9) and all(r["crc_ok"] for r in got if r["id"] != 5)


def test_very_long_media_come_in_groups(spark, monkeypatch):
    x = np.tile(SOUND, 60)
    data = flac.encode(x, block=4000)
    assert len(data) > flac.GROUP // 2
    monkeypatch.setattr(flac, "GROUP", 50_000)
    info, frames = flac.parse(data)
    assert all(f["ok"] for f in frames) and [f["offset"] for f in frames] == list(range(0, len(x), 4000))
    assert (np.concatenate([flac.channels(f) for f in frames])[:, 0] == x).all()
    broken = bytearray(data)
    broken[frames[20]["byte"]] = 0
    assert [f["offset"] for f in flac.parse(bytes(broken))[1]] == [None if i == 20 else i * 4000 for i in range(len(frames))]
    monkeypatch.undo()
    got = flac.decode(spark.createDataFrame([(1, bytearray(data))], "id int, flac binary")).orderBy("block").collect()
    assert b"".join(bytes(r["pcm"]) for r in got) == x.astype("<i2").tobytes() and got[-1]["stream_ok"]


def test_blocks_and_seek(spark):
    rows = [(1, bytearray(flac.encode(SOUND, rate=44100, block=1000))), (2, None), (3, bytearray(b"")), (4, bytearray(b"not audio")), (1, bytearray(flac.encode(SOUND, rate=44100, block=1000))), (None, bytearray(flac.encode(np.array([1, -2, 3]))))]
    media = spark.createDataFrame([(i, b, "x", 7) for i, b in rows], "id int, flac binary, pcm string, block int")
    out = flac.decode(media)
    assert out.columns[0] == "id" and out.schema["block"].dataType.simpleString() == "bigint"
    got = out.collect()
    one = sorted((r["block"], bytes(r["pcm"]), r["sample_offset"], r["crc_ok"]) for r in got if r["id"] == 1)
    assert len(one) == 20 and one[::2] == one[1::2]
    assert b"".join(p for _, p, _, _ in one[::2]) == SOUND.astype("<i2").tobytes()
    assert [(r["block"], r["crc_ok"], r["pcm"]) for r in got if r["id"] == 4] == [(None, False, None)]
    assert [bytes(r["pcm"]) for r in got if r["id"] is None] == [np.array([1, -2, 3], "<i2").tobytes()]
    assert {r["id"] for r in got} == {1, 4, None}
    assert sorted({r["block"] for r in flac.seek(out, 2500, 4001).where("id = 1").collect()}) == [2, 3, 4]
    assert flac.decode(media.limit(0)).count() == 0


def test_spoken_text_comes_back(spark):
    rows = [(1, 0, "hello ä" * 400), (1, 1, None), (1, 2, ""), (None, 3, "z")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    got = flac.decode(flac.spoken(turns)).collect()
    joined = {}
    for r in sorted(got, key=lambda r: r["block"]):
        joined[r["conv_id"], r["turn"]] = joined.get((r["conv_id"], r["turn"]), b"") + bytes(r["pcm"])
    assert joined == {(1, 0): rows[0][2].encode(), (None, 3): b"z"}
