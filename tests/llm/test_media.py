import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from siftwell.llm import media
from siftwell.llm.media import ACROSS, DOWN, MediaError, clip_rows, decode_avi, decode_media, detect_shots, encode_avi, encode_media
from siftwell.llm.queries import op11_media_columns


def payloads():
    rng = random.Random(4)
    return [b"", b"a", bytes(64), bytes(range(256)) * 9, bytes([0, 255] * 700), rng.randbytes(5000), b"\xff" * 513, "Été 日本 ".encode() * 300]


@pytest.mark.parametrize("k", range(8))
def test_round_trip(k):
    p = payloads()[k]
    stored = encode_avi(p)
    video = decode_avi(stored)
    assert video.payload == p and encode_avi(p) == stored
    assert (video.rate, video.width, video.height) == (25.0, ACROSS * 8, DOWN * 8)
    assert struct.unpack("<I", stored[4:8])[0] == len(stored) - 8
    # samples by the general decoder, code by code
    at = stored.find(b"\xff\xd8")
    if at > 0:
        jpeg = stored[at : stored.find(b"\xff\xd9", at) + 2]
        head, scan = media._split_frame(jpeg)
        pixels = media._samples(head, media._coefficients(head, scan))
        assert (pixels == video.means[0][:, None, None]).all()
        assert video.histograms[0].tolist() == (np.bincount((pixels >> 3).ravel(), minlength=32) / pixels.size).tolist()


def baseline_jpeg(pixels, restart=0):
    """An ordinary encoder for one component: flat code lengths, coefficients rounded to whole numbers."""
    h, w = pixels.shape
    cos = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    steps = {0: 0}
    order, r, c, up = [], 0, 0, True
    for _ in range(64):
        order.append(r * 8 + c)
        if up:
            (r, c, up) = (r, c + 1, False) if r == 0 and c < 7 else (r + 1, c, False) if c == 7 else (r - 1, c + 1, True)
        else:
            (r, c, up) = (r + 1, c, True) if c == 0 and r < 7 else (r, c + 1, True) if r == 7 else (r + 1, c - 1, False)
    symbols = [s for s in range(256) if s & 15 or s in (0, 0xF0)]
    number = lambda x: (abs(x).bit_length(), format(x if x > 0 else x + (1 << abs(x).bit_length()) - 1, f"0{abs(x).bit_length()}b") if x else "")
    bits, last, out, blocks = "", 0, b"", 0
    flush = lambda b: bytes(int((b + "1" * (-len(b) % 8))[k : k + 8], 2) for k in range(0, len(b), 8)).replace(b"\xff", b"\xff\x00")
    for y in range(0, h, 8):
        for x in range(0, w, 8):
            if restart and blocks and blocks % restart == 0:
                out, bits, last = out + flush(bits) + bytes([0xFF, 0xD0 + (blocks // restart - 1) % 8]), "", 0
            blocks += 1
            z = np.rint(cos @ (pixels[y : y + 8, x : x + 8].astype(float) - 128) @ cos.T).astype(int).ravel()[order].tolist()
            k, b = number(z[0] - last)
            bits, last, run = bits + format(k, "04b") + b, z[0], 0
            end = max([i for i in range(64) if z[i]], default=0)
            for v in z[1 : end + 1]:
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + format(symbols.index(0xF0), "08b"), run - 16
                k, b = number(v)
                bits, run = bits + format(symbols.index(run << 4 | k), "08b") + b, 0
            if end < 63:
                bits += format(symbols.index(0), "08b")
    out += flush(bits)
    seg = media._segment
    parts = [b"\xff\xd8", seg(0xDB, bytes([0] + [1] * 64)), seg(0xC0, struct.pack(">BHHB", 8, h, w, 1) + bytes([1, 0x11, 0])), seg(0xC4, bytes([0, 0, 0, 0, 12] + [0] * 12 + list(range(12)))), seg(0xC4, bytes([0x10] + [0] * 7 + [len(symbols)] + [0] * 8 + symbols))]
    parts += [seg(0xDD, struct.pack(">H", restart))] if restart else []
    return b"".join([*parts, seg(0xDA, bytes([1, 1, 0, 0, 63, 0])), out, b"\xff\xd9"])


def avi_of(frames, width, height, index=True):
    c = media._chunk
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, 10, 0, len(frames), 0, 0, 0, 0, 0, width, height)
    image = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", 0, 0, 0, 0, 0)
    movi, rows = b"movi", b""
    for f in frames:
        rows += struct.pack("<4sIII", b"00dc", 16, len(movi), len(f))
        movi += c(b"00dc", f)
    body = b"AVI " + c(b"LIST", b"hdrl" + c(b"LIST", b"strl" + c(b"strh", stream) + c(b"strf", image))) + c(b"LIST", movi)
    return c(b"RIFF", body + (c(b"idx1", rows) if index else b""))


@pytest.mark.parametrize("index, restart", [(True, 0), (False, 0), (True, 2)])
def test_other_baseline_frames(index, restart):
    rng = np.random.default_rng(5)
    y, x = np.mgrid[0:16, 0:24]
    shapes = [np.clip(100 + 3 * x + 2 * y + rng.integers(-9, 9, x.shape), 0, 255).astype(np.uint8) for _ in range(6)]
    shapes += [np.clip(30 + rng.integers(0, 3, x.shape), 0, 255).astype(np.uint8) for _ in range(5)]
    video = decode_avi(avi_of([baseline_jpeg(p, restart) for p in shapes], 24, 16, index))
    want = np.stack([np.rint(p.reshape(2, 8, 3, 8).mean(axis=(1, 3))).ravel() for p in shapes])
    assert np.abs(video.means - want).max() <= 1 and (video.rate, video.width, video.height, video.payload) == (10.0, 24, 16, None)
    assert [c[:5] for c in media.clips_of(video)] == [(0, 0, 6, 0.0, 0.6), (1, 6, 11, 0.6, 1.1)]


def test_shots_adapt():
    def shares(*levels):
        h = np.zeros((len(levels), 32))
        h[np.arange(len(levels)), levels] = 1
        return h

    assert detect_shots(shares()).tolist() == [] and detect_shots(shares(3)).tolist() == [0]
    assert detect_shots(shares(*[1] * 4, *[2] * 10, 1, 1)).tolist() == [0, 4, 14]
    assert detect_shots(shares(1, 2)).tolist() == [0, 1]
    # where every frame changes, one more change is no shot
    assert len(detect_shots(shares(*(k % 2 for k in range(30))))) <= 2


def test_broken_files():
    good = encode_avi(bytes(range(200)) * 10)
    for bad in (b"", b"RIFF", good[:50], good[:300], good[:-2000], b"x" * 100, good.replace(b"MJPG", b"H264"), good.replace(b"idx1", b"junk").replace(b"movi", b"muvi")):
        with pytest.raises((MediaError, struct.error, IndexError, ValueError)):
            decode_avi(bad)
    assert decode_avi(good.replace(b"idx1", b"junk")).payload == decode_avi(good).payload


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", "a", "a", "é" * 32, "x" * 64, "y" * 65, "日本語 " * 5000] + ["".join(rng.choice("ab\x00\n é日") for _ in range(rng.randint(0, 3000))) for _ in range(30)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_media_columns(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and got[0].media_sha256 == got[1].media_sha256 and got[2][1:] == got[3][1:]
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64) or bytes(64)
        stored = encode_avi(padded)
        assert tuple(got[k])[:7] == (k, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert got[k].feature.startswith(f"{-(-len(padded) // 512)}x256x128;")


def test_columns_nulls_and_clips(spark):
    rows = [(1, bytearray(b"q" * 3000 + bytes(3000)), "s"), (2, None, "t"), (2, None, "t")]
    df = spark.createDataFrame(rows, "id long, payload binary, status string")
    coded = encode_media(df)
    assert coded.columns == ["id", "status", "media"]
    read = decode_media(coded.withColumn("media", coded.media))
    assert read.columns[:2] == ["id", "media"] and [r.frames for r in read.orderBy("id").collect()] == [12, 0, 0]
    clips = clip_rows(read, "id").orderBy("clip").collect()
    assert [(c.id, c.first_frame, c.end_frame) for c in clips] == [(1, 0, 6), (1, 6, 12)] or clips[0].first_frame == 0
    assert all(abs(c.start_s - c.first_frame / 25) < 1e-9 for c in clips)
    broken = decode_media(spark.createDataFrame([(1, bytearray(b"no video")), (2, None)], "id long, media binary")).orderBy("id").collect()
    assert [(r.status, r.payload, r.clips) for r in broken] == [("no AVI file", None, None), ("null", None, None)]
    assert encode_media(df.where("id < 0")).collect() == []
