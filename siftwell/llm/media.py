"""Media columns: AVI files of motion-JPEG frames in a binary column.

`encode_avi` stores a payload without loss as a gray video that any player shows: a byte is the
sample of an 8 x 8 block, whose cosine transform is one DC coefficient (quantised by 8, so exact) and
no other. The Huffman tables of each frame give a DC difference of k bits a code of 11 - k bits and the end of
a block one bit, so that a block takes 12 bits and frames are coded and decoded by array operations.
`decode_avi` reads the RIFF lists and the index (or walks the frames where there is none), and decodes
intra frames: frames whose blocks all have one size as above by arrays, other baseline frames of
one component code by code. `detect_shots` cuts where the difference of two frames' histograms
exceeds what the frames before it make likely: mean and deviation of a trailing window and a floor.

In Spark, `encode_media` and `decode_media` are maps without a shuffle, each over batches of bounded bytes;
`clip_rows` explodes the shots into a row for each clip, with its times.

Defined results: a null payload is an empty one; an empty payload is a video of no frames; media that are null or
no such video give a status other than "ok" and nulls; very long payloads become long videos;
an empty table gives an empty result; repeated rows are repeated; columns named like outputs are replaced, all others pass through.
"""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import give_back

#: Blocks of a frame across and down, and frames a second.
ACROSS, DOWN, RATE = 32, 16, 25
_FRAME = ACROSS * DOWN
_BINS = 32
#: Row by row order of the coefficients of a block, which come in zigzags.
_ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
_COS = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
_INDEX = np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
CLIP = "clip int, first_frame int, end_frame int, start_s double, end_s double, mean_luma double"


class MediaError(ValueError):
    """Bytes that are not a video of the supported kind."""


def _codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code, length), codes being given in order of length."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at, code = at + n, code << 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


_DC_COUNTS, _DC_SYMBOLS = [0, 0] + [1] * 9 + [0] * 5, list(range(8, -1, -1))
_HEAD = b"".join([
    b"\xff\xd8",
    _segment(0xDB, bytes([0, 8] + [1] * 63)),
    _segment(0xC0, struct.pack(">BHHB", 8, DOWN * 8, ACROSS * 8, 1) + bytes([1, 0x11, 0])),
    _segment(0xC4, bytes([0x00, *_DC_COUNTS, *_DC_SYMBOLS])),
    _segment(0xC4, bytes([0x10, 1] + [0] * 15 + [0])),
    _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
])


def _words_of(dc: dict[int, tuple[int, int]], end: tuple[int, int]) -> np.ndarray:
    """What a block of each DC difference from -255 to 255 is coded as."""
    out = []
    for d in range(-255, 256):
        k = abs(d).bit_length()
        out.append(((dc[k][0] << k | (d if d >= 0 else d + (1 << k) - 1)) << end[1]) | end[0])
    return np.array(out, dtype=np.uint16)


_WORDS = _words_of(_codes(_DC_COUNTS, _DC_SYMBOLS), (0, 1))


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode_avi(payload: bytes) -> bytes:
    """The payload as a video; equal payloads give equal files."""
    frames = -(-len(payload) // _FRAME)
    samples = np.zeros(frames * _FRAME, dtype=np.int16)
    samples[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    samples = samples.reshape(frames, _FRAME) - 128
    step = np.diff(samples, axis=1, prepend=np.int16(0))
    word = _WORDS[step + 255].reshape(-1, 2)
    packed = np.empty((len(word), 3), dtype=np.uint8)
    packed[:, 0], packed[:, 1], packed[:, 2] = word[:, 0] >> 4, (word[:, 0] & 15) << 4 | word[:, 1] >> 8, word[:, 1] & 255
    packed = packed.ravel()
    full = packed == 255  # a byte of ones is followed by one of zeros
    places = np.cumsum(full, dtype=np.int64) + np.arange(1, len(packed) + 1) if frames else np.zeros(0, np.int64)
    stuffed = np.zeros(int(places[-1]) if frames else 0, dtype=np.uint8)
    stuffed[places - 1 - full] = packed
    ends = places.reshape(frames, -1)[:, -1].tolist() if frames else []
    data, lo, movi, index, at = stuffed.tobytes(), 0, [b"movi"], [], 4
    for hi in ends:
        size = len(_HEAD) + hi - lo + 2
        movi += [b"00dc", struct.pack("<I", size), _HEAD, data[lo:hi], b"\xff\xd9", b"\0" * (size % 2)]
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, size))
        at, lo = at + 8 + size + size % 2, hi
    largest = max((x[1] for x in struct.iter_unpack("<12sI", b"".join(index))), default=0)
    main = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, frames, 0, 1, largest, ACROSS * 8, DOWN * 8, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, frames, largest, 0xFFFFFFFF, 0, 0, 0, ACROSS * 8, DOWN * 8)
    image = struct.pack("<IiiHH4sIiiII", 40, ACROSS * 8, DOWN * 8, 1, 24, b"MJPG", ACROSS * DOWN * 192, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", image)))
    note = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    return _chunk(b"RIFF", b"AVI " + header + note + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


@dataclass(frozen=True)
class FrameHead:
    """What the segments before a frame's scan say. even: bits of a block where all have as many, and what they mean."""

    width: int
    height: int
    quant: np.ndarray
    dc: dict[int, tuple[int, int]]
    ac: dict[int, tuple[int, int]]
    restart: int
    even: tuple[int, np.ndarray] | None


@functools.lru_cache(maxsize=256)
def _frame_head(head: bytes) -> FrameHead:
    at, quants, tables, size, restart, scan = 2, {}, {}, None, 0, None
    while at + 4 <= len(head):
        marker, n = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        body, at = head[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                tables[body[0]] = _codes(counts, list(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == 0xC0:
            if body[0] != 8 or body[5] != 1:
                raise MediaError("frames of one component and eight bits are supported")
            size = struct.unpack(">HH", body[1:5]) + (body[8],)
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise MediaError("baseline frames are supported")
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            scan = body
    if size is None or scan is None or size[2] not in quants:
        raise MediaError("a frame lacks a table")
    dc, ac = tables.get(scan[2] >> 4), tables.get(0x10 | scan[2] & 15)
    if not dc or not ac:
        raise MediaError("a frame lacks a table")
    even, lengths = None, {n + k for k, (_, n) in dc.items()}
    if len(lengths) == 1 and set(ac) == {0} and (bits := lengths.pop() + ac[0][1]) == 12 and not restart:
        meaning = np.full(1 << bits, 1 << 14, dtype=np.int32)  # a code that is not given stands for no difference
        end, tail = ac[0]
        for k, (code, _) in dc.items():
            value = np.arange(1 << k)
            value = np.where(value >> max(k - 1, 0) > 0, value, value - (1 << k) + 1) if k else value
            meaning[((code << k | np.arange(1 << k)) << tail) | end] = value
        even = bits, meaning
    return FrameHead(size[1], size[0], quants[size[2]], dc, ac, restart, even)


def _split_frame(jpeg: bytes) -> tuple[FrameHead, bytes]:
    """A frame's head, and its scan's bytes."""
    if jpeg[:2] != b"\xff\xd8":
        raise MediaError("no start of a frame")
    at = 2
    while True:
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            raise MediaError("a frame is cut short")
        marker, at = jpeg[at + 1], at + 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big")
        if marker == 0xDA:
            break
    end = jpeg.rfind(b"\xff\xd9")
    return _frame_head(jpeg[:at]), jpeg[at : end if end >= at else len(jpeg)]


def _coefficients(head: FrameHead, scan: bytes) -> np.ndarray:
    """The quantised coefficients of each block, code by code."""
    blocks = -(-head.width // 8) * -(-head.height // 8)
    dc, ac = ({(n, code): s for s, (code, n) in t.items()} for t in (head.dc, head.ac))
    out, parts = np.zeros((blocks, 64), dtype=np.int64), [scan]
    if head.restart:
        parts, lo = [], 0
        for k in range(len(scan) - 1):
            if scan[k] == 0xFF and 0xD0 <= scan[k + 1] <= 0xD7:
                parts.append(scan[lo:k])
                lo = k + 2
        parts.append(scan[lo:])
    done = 0
    for part in parts:
        bits = "".join(f"{x:08b}" for x in part.replace(b"\xff\x00", b"\xff"))
        at = last = 0

        def symbol(table):
            nonlocal at
            for n in range(1, 17):
                if at + n <= len(bits) and (s := table.get((n, int(bits[at : at + n], 2)))) is not None:
                    at += n
                    return s
            raise MediaError("a frame holds a code that its tables lack")

        def number(k):
            nonlocal at
            if at + k > len(bits):
                raise MediaError("a frame is cut short")
            x, at = int(bits[at : at + k], 2) if k else 0, at + k
            return x if not k or x >> (k - 1) else x - (1 << k) + 1

        for b in range(done, min(blocks, done + (head.restart or blocks))):
            last += number(symbol(dc))
            out[b, 0], k = last, 1
            while k < 64:
                s = symbol(ac)
                if s == 0:
                    break
                k += s >> 4
                if s & 15 and k < 64:
                    out[b, k] = number(s & 15)
                k += 1
        done += head.restart or blocks
    return out


def _samples(head: FrameHead, coefficients: np.ndarray) -> np.ndarray:
    """The samples of each block (blocks, 8, 8)."""
    plain = np.zeros((len(coefficients), 64))
    plain[:, _ZIGZAG] = coefficients * head.quant
    return np.clip(np.rint(_COS.T @ plain.reshape(-1, 8, 8) @ _COS + 128), 0, 255).astype(np.uint8)


@dataclass
class Video:
    """rate: frames a second; means: the mean sample of each block of each frame; histograms: shares of samples by bin; payload_bytes: of a payload stored here, else None."""

    rate: float
    width: int
    height: int
    means: np.ndarray
    histograms: np.ndarray
    payload_bytes: int | None

    @property
    def payload(self) -> bytes | None:
        return None if self.payload_bytes is None else self.means.tobytes()[: self.payload_bytes]


def _lists(media: bytes, lo: int, hi: int):
    """(name, body's start, body's end) of the chunks; a LIST by the name of what it holds."""
    while lo + 8 <= hi:
        name, size = media[lo : lo + 4], int.from_bytes(media[lo + 4 : lo + 8], "little")
        end = min(hi, lo + 8 + size)
        if name == b"LIST":
            yield media[lo + 8 : lo + 12], lo + 12, end
        else:
            yield name, lo + 8, end
        lo += 8 + size + size % 2


def _frame_places(media: bytes, movi: tuple[int, int], index: tuple[int, int] | None) -> list[tuple[int, int]]:
    """Start and end of each video frame, by the index; its offsets count from the list's name or from the file's start."""
    if index is None:
        return [(a, b) for name, a, b in _lists(media, *movi) if name[2:] in (b"dc", b"db")]
    rows = np.frombuffer(media, dtype=_INDEX, count=(index[1] - index[0]) // 16, offset=index[0])
    rows = rows[np.isin(rows["id"], [b"00dc", b"00db"])]
    if not len(rows):
        return []
    base = movi[0] - 4 if media[movi[0] - 4 + int(rows["at"][0]) :][:4] == rows["id"][0] else 0
    start = rows["at"].astype(np.int64) + base + 8
    if (start + rows["size"] > len(media)).any():
        raise MediaError("the index points behind the file's end")
    return list(zip(start.tolist(), (start + rows["size"]).tolist()))


def decode_avi(media: bytes) -> Video:
    """Frames of a motion-JPEG AVI; raises MediaError on anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise MediaError("no AVI file")
    found = {name: (a, b) for name, a, b in _lists(media, 12, len(media))}
    if b"hdrl" not in found or b"movi" not in found:
        raise MediaError("the file lacks a list")
    rate, size = 0.0, None
    for name, a, b in _lists(media, *found[b"hdrl"]):
        if name == b"strl" and not size:
            parts = {n: media[x:y] for n, x, y in _lists(media, a, b)}
            stream, image = parts.get(b"strh", b""), parts.get(b"strf", b"")
            if stream[:4] == b"vids" and len(stream) >= 28 and len(image) >= 20:
                scale, per = struct.unpack("<II", stream[20:28])
                rate, size = per / max(1, scale), struct.unpack("<ii", image[4:12])
                if image[16:20].upper() != b"MJPG":
                    raise MediaError("the frames are not motion-JPEG")
    if not size:
        raise MediaError("the file has no video stream")
    note = {n: media[a:b] for n, a, b in _lists(media, *found[b"INFO"])}.get(b"ICMT", b"") if b"INFO" in found else b""
    stored = int(note[8:].rstrip(b"\0")) if note.startswith(b"payload=") else None
    places = _frame_places(media, found[b"movi"], found.get(b"idx1"))
    heads, scans = [], []
    for a, b in places:
        head, scan = _split_frame(media[a:b])
        heads.append(head)
        scans.append(scan.replace(b"\xff\x00", b"\xff") if head.even else scan)
    if heads and any(h is not heads[0] and (h.width, h.height) != (heads[0].width, heads[0].height) for h in heads):
        raise MediaError("frames differ in size")
    blocks = -(-heads[0].width // 8) * -(-heads[0].height // 8) if heads else 0
    if stored is not None and stored > len(heads) * blocks:
        raise MediaError("frames are missing")
    means, shares = np.zeros((len(heads), blocks), np.uint8), np.zeros((len(heads), _BINS))
    even = [k for k, h in enumerate(heads) if h is heads[0] and h.even and blocks % 2 == 0]
    if even:
        raw = b"".join(scans[k] for k in even)
        if any(len(scans[k]) != blocks * 12 // 8 for k in even):
            raise MediaError("a frame is cut short")
        x = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        word = np.stack([x[:, 0] << 4 | x[:, 1] >> 4, (x[:, 1] & 15) << 8 | x[:, 2]], axis=1).reshape(len(even), blocks)
        step = heads[0].even[1][word]
        if (step == 1 << 14).any():
            raise MediaError("a frame holds a code that its tables lack")
        value = np.cumsum(step, axis=1) * heads[0].quant[0] / 8 + 128
        means[even] = np.clip(np.rint(value), 0, 255)
        bins = (means[even] >> 3).astype(np.int64) + np.arange(len(even))[:, None] * _BINS
        shares[even] = np.bincount(bins.ravel(), minlength=len(even) * _BINS).reshape(-1, _BINS) / max(1, blocks)
    for k in set(range(len(heads))) - set(even):
        pixels = _samples(heads[k], _coefficients(heads[k], scans[k]))
        means[k] = np.rint(pixels.mean(axis=(1, 2)))
        shares[k] = np.bincount((pixels >> 3).ravel(), minlength=_BINS) / pixels.size
    return Video(rate, heads[0].width if heads else size[0], heads[0].height if heads else size[1], means, shares, stored)


def detect_shots(histograms: np.ndarray, window: int = 8, deviations: float = 3.0, floor: float = 0.1) -> np.ndarray:
    """The first frames of the shots: 0, and each frame whose histogram differs more than the window before it lets expect."""
    n = len(histograms)
    if n < 2:
        return np.arange(n)
    d = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    sums, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (d, d * d))
    at = np.arange(n - 1)
    lo = np.maximum(0, at - window)
    many = np.maximum(1, at - lo)
    mean = (sums[at] - sums[lo]) / many
    spread = np.sqrt(np.maximum(0, (squares[at] - squares[lo]) / many - mean * mean))
    limit = np.where(at == 0, 0.5, mean + deviations * spread + floor)
    return np.concatenate([[0], np.flatnonzero(d > limit) + 1])


def clips_of(video: Video) -> list[tuple]:
    """A row for each shot, as CLIP says."""
    first = detect_shots(video.histograms)
    ends = np.append(first[1:], len(video.means))
    luma = video.means.mean(axis=1) if len(video.means) else np.zeros(0)
    rate = video.rate or 1.0
    return [(k, int(a), int(b), a / rate, b / rate, round(float(luma[a:b].mean()), 3)) for k, (a, b) in enumerate(zip(first.tolist(), ends.tolist()))]


def _pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """The batch in runs of rows whose column has at most limit bytes, or of one row."""
    x = batch.column(column)
    size = np.concatenate([[0], np.cumsum(pa.compute.binary_length(x).fill_null(0).to_numpy(zero_copy_only=False))])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _mapper(work, schema: pa.Schema):
    """work on each value of _in; what it returns follows _row."""

    def run(batches):
        for batch in batches:
            for part in _pieces(batch, "_in"):
                made = [work(x.as_py()) for x in part.column("_in")]
                columns = [pa.array(x, f.type) for x, f in zip(zip(*made), list(schema)[1:])]
                yield pa.RecordBatch.from_arrays([part.column("_row").cast(schema[0].type), *columns], schema=schema)
        give_back()

    return run


def _with_outputs(df: DataFrame, column: str, gone: str | None, work, added: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    more = T.StructType.fromDDL(added)
    rest = [c for c in df.columns if c != gone and c not in more.names]
    packed = df.select(F.struct(*(F.col(f"`{c}`").alias(f"c_{c}") for c in rest), F.lit(0).alias("_")).alias("_row"), F.col(f"`{column}`").cast("binary").alias("_in"))
    out = T.StructType([packed.schema["_row"], *more.fields])
    done = packed.mapInArrow(_mapper(work, to_arrow_schema(out)), out)
    return done.select(*(F.col("_row").getField(f"c_{c}").alias(c) for c in rest), *more.names)


def encode_media(df: DataFrame, payload_col: str = "payload") -> DataFrame:
    """df's columns without the payload, and media: the payload as a video."""
    return _with_outputs(df, payload_col, payload_col, lambda x: (encode_avi(x or b""),), "media binary")


def _read(media: bytes | None) -> tuple:
    if media is None:
        return ("null", *(None,) * 6)
    try:
        video = decode_avi(media)
    except (MediaError, struct.error, IndexError, ValueError) as e:
        return (str(e)[:200] or "broken", *(None,) * 6)
    return ("ok", video.rate, video.width, video.height, len(video.means), video.payload, clips_of(video))


def decode_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df's columns with status, rate, width, height, frames, payload (null where none is stored) and clips of the videos in media_col."""
    return _with_outputs(df, media_col, None, _read, f"status string, rate double, width int, height int, frames int, payload binary, clips array<struct<{', '.join(x.replace(' ', ': ') for x in CLIP.split(', '))}>>")


def clip_rows(decoded: DataFrame, *keep: str) -> DataFrame:
    """A row for each clip of decode_media's rows: the columns to keep, and CLIP's."""
    return decoded.select(*keep, F.explode("clips").alias("_clip")).select(*keep, "_clip.*")
