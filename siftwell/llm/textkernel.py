"""Vectorised word kernels over Arrow string arrays.

Words are found on UTF-8 bytes (every separator is ASCII), hashed to 64 bits eight bytes
at a time, each step passing through a bijective finaliser (words of up to eight bytes and
one length never collide; a word of over 256 bytes takes a cryptographic hash), and
combined into window hashes, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U64 = (1 << 64) - 1
#: Words of more bytes are hashed one by one.
_LONG = 256
#: Masks that keep the first 0, 1, ... 8 bytes of a little-endian number.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def give_back() -> None:
    """Return freed memory to the system, so that a Python worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(work):
    """work on two tables, which gives back what it used."""

    def run(left, right):
        out = work(left, right)
        give_back()
        return out

    return run


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; different salts give independent hashes."""
    h = h + np.uint64((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & _U64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass(frozen=True)
class Alphabet:
    """Which bytes separate words, and which byte values count as equal."""

    separators: tuple[int, ...]
    lower: bool

    def luts(self) -> tuple[np.ndarray, np.ndarray]:
        value = np.arange(256, dtype=np.uint8)
        if self.lower:
            value[65:91] = value[97:123]
        is_word = np.ones(256, dtype=bool)
        is_word[list(self.separators)] = False
        return value, is_word


#: Words are runs of anything but ASCII white space.
SPACED = Alphabet((9, 10, 11, 12, 13, 32), lower=False)
SPACED_LOWER = Alphabet((9, 10, 11, 12, 13, 32), lower=True)
#: Words are runs of ASCII letters, digits and all non-ASCII bytes; case of A-Z is ignored.
ALNUM_LOWER = Alphabet(tuple(b for b in range(128) if not chr(b).isalnum()), lower=True)


class Words:
    """The words of a slice of documents.

    hash: one 64-bit value a word; stems: the same of its first bytes, for each length asked for; start, end: byte positions within data;
    bounds: for document i the words bounds[i]:bounds[i + 1]; offsets: its bytes.
    """

    __slots__ = ("data", "offsets", "hash", "stems", "start", "end", "bounds")

    def __init__(self, data, offsets, value, is_word, stems=()):
        self.data, self.offsets = data, offsets
        ns = is_word[data]
        first, last = ns.copy(), ns.copy()
        first[1:] &= ~ns[:-1]
        last[:-1] &= ~ns[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = ns[cuts]
        last[cuts - 1] = ns[cuts - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        folded = np.zeros(len(data) + 8, dtype=np.uint8)
        folded[: len(data)] = value[data]
        self.hash = span_hash(folded, self.start, self.end)
        self.stems = [span_hash(folded, self.start, np.minimum(self.end, self.start + size)) for size in stems]

    def __len__(self) -> int:
        return len(self.hash)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    @property
    def left(self) -> np.ndarray:
        """Words from each word to its document's end, itself included."""
        return np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self.hash))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; data has eight spare bytes at its end."""
    n = end - start
    h = mix(n.astype(np.uint64), 76)
    eight = np.ndarray((max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))
    live, at = np.flatnonzero((n > 0) & (n <= _LONG)), 0
    while len(live):
        h[live] = mix(h[live] ^ (eight[start[live] + at] & _FIRST[np.minimum(n[live] - at, 8)]), 77)
        at += 8
        live = live[n[live] > at]
    for k in np.flatnonzero(n > _LONG):
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]], digest_size=8).digest(), "little")
    return h


def slices(texts, limit: int = 1 << 20):
    """(from, to, data, offsets) for runs of rows of at most limit bytes, or of one row; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    _, off, raw = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(texts, alphabet: Alphabet, limit: int = 1 << 20, stems: tuple[int, ...] = ()):
    """(from, to, Words) for the slices of an Arrow string array; stems: bytes of a word's stems."""
    value, is_word = alphabet.luts()
    for lo, hi, data, offsets in slices(texts, limit):
        yield lo, hi, Words(data, offsets, value, is_word, stems)


def window_hash(h: np.ndarray, size: int, salt: int = 0, mask: tuple[int, ...] | None = None, step: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hash of every size consecutive words (of the positions in mask alone); one value less size - 1 than words. Another odd step gives an independent hash."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for k in mask or range(size):
        acc += h[k : k + n] * np.uint64(pow(step, k + 1, 1 << 64))
    return mix(acc, salt + 1)


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values the sorted table holds."""
    if not len(table) or not len(values):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values
