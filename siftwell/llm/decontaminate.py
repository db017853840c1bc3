"""Benchmark decontamination by spaced-seed hashing.

Fixed masks hash some positions of a span of words and ignore the others, so a
hit survives substitutions at the ignored positions. Hits between training and
test hashes give diagonals (a document, an item, an offset); on each the words
are compared one by one, and the document is contaminated if `window` words in a
row hold at most `max_substitutions` that differ. The masks of a window are such that each
placement of the substitutions leaves some mask a shift that avoids them all (`masks_for`),
so nothing that meets the definition is missed.

The benchmark's hash tables are files of sorted arrays, each of at most `slice_bytes` of
benchmark text, that Spark sends to each machine once and all its workers map: one pass over the
documents serves all of them, and a worker holds pages of one at a time. Documents are never
shuffled; contaminated ones meet only their own hits. Diagonals are made from hits only
where these are few; where a document and an item repeat the same words over and over, all
their diagonals are compared at once, which takes the product of their lengths and no memory.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
Defined results: null or empty texts are clean; an item of `min_item_words` words or more but fewer than
`window` counts where all of it occurs with at most its share of `max_substitutions` (rounded down)
changed, and a shorter one where all of it occurs unchanged; without `short_items` the first must be
unchanged and the second never counts; an empty benchmark leaves all clean; an empty table of documents gives an empty result; repeated items are
reported under each of their ids; repeated rows are all reported; very long texts are searched whole; a column of docs named
items is replaced, all others pass through unchanged, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import mapped_arrays, ship_arrays, text_bytes, with_text
from .textkernel import ALNUM_LOWER, give_back, window_hash, words

#: Positions that each mask reads.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
_BITS = 22


def mask_span(mask: tuple[int, ...]) -> int:
    return mask[-1] + 1


def masks_cover(masks=MASKS, window: int = 13, substitutions: int = 2) -> bool:
    """Whether each placement of the substitutions leaves some mask a shift that avoids them all."""
    from itertools import combinations

    return all(any(not set(lost) & {s + k for k in m} for m in masks for s in range(window - mask_span(m) + 1)) for lost in combinations(range(window), substitutions))


def masks_for(window: int, substitutions: int) -> tuple[tuple[int, ...], ...]:
    """Masks that miss no window: MASKS where they do, else one run of words, as long as always stays unchanged somewhere."""
    if substitutions < 0 or substitutions >= window:
        raise ValueError("substitutions must be fewer than the window's words")
    if substitutions <= 2 and window >= 13:  # MASKS cover 13 words and two of them, hence all windows that hold such
        return MASKS
    return (tuple(range(window // (substitutions + 1))),)


def seed_arrays(ids: list[int], texts: list[str | None], window: int, min_item_words: int, max_substitutions: int = 2, short_items: bool = True) -> dict[str, np.ndarray]:
    """The items' words and the sorted hashes of their seeds."""
    hashes, bounds = [], [0]
    for _, _, w in words(pa.array(texts, pa.large_string()), ALNUM_LOWER):
        hashes.append(w.hash)
        bounds += (w.bounds[1:] + bounds[-1]).tolist()
    h, bounds, seeds, short = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.array(bounds), [], set()
    count = np.diff(bounds)
    long, end = np.repeat(count >= window, count), np.repeat(bounds[1:], count)
    for m, mask in enumerate(masks_for(window, max_substitutions)):
        span = mask_span(mask)
        key = window_hash(h, span, 60 + m, mask)
        at = np.flatnonzero((np.arange(len(key)) + span <= end[: len(key)]) & long[: len(key)])
        seeds.append((key[at], at))
    lost = [max_substitutions if size >= window else max_substitutions * size // window if short_items and size >= min_item_words else 0 for size in range(window + 1)]
    for size in range(1 if short_items else min_item_words, window):
        at = bounds[:-1][count == size]
        # of one part more than words may differ, one is unchanged
        for part in np.array_split(np.arange(size), lost[size] + 1) if len(at) else []:
            seeds.append((window_hash(h, len(part), 100 + len(part))[at + part[0]], at + part[0]))
            short.add(len(part))
    key, at = (np.concatenate(x) for x in zip(*seeds))
    order = np.lexsort((at, key))
    maybe = np.zeros(1 << _BITS, dtype=bool)
    maybe[(key >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return {"hash": h, "bounds": bounds.astype(np.int64), "ids": np.array(ids, dtype=np.int64), "key": key[order], "at": at[order].astype(np.int64), "maybe": maybe, "lost": np.array(lost), "short": np.array(sorted(short), dtype=np.int64)}


class SeedTable:
    """Hashes of the benchmark items' seeds, with the items' words, over plain arrays."""

    def __init__(self, arrays: dict[str, np.ndarray], window: int, max_substitutions: int):
        self.__dict__.update(arrays)
        masks = masks_for(window, max_substitutions)
        self.window, self.few = window, 64
        self.seeds = [*((mask_span(m), 60 + k, m) for k, m in enumerate(masks)), *((size, 100 + size, None) for size in self.short.tolist())]

    def found(self, w) -> set[tuple[int, int]]:
        """(document, item) of a slice's words for all that a document repeats."""
        hits, left = [], w.left
        for span, salt, mask in self.seeds:
            h = window_hash(w.hash, span, salt, mask)
            at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            at = at[left[at] >= span]
            lo = np.searchsorted(self.key, h[at], side="left")
            hit = lo < len(self.key)
            hit[hit] = self.key[lo[hit]] == h[at][hit]
            at, lo = at[hit], lo[hit]
            hits.append((at, lo, np.searchsorted(self.key, h[at], side="right") - lo))
        at, lo, n = (np.concatenate(x) for x in zip(*hits))
        if not len(at):
            return set()
        doc = np.searchsorted(w.bounds, at, side="right") - 1
        # how many hits each document has with each item: of a document's equal seeds one is looked up
        seed, of, times = np.unique(np.stack([doc, lo, n], axis=1), axis=0, return_inverse=True, return_counts=True)
        out, cuts = set(), np.concatenate([[0], np.flatnonzero(np.diff(seed[:, 0])) + 1, [len(seed)]])
        order = np.argsort(of.ravel(), kind="stable")
        ends = np.concatenate([[0], np.cumsum(times)])
        for a, b in zip(cuts[:-1], cuts[1:]):
            d = int(seed[a, 0])
            held = {}
            for k in range(a, b):
                there = self.at[seed[k, 1] : seed[k, 1] + seed[k, 2]]
                item, first = np.unique(np.searchsorted(self.bounds, there, side="right") - 1, return_index=True)
                for i, x, y in zip(item.tolist(), first.tolist(), [*first.tolist()[1:], len(there)]):
                    held.setdefault(i, []).append((k, there[x:y]))
            out |= {(d, i) for i, own in held.items() if self._repeats(w, d, i, [(at[order[ends[k] : ends[k + 1]]], there) for k, there in own])}
        return out

    def _repeats(self, w, doc: int, item: int, hits: list[tuple[np.ndarray, np.ndarray]]) -> bool:
        lo, hi, size = int(w.bounds[doc]), int(w.bounds[doc + 1]), int(self.bounds[item + 1] - self.bounds[item])
        own, window = self.hash[self.bounds[item] : self.bounds[item + 1]], min(self.window, size)
        need = window - int(self.lost[window])
        if sum(len(a) * len(b) for a, b in hits) <= hi - lo + size:
            starts = np.unique(np.concatenate([(a[:, None] - (b - self.bounds[item])[None, :]).ravel() for a, b in hits]))
            if len(starts) <= self.few:
                return any(self._agree(w.hash, own, int(s), lo, hi, window) >= need for s in starts)
        # all diagonals at once: after item place k, total[p - j + size - 1] counts agreements of text place p with the last `window` item places j
        text = w.hash[lo:hi]
        total = np.zeros(hi - lo + size, dtype=np.int32)
        for k in range(size):
            at = size - 1 - k
            total[at : at + hi - lo] += text == own[k]
            if k >= window:
                total[at + window : at + window + hi - lo] -= text == own[k - window]
            # windows that lie within the text
            if k >= window - 1 and (total[at + window - 1 : at + hi - lo] >= need).any():
                return True
        return False

    def _agree(self, text, own, start: int, lo: int, hi: int, window: int) -> int:
        """The most words that agree within a window of this diagonal."""
        a, b = max(start, lo), min(start + len(own), hi)
        if b - a < window:
            return -1
        total = np.concatenate([[0], np.cumsum(text[a:b] == own[a - start : b - start])])
        return int((total[window:] - total[:-window]).max())


def _matcher(files: list[str], window: int, max_substitutions: int, text: str):
    def match(batches):
        for batch in batches:
            items = [set() for _ in range(batch.num_rows)]
            for file in files:
                seeds = SeedTable(mapped_arrays(file), window, max_substitutions)
                for lo, _, w in words(batch.column(0).field(text), ALNUM_LOWER):
                    for doc, item in seeds.found(w):
                        items[lo + doc].add(int(seeds.ids[item]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))], names=["_row", "items"])
        give_back()

    return match


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_substitutions: int = 2, min_item_words: int = 8, slice_bytes: int = 16 << 20, text_col: str = "text", short_items: bool = True) -> DataFrame:
    """docs with a column items: the sorted ids of the benchmark items that each document repeats."""
    spark = docs.sparkSession
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    slices, files = max(1, -(-text_bytes(wanted) // slice_bytes)), []
    for k in range(slices):
        part = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).orderBy("item_id", "text").toArrow()
        files.append(ship_arrays(spark, "seeds", seed_arrays(part["item_id"].to_pylist(), part["text"].to_pylist(), window, min_item_words, max_substitutions, short_items)))
    kept = [c for c in docs.columns if c != "items"]
    packed, text = with_text(docs, kept, text_col)
    found = packed.mapInArrow(_matcher(files, window, max_substitutions, text), packed.select("_row").schema.add("items", T.ArrayType(T.LongType())))
    return found.select(*(F.col("_row").getField(f"c_{c}").alias(c) for c in kept), "items")
