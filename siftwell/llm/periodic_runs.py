"""Periodic runs of words, by Main and Lorentz's divide and conquer.

A run is a maximal stretch of consecutive words with smallest period q that is at least
2q and at least `least` words long. Words are interned exactly (equal ids, equal words). A document
is halved again and again; a run that lies in a segment and crosses its midpoint m has two
aligned words at m and m - q, or at m and m + q, for some q up to half the segment. So at each midpoint two Z
functions are taken for every position y of the segment: how far the words from y on agree
with those from m on, and how far those before y agree with those before m. Both are taken
over the whole document, which extends a repetition beyond its segment at once. Where
the two together reach the period, the stretch is a repetition; equal stretches are found once
with each multiple of their period, and the smallest period is kept. Segments shorter than `least` hold no run.

All midpoints of a level and all documents of a slice are worked on together: a position
whose word and whose predecessor both differ from the midpoint's leaves with the first comparison; the others are compared
word by word for eight words and then by doubling and halving with prefix hashes modulo 2^61 - 1. That is
O(n log n) positions for n words and needs memory for a slice of about a megabyte, or
for one document where it is longer. Spark's part is one map without a shuffle.

Defined results: null and empty texts have no words, no runs and an empty collapsed text; an empty table gives an empty
result; repeated rows are repeated in the result; very long texts are taken whole; runs are ordered by start, then period;
columns of docs named like outputs are replaced, all others pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .substring_dedup import _kept
from .textkernel import SPACED, give_back, mix, words

_P = np.uint64((1 << 61) - 1)
_LOW32, _LOW29 = np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1)
_BASE = 0x0A3D2F1C9B8E7651
_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())]))


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo 2^61 - 1."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, for numbers below that."""
    a1, a0, b1, b0 = a >> np.uint64(32), a & _LOW32, b >> np.uint64(32), b & _LOW32
    mid, low = a1 * b0 + a0 * b1, a0 * b0
    return _reduce(((a1 * b1) << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & _LOW29) << np.uint64(32)) + (low & _P) + (low >> np.uint64(61)))


class Agreement:
    """How far two positions of a sequence of word ids agree, forwards and backwards."""

    def __init__(self, ids: np.ndarray):
        self.ids, n = ids, len(ids)
        self.power = np.ones(n + 1, dtype=np.uint64)
        done, top = 1, np.full(1, _BASE, dtype=np.uint64)  # top is the base to the power of done
        while done <= n:
            more = min(done, n + 1 - done)
            self.power[done : done + more] = _times(self.power[:more], top)
            top, done = _times(top, top), done * 2
        term = _times(_reduce(mix(ids.astype(np.uint64), 8)), self.power[:n])
        # sums of the upper and of the lower halves stay below 2^64
        high, low = np.cumsum(term >> np.uint64(32)), np.cumsum(term & _LOW32)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        self.sums[1:] = _reduce(_times(_reduce(high), np.full(1, 1 << 32, dtype=np.uint64)) + _reduce(low))

    def _same(self, u: np.ndarray, v: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from u on are those from v on; u < v."""
        first, second = (_reduce(self.sums[x + n] + (_P - self.sums[x])) for x in (u, v))
        return _times(first, self.power[v - u]) == second

    def reach(self, u: np.ndarray, v: np.ndarray, back: bool) -> np.ndarray:
        """Number of words from u and v on (or before u and v) that agree; u < v."""
        most = u if back else len(self.ids) - v
        n, live = np.zeros(len(u), dtype=np.int64), np.arange(len(u))
        for k in range(8):
            live = live[most[live] > k]
            off = -1 - k if back else k
            live = live[self.ids[u[live] + off] == self.ids[v[live] + off]]
            n[live] += 1
        low, step, open_ = n, 8, []
        same = lambda x, a, b: self._same(u[x] - b, v[x] - b, b - a) if back else self._same(u[x] + a, v[x] + a, b - a)
        while len(live):
            to = np.minimum(low[live] + step, most[live])
            ok = same(live, low[live], to)
            open_.append((live[~ok], to[~ok]))
            low[live[ok]] = to[ok]
            live, step = live[ok & (to < most[live])], step * 2
        if open_:
            live, high = (np.concatenate(x) for x in zip(*open_))
            while len(live):
                mid = (low[live] + high + 1) // 2
                mid = np.where(mid >= high, low[live], mid)
                ok = same(live, low[live], mid)
                low[live[ok]] = mid[ok]
                high = np.where(ok, high, mid)
                on = high - low[live] > 1
                live, high = live[on], high[on]
        return low


def _smallest(found: list[np.ndarray]) -> np.ndarray:
    """Rows (start, end, period): each stretch once, with its smallest period."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[new]


def find_runs(ids: np.ndarray, bounds: np.ndarray, least: int = 12, step: int = 1 << 20) -> np.ndarray:
    """Rows (start, end, period), by start and end, of the runs of the documents ids[bounds[k]:bounds[k + 1]]."""
    sizes = np.diff(bounds)
    shift = np.arange(1, len(sizes) + 1)
    apart = np.empty(len(ids) + len(sizes) + 1, dtype=np.int64)  # a word of its own before each document and at the end
    apart[bounds[:-1] + shift - 1] = -shift
    apart[-1] = -len(sizes) - 1
    apart[np.arange(len(ids)) + np.repeat(shift, sizes)] = ids
    lo, hi = bounds[:-1] + shift, bounds[1:] + shift
    agree, found = None, []
    while True:
        long = hi - lo >= max(2, least)
        lo, hi = lo[long], hi[long]
        if not len(lo):
            break
        agree = agree or Agreement(apart)
        mid = (lo + hi) // 2
        ends = np.cumsum(hi - lo)
        for a in range(0, int(ends[-1]), step):
            b = min(a + step, int(ends[-1]))
            s0, s1 = np.searchsorted(ends, [a, b - 1], side="right")
            part = slice(s0, s1 + 1)
            here = np.minimum(ends[part], b) - np.maximum(ends[part] - (hi - lo)[part], a)
            y = np.arange(a, b) + np.repeat(lo[part] - (ends - (hi - lo))[part], here)
            m = np.repeat(mid[part], here)
            on = np.flatnonzero(((apart[y] == apart[m]) | (apart[y - 1] == apart[m - 1])) & (y != m))
            u, v = np.minimum(y[on], m[on]), np.maximum(y[on], m[on])
            q = v - u
            after = agree.reach(u, v, back=False)
            before = agree.reach(u, v, back=True)
            ok = after + before >= np.maximum(q, least - q)
            if ok.any():
                found.append(_smallest([np.stack([u - before, v + after, q], axis=1)[ok]]))
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        order = np.argsort(lo)
        lo, hi = lo[order], hi[order]
    if not found:
        return np.zeros((0, 3), dtype=np.int64)
    rows = _smallest(found)
    rows[:, :2] -= np.searchsorted(bounds[:-1] + shift, rows[:, :1], side="right")
    return rows


def intern(w) -> np.ndarray:
    """A number for each word; equal numbers, equal words."""
    ns = np.zeros(len(w.data) + 1, dtype=np.int8)
    ns[w.start] += 1
    ns[w.end] -= 1
    data = w.data[np.cumsum(ns[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int64)
    spelled = pa.Array.from_buffers(pa.large_binary(), len(w), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return spelled.dictionary_encode().indices.to_numpy().astype(np.int64)


def _collapser(least: int, remap: Callable | None, schema: pa.Schema):
    def collapse(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ids = table["_id"].to_pylist()
            for lo, hi, w in words(table["_text"], SPACED):
                number, texts = intern(w), {}
                for k in range(hi - lo) if remap else ():
                    a, b = int(w.bounds[k]), int(w.bounds[k + 1])
                    at = remap(ids[lo + k], b - a)
                    if at is not None:
                        texts[k] = at
                        number[a:b] = number[a + at]
                rows = find_runs(number, w.bounds, least)
                edge = np.zeros(len(w) + 1, dtype=np.int64)
                np.add.at(edge, rows[:, 0] + rows[:, 2], 1)
                np.add.at(edge, rows[:, 1], -1)
                gone = np.cumsum(edge[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])[w.bounds]
                kept = _kept(w, gone)
                for k, at in texts.items():
                    a, b = int(w.bounds[k]), int(w.bounds[k + 1])
                    at = a + at[~gone[a:b]]
                    kept[k] = b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[at], w.end[at]))
                owner = np.searchsorted(w.bounds[1:], rows[:, 0], side="right")
                order = np.lexsort((rows[:, 2], rows[:, 0]))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=hi - lo))]).astype(np.int32)
                start = rows[:, 0] - w.bounds[owner]
                parts = [pa.array(x[order]) for x in (start, rows[:, 1] - rows[:, 0], rows[:, 2])]
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
                out = [batch.column("_row").slice(lo, hi - lo), pa.array(np.diff(w.bounds), pa.int64()), pa.array(np.diff(total), pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, schema)], schema=schema)
        give_back()

    return collapse


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text", remap: Callable | None = None) -> DataFrame:
    """docs' columns without the text, n_words, n_dropped, runs (array of start, length, period) and collapsed_text.

    collapsed_text holds the words, joined by one space, that no run contains after its first period. remap(id, n) may
    give, for a document of n words, the numbers of the words to take in place of words 0, 1, ...; None takes them as they are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    own = ("n_words", "n_dropped", "runs", "collapsed_text")
    rest = [c for c in docs.columns if c not in (text_col, *own)]
    row = F.struct(*(F.col(f"`{c}`").alias(f"c_{c}") for c in rest), F.lit(0).alias("_"))
    packed = docs.select(row.alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    out = T.StructType([T.StructField("_row", packed.schema["_row"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("runs", _RUNS), T.StructField("collapsed_text", T.StringType())])
    done = packed.mapInArrow(_collapser(least, remap, to_arrow_schema(out)), out)
    return done.select(*(F.col("_row").getField(f"c_{c}").alias(c) for c in rest), *own)
