"""Conflict-constrained best-fit packing.

Documents go into bins of `capacity` words, largest first. No bin holds two
documents of one source or of one duplicate cluster. Bins are ordered by residual
and carry bitmaps of their sources and clusters; the successor search starts at the
least residual that fits and goes on until it meets a compatible bin, which is the
tightest one. For every bit the number of bins that lack it is kept per residual,
so residuals where all bins conflict are passed over at once, however
frequent a source or cluster is. Keys beyond the bitmaps' width are checked on the
bin's own set, so the result is exact for any number of keys.

Packing is sequential within a shard of about `shard_rows` documents, dealt by a
hash; shards are independent, so a hot source or cluster is spread over all.

Defined results: a document of more words than the capacity is cut into full pieces, each a
bin of its own, and a last piece that is packed; one without words (null or
empty text) has one piece of 0 words and no bin; a null source conflicts
with nothing; ties go by id, then by row; repeated rows are documents of one cluster and one source, so each has a
bin of its own, and all go to one shard; an empty table gives an empty result; columns of docs other than id, text and
source are dropped, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import SPACED_LOWER, mix, words

_BITS = 62
_OUT_PA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("n_words", pa.int64()), ("bin_id", pa.int64()), ("bin_offset", pa.int64())])


class BestFit:
    """Open bins of one shard. keys of a document: at most one source key and one cluster key."""

    def __init__(self, capacity: int, frequent: list):
        self.capacity = capacity
        self.bit = {k: b for b, k in enumerate(frequent[:_BITS])}
        self.lack = np.zeros((len(self.bit) + 1, capacity + 1), dtype=np.int64)  # the last row counts all bins
        self.at: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.rare: list[set] = []

    def _count(self, residual: int, mask: int, step: int) -> None:
        rows = [b for b in range(len(self.bit)) if not mask >> b & 1]
        self.lack[rows, residual] += step
        self.lack[-1, residual] += step

    def place(self, size: int, keys: tuple) -> tuple[int, int]:
        """(bin, words already in it)"""
        bits = [self.bit[k] for k in keys if k in self.bit]
        rare = {k for k in keys if k not in self.bit}
        mask, open_ = sum(1 << b for b in bits), self.lack[-1, size:] > 0
        for b in bits:
            open_ &= self.lack[b, size:] > 0
        for residual in (np.flatnonzero(open_) + size).tolist():
            for held, bins in self.at[residual].items():
                if held & mask:
                    continue
                for k in range(len(bins) - 1, -1, -1):
                    if not rare or self.rare[bins[k]].isdisjoint(rare):
                        found = bins.pop(k)
                        if not bins:
                            del self.at[residual][held]
                        self._count(residual, held, -1)
                        self._put(found, residual - size, held | mask, rare)
                        return found, self.capacity - residual
        self.rare.append(set())
        self._put(len(self.rare) - 1, self.capacity - size, mask, rare)
        return len(self.rare) - 1, 0

    def _put(self, found: int, residual: int, mask: int, rare: set) -> None:
        self.rare[found] |= rare
        self.at[residual].setdefault(mask, []).append(found)
        self._count(residual, mask, 1)


def _packer(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        docs = sorted(zip(table["doc_id"].to_pylist(), table["source"].to_pylist(), table["cluster"].to_pylist(), table["n_words"].to_pylist()), key=lambda d: (-(d[3] % capacity), d[0] is None, d[0] or 0, d[1] or "", d[3]))
        several = Counter(c for _, _, c, n in docs if n)
        keys = Counter(s for _, s, _, n in docs if n and s is not None) + Counter({c: k for c, k in several.items() if k > 1})
        bins, full, out = BestFit(capacity, [k for k, _ in keys.most_common(_BITS)]), 0, []
        for doc, source, cluster, n in docs:
            for k in range(n // capacity):
                full += 1
                out.append((doc, k, capacity, (shard << 32) + (1 << 31) + full, 0))
            if n % capacity:
                got = bins.place(n % capacity, tuple(k for k in (source, cluster if several[cluster] > 1 else None) if k is not None))
                out.append((doc, n // capacity, n % capacity, (shard << 32) + got[0], got[1]))
            elif not n:
                out.append((doc, 0, 0, None, None))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out), _OUT_PA)], schema=_OUT_PA)

    return pack


def _measure(batches):
    for batch in batches:
        size, cluster = [], []
        for _, _, w in words(batch.column(2), SPACED_LOWER):
            size.append(np.diff(w.bounds))
            place = np.arange(len(w)) - np.repeat(w.bounds[:-1], size[-1])
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(w.hash + mix(place.astype(np.uint64), 8), 9))])
            cluster.append((total[w.bounds[1:]] - total[w.bounds[:-1]]).view(np.int64))
        size = np.concatenate(size) if size else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(np.concatenate(cluster) if cluster else size, pa.int64())], names=["doc_id", "source", "n_words", "cluster"])


def best_fit_pack(docs: DataFrame, capacity: int = 2048, shard_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, piece, n_words, bin_id, bin_offset), a row for each piece of each document.

    Words are split at ASCII white space; documents of the same words, A-Z lower-cased, are a duplicate cluster.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    shards = max(1, -(-plain.count() // shard_rows))
    sized = plain.mapInArrow(_measure, "doc_id long, source string, n_words long, cluster long")
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "n_words"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_packer(capacity), "doc_id long, piece int, n_words long, bin_id long, bin_offset long")
