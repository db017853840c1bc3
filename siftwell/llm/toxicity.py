"""Toxicity scoring by FTRL-proximal logistic regression.

Features are the presence of hashed word n-grams (one and two words) and
skip-grams (two words around a gap); single words count by their stems (first
bytes) as well, which gathers inflected forms. Per-coordinate learning rates and the L1
term leave few non-zero weights, which are broadcast: at most 2 ** bits of them,
whatever the corpus. Scoring is one map over whole texts without a shuffle.

The fit reads a bounded sample: the `train_rows` labelled rows with the smallest
hash of their id (all of them where there are fewer).

Defined results: null and empty texts have no features and score as the bias
alone; labels that are null are left out; of several labels of one id the largest
counts; a null id is scored, with a null held_out; repeated rows are all scored, and of those of one id and
text one is fitted on; very long texts are scored whole; an empty table gives an empty result, and without labelled
rows every score is 0.5; a column of docs named toxicity is replaced, all others pass through, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import with_text
from .textkernel import ALNUM_LOWER, give_back, mix, window_hash, words


@dataclass(frozen=True)
class FTRL:
    """Hyper-parameters; bits: the weight vector has 2 ** bits coordinates."""

    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.01
    epochs: int = 10
    stems: tuple[int, ...] = (4, 6)
    train_rows: int = 8192
    gaps: tuple[int, ...] = (2, 3)


def _features(w, bits: int, gaps: tuple[int, ...]):
    """(document, coordinate) arrays of all n-grams and skip-grams, kind by kind."""
    doc, left, shift = w.doc, w.left, np.uint64(64 - bits)
    for salt, (size, mask) in enumerate([(1, None), (2, None), *((g + 1, (0, g)) for g in gaps)]):
        h = window_hash(w.hash, size, 40 + salt, mask)
        at = np.flatnonzero(left[: len(h)] >= size)
        yield doc[at], (h[at] >> shift).astype(np.int64)
    for size, stem in enumerate(w.stems):
        yield doc, (mix(stem, 39 - size) >> shift).astype(np.int64)


def _extractor(p: FTRL):
    def extract(batches):
        for batch in batches:
            blobs = []
            for lo, hi, w in words(batch.column(2), ALNUM_LOWER, stems=p.stems):
                doc, at = (np.concatenate(x) for x in zip(*_features(w, p.bits, p.gaps)))
                both = np.unique((doc << p.bits) | at)
                cut = np.searchsorted(both >> p.bits, np.arange(hi - lo + 1))
                both = (both & ((1 << p.bits) - 1)).astype(np.int32)
                blobs += [both[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["doc_id", "label", "features"])
        give_back()

    return extract


def ftrl_fit(rows: list[tuple[np.ndarray, int]], p: FTRL) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates and values of the non-zero weights, and the bias. Rows are used in the given order."""
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    bias, bias_n = 0.0, 0.0

    def weight(zi, ni):
        w = (np.sign(zi) * p.l1 - zi) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2)
        return np.where(np.abs(zi) > p.l1, w, 0.0)

    for _ in range(p.epochs):
        for at, y in rows:
            zi, ni = z[at], n[at]
            w = weight(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha * w
            n[at] = ni + g * g
            bias_n += g * g
            bias -= p.alpha * g / (p.beta + np.sqrt(bias_n))
    w = weight(z, n)
    at = np.flatnonzero(w)
    return at.astype(np.int32), w[at].astype(np.float32), float(bias)


def held_out(id_col) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: FTRL = FTRL()):
    """Fit on labelled rows outside the held-out fold."""
    usable = labels.where(~held_out("doc_id") & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(params.train_rows).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").distinct()
    got = texts.mapInArrow(_extractor(params), "doc_id long, label int, features binary").toArrow()
    # views of the collected buffers: the features are held once
    rows = [(i, y, np.frombuffer(f.as_buffer(), np.int32)) for b in got.to_batches() for i, y, f in zip(b["doc_id"].to_pylist(), b["label"].to_pylist(), b["features"])]
    times = Counter(i for i, _, _ in rows)
    rows.sort(key=lambda r: (hash((r[0], 11)), r[0], r[2].tobytes() if times[r[0]] > 1 else b""))
    return ftrl_fit([(f, y) for _, y, f in rows], params)


def _scorer(shared, p: FTRL, text: str):
    def score(batches):
        at, values, bias = shared.value
        table = np.zeros(1 << p.bits, dtype=np.float32)
        table[at] = values
        for batch in batches:
            total = np.full(batch.num_rows, bias)
            for lo, hi, w in words(batch.column(0).field(text), ALNUM_LOWER, stems=p.stems):
                found = []
                for doc, k in _features(w, p.bits, p.gaps):
                    hit = np.flatnonzero(table[k])
                    found.append((doc[hit] << p.bits) | k[hit])
                both = np.unique(np.concatenate(found))
                total[lo:hi] += np.bincount(both >> p.bits, weights=table[both & ((1 << p.bits) - 1)], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))))], names=["_row", "toxicity"])
        give_back()

    return score


def score_toxicity(docs: DataFrame, model, params: FTRL = FTRL(), text_col: str = "text") -> DataFrame:
    """docs with a column toxicity, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "toxicity"]
    packed, text = with_text(docs, kept, text_col)
    done = packed.mapInArrow(_scorer(shared, params, text), packed.select("_row").schema.add("toxicity", "double"))
    return done.select(*(F.col("_row").getField(f"c_{c}").alias(c) for c in kept), "toxicity")
