"""Substring dedup by level-wise doubling.

A window of `window` words is redundant where the same words also start in a
document with a smaller id. Window sizes double from about seven words up to
`window`; at each size only windows whose two halves were both found repeated at
the size before are still candidates, so almost all of the corpus leaves after
the first, cheap level (four bytes a window). The levels end at `window`: a
longer repeat is the union of its own windows and removes no further word.

Spark's part: documents are dealt once into groups of bounded size (one shuffle
of the texts, reused by all levels). A level sends, for each group, sorted
distinct window keys to hash buckets, which answer each group with the keys that
are repeated. A key costs a bucket one entry per group, however often it occurs,
so very frequent passages neither skew a task nor make pairs. The last level, which
decides, compares 96 bits of a window: two independent hashes over 64-bit word hashes.

Defined results: null text has no words; an empty table gives an empty result;
rows with equal ids never remove words from each other; a null id counts as
larger than any other; repeated rows are repeated in the result; very long texts are deduplicated whole, as a
group of their own size; columns of docs named like outputs are replaced, all others pass through unchanged.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import shuffle_partitions
from .textkernel import SPACED, in_sorted, lean, mix, window_hash, words

_BLOCK = "_bucket int, _g int, _keys binary, _more binary"
_BLOCK_PA = pa.schema([("_bucket", pa.int32()), ("_g", pa.int32()), ("_keys", pa.binary()), ("_more", pa.binary())])
_LAST = np.iinfo(np.int64).max
#: The step of the second hash of a window.
_STEP = 0x9FB21C651E98DF25


def level_sizes(window: int, base: int = 8) -> list[int]:
    """Window sizes of the levels: the last is window, each at most twice the one before."""
    sizes = [window]
    while sizes[0] > base:
        sizes.insert(0, (sizes[0] + 1) // 2)
    return sizes


def _ids(table: pa.Table) -> np.ndarray:
    return table["_id"].combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _split(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit key, by its upper half; grows with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _short(keys: np.ndarray, buckets: int) -> np.ndarray:
    """What a filter level remembers of a key: its bucket and lower half."""
    return (_split(keys, buckets) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def _check(h: np.ndarray, size: int) -> np.ndarray:
    """32 bits of a window beside its key."""
    return (window_hash(h, size, size, step=_STEP) >> np.uint64(32)).astype(np.uint32)


def _level(table: pa.Table, known: np.ndarray | None, size: int, before: int, buckets: int, checked: bool):
    """Keys of the candidate windows of a group, their checks (0 where not asked for) and their documents' ids."""
    ids, keys, checks, owners = _ids(table), [], [], []
    for lo, _, w in words(table["_text"], SPACED):
        left = w.left
        ok = left[: max(0, len(w) - size + 1)] >= size
        if known is not None and len(ok):
            was = in_sorted(_short(window_hash(w.hash, before, before), buckets), known)
            ok &= was[: len(ok)] & was[size - before : size - before + len(ok)]
        at = np.flatnonzero(ok)
        keys.append(window_hash(w.hash, size, size)[at])
        checks.append(_check(w.hash, size)[at] if checked else np.zeros(len(at), np.uint32))
        owners.append(ids[lo + w.doc[at]])
    return (np.concatenate(keys), np.concatenate(checks), np.concatenate(owners)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))


def _known(answers: pa.Table | None) -> np.ndarray:
    if answers is None or not answers.num_rows:
        return np.zeros(0, dtype=np.uint64)
    return np.sort(np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(k, dtype=np.uint32).astype(np.uint64) for b, k in zip(answers["_bucket"].to_pylist(), answers["_keys"].to_pylist())]))


def _blocks(g: int, bucket: np.ndarray, keys: np.ndarray, more: np.ndarray | None) -> pa.Table:
    """One row per bucket that gets keys; bucket is ascending. Bits are packed."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])
    if not len(bucket):
        return _BLOCK_PA.empty_table()
    pack = (lambda x: np.packbits(x).tobytes()) if more is not None and more.dtype == bool else (lambda x: x.tobytes())
    return pa.table({"_bucket": pa.array(bucket[lo].astype(np.int32)), "_g": pa.array(np.full(len(lo), g, np.int32)), "_keys": [keys[a:b].tobytes() for a, b in zip(lo, hi)], "_more": [None if more is None else pack(more[a:b]) for a, b in zip(lo, hi)]}, schema=_BLOCK_PA)


def _first_of(keys: np.ndarray, checks: np.ndarray, owners: np.ndarray):
    """Sorted distinct keys with their checks, each one's least owner, and whether it has two owners."""
    order = np.argsort(keys)
    k, c = keys[order], checks[order]
    if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
    o = owners[order]
    lead = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])) if len(k) else np.zeros(0, np.int64)
    if not len(lead):
        return k, c, o, np.zeros(0, dtype=bool)
    least, most = np.minimum.reduceat(o, lead), np.maximum.reduceat(o, lead)
    return k[lead], c[lead], least, least < most


def _place(keys: np.ndarray, checks: np.ndarray, k: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where the sorted keys with checks hold (k, c); -1 where they don't."""
    found = np.full(len(k), -1, dtype=np.int64)
    if len(keys):
        at, many = np.searchsorted(keys, k), 1 + int((keys[1:] == keys[:-1]).sum())
        for off in range(min(many, 8)):  # keys repeat only where two windows share 64 bits
            here = np.minimum(at + off, len(keys) - 1)
            np.copyto(found, here, where=(keys[here] == k) & (checks[here] == c))
    return found


_WIDE = np.dtype([("key", "<u8"), ("check", "<u4")])


def _wide(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    both = np.empty(len(keys), dtype=_WIDE)
    both["key"], both["check"] = keys, checks
    return both


def _sender(size: int, before: int, buckets: int, last: bool):
    def send(table: pa.Table, answers: pa.Table | None) -> pa.Table:
        if not table.num_rows:
            return _BLOCK_PA.empty_table()
        known = None if answers is None else _known(answers)
        keys, checks, least, several = _first_of(*_level(table, known, size, before, buckets, last))
        g = table["_g"][0].as_py()
        if last:
            bucket = _split(mix(keys, 5), buckets)
            order = np.argsort(bucket, kind="stable")
            return _blocks(g, bucket[order], _wide(keys, checks)[order], least[order])
        bucket, short = _split(keys, buckets), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return _blocks(g, bucket, short, several)

    return send


def _alone(send):
    return lambda table: send(table, None)


def _repeated(table: pa.Table) -> pa.Table:
    """A bucket of a filter level: each group gets back its keys that two documents have."""
    rows = [np.frombuffer(k, dtype=np.uint32) for k in table["_keys"].to_pylist()]
    flags = [np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=len(r)).astype(bool) for m, r in zip(table["_more"].to_pylist(), rows)]
    every = np.sort(np.concatenate([*rows, *(r[f] for r, f in zip(rows, flags))]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    found = [r[in_sorted(r, twice)] for r in rows]
    return pa.table({"_bucket": table["_bucket"], "_g": table["_g"], "_keys": [x.tobytes() for x in found], "_more": pa.nulls(len(found), pa.binary())}, schema=_BLOCK_PA).filter(pa.array([len(x) > 0 for x in found], pa.bool_()))


def _earlier(table: pa.Table) -> pa.Table:
    """A bucket of the last level: each group gets back its keys that start earlier in another group."""
    rows = [np.frombuffer(k, dtype=_WIDE) for k in table["_keys"].to_pylist()]
    owners = [np.frombuffer(m, dtype=np.int64) for m in table["_more"].to_pylist()]
    every = np.concatenate(rows)
    keys, checks, least, _ = _first_of(every["key"], every["check"], np.concatenate(owners))
    found = [r[least[_place(keys, checks, r["key"], r["check"])] < o] for r, o in zip(rows, owners)]
    return pa.table({"_bucket": table["_bucket"], "_g": table["_g"], "_keys": [x.tobytes() for x in found], "_more": pa.nulls(len(found), pa.binary())}, schema=_BLOCK_PA).filter(pa.array([len(x) > 0 for x in found], pa.bool_()))


def _cover(w, ids: np.ndarray, size: int, redundant) -> np.ndarray:
    """Which words lie in a redundant window."""
    n = max(0, len(w) - size + 1)
    ok = np.flatnonzero(w.left[:n] >= size)
    hit = ok[redundant(window_hash(w.hash, size, size)[ok], _check(w.hash, size)[ok], ids[w.doc[ok]])]
    edge = np.zeros(len(w) + 1, dtype=np.int64)
    edge[hit] += 1
    edge[hit + size] -= 1
    return np.cumsum(edge[:-1]) > 0


def _kept(w, gone: np.ndarray) -> list[bytes]:
    """The kept words of each document, joined by one space."""
    data = w.data.copy()
    stop = np.minimum(w.end + 1, w.offsets[1:][w.doc])
    data[w.end[stop > w.end]] = 32
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[w.start[~gone]] += 1
    edge[stop[~gone]] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
    out, at = data[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])[w.offsets]
    return [out[a : b - 1] if b > a and out[b - 1] == 32 else out[a:b] for a, b in zip(at[:-1], at[1:])]


def _finisher(size: int, schema: pa.Schema, with_text: bool):
    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        ids = _ids(table)
        keys, checks, least, _ = _first_of(*_level(table, None, size, 0, 0, True))
        elsewhere = np.zeros(len(keys), dtype=bool)
        if answers.num_rows:
            known = np.concatenate([np.frombuffer(k, dtype=_WIDE) for k in answers["_keys"].to_pylist()])
            elsewhere[_place(keys, checks, known["key"], known["check"])] = True

        def redundant(k, c, owner):
            at = _place(keys, checks, k, c)
            return elsewhere[at] | (owner > least[at])

        n, gone_n, sha, text = [], [], [], []
        for lo, hi, w in words(table["_text"], SPACED):
            gone = _cover(w, ids[lo:hi], size, redundant)
            total = np.concatenate([[0], np.cumsum(gone)])[w.bounds]
            n.append(np.diff(w.bounds))
            gone_n.append(np.diff(total))
            kept = _kept(w, gone)
            sha += [hashlib.sha256(x).hexdigest() for x in kept]
            if with_text:
                text += kept
        gone_n = np.concatenate(gone_n)
        cols = {"_row": table["_row"], "n_words": np.concatenate(n), "n_removed": gone_n, "kept_sha256": sha}
        if with_text:
            was = table["_text"].combine_chunks()
            cols["kept_text"] = pa.compute.if_else(pa.array(gone_n > 0), pa.array(text, pa.binary()).cast(was.type), was)
        return pa.table({f.name: pa.array(x, f.type) if isinstance(x := cols[f.name], (list, np.ndarray)) else x.cast(f.type) for f in schema}, schema=schema)

    return finish


def exchange(total: int, group_bytes: int = 8 << 20, most: int = 16) -> tuple[int, int]:
    """Numbers of groups and of buckets for `total` bytes of text.

    Each group sends each bucket a row. Both grow with the root of the input, up to
    `most` times their first size, so that a row carries hundreds of keys: rows grow in
    proportion to the input up to about 2 TB, and with its square beyond.
    """
    grow = min(most, max(1.0, math.sqrt(total / (700 * group_bytes))))
    return int(total / (grow * group_bytes)), max(64, int(2 * total / (grow * group_bytes)))


def deal(plain: DataFrame, group_bytes: int = 8 << 20) -> tuple[DataFrame, int]:
    """plain, with _id and _text, dealt into groups _g of bounded size; and the number of buckets for exchanges between them.

    Repeated rows would all hash to one group: ids whose rows have more bytes than a group are dealt row by row over as many
    groups as they fill. There are at most as many such ids as groups, so they are broadcast.
    """
    by_id = plain.groupBy("_id").agg(F.sum(F.octet_length("_text")).alias("_bytes"), F.count("*").alias("_rows"))
    total, largest = (int(x or 0) for x in by_id.agg(F.sum("_bytes"), F.max(F.when(F.col("_rows") > 1, F.col("_bytes")))).first())
    groups, buckets = exchange(total, group_bytes)
    parts = max(shuffle_partitions(plain.sparkSession), groups // 8)
    most, turn = max(group_bytes, total // max(1, groups)), []
    if largest > most:
        heavy = by_id.where((F.col("_rows") > 1) & (F.col("_bytes") > most)).select(F.col("_id").alias("_heavy"), F.ceil(F.col("_bytes") / most).alias("_times"))
        plain = plain.join(F.broadcast(heavy), F.col("_id").eqNullSafe(F.col("_heavy")), "left")
        turn = [F.pmod(F.monotonically_increasing_id(), F.coalesce("_times", F.lit(1)))]
    g = F.pmod(F.xxhash64("_id", "_text", *turn), F.lit(max(4 * parts, groups))).cast("int")
    return plain.withColumn("_g", g).drop("_heavy", "_times").repartition(parts, "_g"), buckets


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, group_bytes: int = 8 << 20) -> DataFrame:
    """Drop the words of every window that starts in a document with a smaller id as well.

    Returns docs' columns without the text, n_words, n_removed, kept_sha256 (of the
    kept words joined by one space) and, if with_text, kept_text: the text itself
    where nothing was removed, else the kept words joined by one space.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rest = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed", "kept_sha256", "kept_text")]
    row = F.struct(*(F.col(f"`{c}`").alias(f"c_{c}") for c in rest), F.lit(0).alias("_"))
    dealt, buckets = deal(docs.select(row.alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")), group_bytes)

    sizes, answers = level_sizes(window), None
    for k, n in enumerate(sizes):
        send = lean(_sender(n, sizes[k - 1] if k else 0, buckets, last=n == window))
        if answers is None:
            sent = dealt.groupBy("_g").applyInArrow(_alone(send), _BLOCK)
        else:
            sent = dealt.groupBy("_g").cogroup(answers.groupBy("_g")).applyInArrow(send, _BLOCK)
        answers = sent.groupBy("_bucket").applyInArrow(_earlier if n == window else _repeated, _BLOCK)

    out = T.StructType([T.StructField("_row", dealt.schema["_row"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept_text", T.StringType())] if with_text else [])])
    done = dealt.groupBy("_g").cogroup(answers.groupBy("_g")).applyInArrow(lean(_finisher(window, to_arrow_schema(out), with_text)), out)
    return done.select(*(F.col("_row").getField(f"c_{c}").alias(c) for c in rest), *(f.name for f in out.fields[1:]))
