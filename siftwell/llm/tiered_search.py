"""Ranked lexical search over a tiered index: high-impact postings first, residual bounds per term, exact results.

Terms are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased. A term that df of
the N documents hold weighs w = floor(1000 ln((2N + 2) / (2df + 1))); in a document of n terms, where L is the number of
all terms, it has the impact (10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L, which is below 10^6. A document's score
is the sum of w times impact over the query's terms, repeats included.

1. Blocks. One map reads each text once and writes, for about 4 MB of text, how often each of its documents holds each
   term that some query asks for. Texts are never shuffled.
2. Index. N, L and df are sums over the blocks. Each block becomes a shard: the postings of a term in order of
   impact, cut into tiers (the best 32, the next 224, all others), and for each tier the largest impact that is left
   below it, term by term: the residual bounds.
3. Search. A first pass reads the top tiers alone. Partial scores are lower bounds, so the k-th best of all shards
   is a floor for each query. The second pass goes through the shards: no document of a shard can
   have more than its partial score and the sum of the residual bounds. Where the best such sum misses the
   floor, the shard is proven to add nothing to this query; where no bound is left, its scores are exact; queries
   with neither proof fall through to the next tier, and the last tier has no bounds. A task keeps the best k of a query.

What a task sends on is bounded by k rows for each query. The queries of a group (terms of at most `group_bytes` of text) are sent to
each machine as a mapped file; more queries are searched group by group, each of which reads the documents once.

Defined results: null texts and texts without terms are no documents; queries without terms have no rows; equal scores go by ascending
id and a null id counts as larger than any other; repeated documents are documents of their own, repeated queries
have their rows each; very long texts are taken whole; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import drop_at_exit, fresh_path, mapped_arrays, materialize, ship_arrays
from .textkernel import ALNUM_LOWER, give_back, words

_LAST = np.iinfo(np.int64).max
_BLOCK = "ids binary, lengths binary, doc binary, term binary, tf binary, n_docs long, n_terms long"
_SHARD = "ids binary, docs0 binary, terms0 binary, impacts0 binary, docs1 binary, terms1 binary, impacts1 binary, docs2 binary, terms2 binary, impacts2 binary, rest0 binary, rest1 binary"
_TIERS = 3


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


_BLOCK_PA, _SHARD_PA = _arrow(_BLOCK), _arrow(_SHARD)


def _blocker(queries: str, limit: int):
    """Documents to blocks: which of the queries' terms each holds, and how often."""

    def block(batches):
        asked = mapped_arrays(queries)["terms"]
        for batch in batches:
            ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
            for lo, hi, w in words(batch.column(1), ALNUM_LOWER, limit):
                n = np.diff(w.bounds)
                at = np.minimum(np.searchsorted(asked, w.hash), len(asked) - 1)
                hit = asked[at] == w.hash
                key, tf = np.unique(w.doc[hit] * len(asked) + at[hit], return_counts=True)
                row = (ids[lo:hi].tobytes(), n.tobytes(), (key // len(asked)).astype(np.int32).tobytes(), (key % len(asked)).astype(np.int32).tobytes(), tf.astype(np.int32).tobytes(), int((n > 0).sum()), int(n.sum()))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK_PA)], schema=_BLOCK_PA)
        give_back()

    return block


def _frequencies(batches):
    """(term, number of documents) over the blocks of a task."""
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for x in batch.column(0):
            n = np.bincount(np.frombuffer(x.as_buffer(), np.int32), minlength=len(total))
            n[: len(total)] += total
            total = n
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["term", "df"])


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def tiers_of(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, depths: tuple[int, int]):
    """For each tier its postings (doc, term, impact), and for each but the last the largest impacts below it (rows of term, impact)."""
    order = np.lexsort((doc, -impact, term))
    doc, term, impact = doc[order], term[order], impact[order]
    lead = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    rank = np.arange(len(term)) - np.repeat(lead, np.diff(np.append(lead, len(term))))
    edges = (0, *depths, _LAST)
    parts = [(doc[on], term[on], impact[on]) for a, b in zip(edges, edges[1:]) if (on := (rank >= a) & (rank < b)) is not None]
    return parts, [np.stack([term[rank == d], impact[rank == d]], axis=1).astype(np.int32) for d in depths]


def _indexer(shared, depths: tuple[int, int]):
    """Blocks to shards."""

    def index(batches):
        n_docs, n_terms = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                ids, n, doc, term, tf = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in enumerate((np.int64, np.int64, np.int32, np.int32, np.int32)))
                impact = impacts(tf.astype(np.int64), n[doc], n_docs, n_terms).astype(np.int32)
                parts, rest = tiers_of(doc, term, impact, depths)
                row = [ids, *(x for part in parts for x in part), *rest]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], schema=_SHARD_PA)
        give_back()

    return index


class QueryBlock:
    """Some queries with the gains (repeats times weight) of their terms."""

    def __init__(self, first: int, count: int, query: np.ndarray, term: np.ndarray, gain: np.ndarray):
        order = np.lexsort((query, term))
        self.first, self.count, self.query, self.gain = first, count, query[order] - first, gain[order]
        self.terms, start = np.unique(term[order], return_index=True)
        self.start = np.append(start, len(order))
        # sums below 2^53 are exact in doubles, which bincount adds up quickly
        most = np.bincount(self.query, weights=self.gain * 1e6, minlength=count).max(initial=0)
        self.kind = np.float64 if most < 2**53 else np.int64

    def _pairs(self, term: np.ndarray, step: int = 1 << 21):
        """(postings, gains' places) that belong together, in pieces."""
        if not len(self.terms) or not len(term):
            return
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        row = np.flatnonzero(self.terms[at] == term)
        at = at[row]
        many = self.start[at + 1] - self.start[at]
        ends = np.cumsum(many)
        lo = 0
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - many[lo] + step, side="right")))
            m = many[lo:hi]
            yield np.repeat(row[lo:hi], m), np.repeat(self.start[at[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            lo = hi

    def add(self, scores: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, open_: np.ndarray) -> None:
        """Add the postings' parts to the scores (queries, documents) of the open queries."""
        for posting, pair in self._pairs(term):
            on = open_[self.query[pair]]
            posting, pair = posting[on], pair[on]
            key = self.query[pair] * scores.shape[1] + doc[posting]
            if self.kind is np.float64:
                scores += np.bincount(key, weights=self.gain[pair] * impact[posting].astype(np.int64), minlength=scores.size).reshape(scores.shape)
            else:
                np.add.at(scores.reshape(-1), key, self.gain[pair] * impact[posting].astype(np.int64))

    def bounds(self, rest: np.ndarray) -> np.ndarray:
        """The most that the postings below a tier can add, for each query."""
        out = np.zeros(self.count, dtype=self.kind)
        for row, pair in self._pairs(rest[:, 0]):
            np.add.at(out, self.query[pair], self.gain[pair] * rest[row, 1].astype(np.int64))
        return out


def query_blocks(first: np.ndarray, term: np.ndarray, many: np.ndarray, weights: np.ndarray, size: int = 256) -> list[QueryBlock]:
    """Blocks of `size` queries; query q asks for the terms first[q]:first[q + 1], `many` times each."""
    out = []
    for lo in range(0, len(first) - 1, size):
        hi = min(lo + size, len(first) - 1)
        part = slice(int(first[lo]), int(first[hi]))
        gain = many[part] * weights[term[part]]
        query, on = np.repeat(np.arange(lo, hi), np.diff(first[lo : hi + 1])), gain > 0
        out.append(QueryBlock(lo, hi - lo, query[on], term[part][on], gain[on]))
    return out


def _shard(batch: pa.RecordBatch, k: int, tiers: int):
    get = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)
    parts = [(get(f"docs{t}", np.int32), get(f"terms{t}", np.int32), get(f"impacts{t}", np.int32)) for t in range(tiers)]
    rest = [get(f"rest{t}", np.int32).reshape(-1, 2) for t in range(tiers - 1)]
    return get("ids", np.int64), parts, rest


def _blocks_of(queries: str, weights: np.ndarray) -> list[QueryBlock]:
    asked = mapped_arrays(queries)
    return query_blocks(asked["first"], asked["term"], asked["many"], weights)


def _floors(queries: str, shared, k: int):
    """The best k partial scores of each query over the top tiers of a task."""

    def floors(batches):
        blocks, best = _blocks_of(queries, shared.value), {}
        for batch in batches:
            for row in range(batch.num_rows):
                ids, ((doc, term, impact),), _ = _shard(batch, row, 1)
                for b, block in enumerate(blocks):
                    scores = np.zeros((block.count, max(k, len(ids))), dtype=block.kind)
                    block.add(scores, doc, term, impact, np.ones(block.count, bool))
                    top = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k:]
                    if b in best:
                        top = np.partition(np.concatenate([top, best[b]], axis=1), k, axis=1)[:, -k:]
                    best[b] = top
        for b, top in best.items():
            query, rank = np.nonzero(top)
            yield pa.RecordBatch.from_arrays([pa.array((query + blocks[b].first).astype(np.int32)), pa.array(top[query, rank].astype(np.int64))], names=["query", "score"])
        give_back()

    return floors


def _best(found: list[tuple], k: int):
    """The best k (query, id, score) of each query, best first."""
    query, ids, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    lead = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])[: len(query)])
    on = np.arange(len(query)) - np.repeat(lead, np.diff(np.append(lead, len(query)))) < k
    return query[on], ids[on], score[on]


def search_shard(block: QueryBlock, floor: np.ndarray, ids: np.ndarray, parts: list, rest: list):
    """(queries, ids, exact scores) of the documents that reach the queries' floors, and how many tiers each query needed."""
    scores, open_ = np.zeros((block.count, len(ids)), dtype=block.kind), np.ones(block.count, dtype=bool)
    depth, done = np.zeros(block.count, dtype=np.int64), np.zeros(block.count, dtype=bool)
    for t, part in enumerate(parts):
        depth[open_] += 1
        block.add(scores, *part, open_)
        left = block.bounds(rest[t]) if t < len(rest) else np.zeros(block.count, dtype=block.kind)
        done |= open_ & (left == 0)
        # a query stays open while neither its scores are exact nor its floor out of reach
        open_ = open_ & (left > 0) & (scores.max(axis=1, initial=0) + left >= floor)
        if not open_.any():
            break
    query, doc = np.nonzero((scores >= floor[:, None]) & done[:, None])
    return (query + block.first, ids[doc], scores[query, doc].astype(np.int64)), depth


def _searcher(queries: str, shared, k: int):
    def search(batches):
        weights, floor = shared.value
        blocks, floor = _blocks_of(queries, weights), floor.copy()
        best = [(np.zeros(0, np.int64),) * 3 for _ in blocks]
        for batch in batches:
            for row in range(batch.num_rows):
                ids, parts, rest = _shard(batch, row, _TIERS)
                for b, block in enumerate(blocks):
                    own = floor[block.first : block.first + block.count]
                    found, _ = search_shard(block, own, ids, parts, rest)
                    if len(found[0]):
                        best[b] = query, _, score = _best([best[b], found], k)
                        full = np.bincount(query - block.first, minlength=block.count) == k
                        lowest = np.full(block.count, _LAST)
                        np.minimum.at(lowest, query - block.first, score)
                        own[full] = np.maximum(own, lowest)[full]
        for query, ids, score in best:
            yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(ids), pa.array(score)], names=["query", "id", "score"])
        give_back()

    return search


def _search_group(docs: DataFrame, asked: pa.Table, k: int, depths: tuple[int, int], limit: int) -> DataFrame | None:
    """(query, id, score): for each query of a group, what the tasks found best; None if the queries hold no term."""
    spark = docs.sparkSession
    hashes = [(w.hash, w.bounds) for _, _, w in words(asked["text"], ALNUM_LOWER)]
    if not sum(len(h) for h, _ in hashes):
        return None
    flat = np.concatenate([h for h, _ in hashes])
    owner = np.repeat(np.arange(asked.num_rows), np.concatenate([np.diff(b) for _, b in hashes]))
    terms = np.unique(flat)
    key, many = np.unique(owner * len(terms) + np.searchsorted(terms, flat), return_counts=True)
    first = np.searchsorted(key // len(terms), np.arange(asked.num_rows + 1))
    queries = ship_arrays(spark, "tiered-queries", {"terms": terms, "first": first, "term": (key % len(terms)).astype(np.int32), "many": many.astype(np.int64)})

    blocks = materialize(docs.mapInArrow(_blocker(queries, limit), _BLOCK), "tiered-blocks")
    n_docs, n_terms = (int(x or 0) for x in blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    if not n_docs:
        return None
    df = blocks.select("term").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    weights = np.zeros(len(terms), dtype=np.int64)
    weights[df["term"].to_numpy()] = [weight(n_docs, x) for x in df["df"].to_pylist()]

    index = materialize(blocks.mapInArrow(_indexer(spark.sparkContext.broadcast((n_docs, n_terms)), depths), _SHARD), "tiered-index")
    top = index.select("ids", "docs0", "terms0", "impacts0").mapInArrow(_floors(queries, spark.sparkContext.broadcast(weights), k), "query int, score long")
    kth = top.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("rank") == k).select("query", "score").toArrow()
    floor = np.ones(asked.num_rows, dtype=np.int64)
    floor[kth["query"].to_numpy()] = kth["score"].to_numpy()
    return index.mapInArrow(_searcher(queries, spark.sparkContext.broadcast((weights, floor)), k), "query int, id long, score long")


def tiered_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", depths: tuple[int, int] = (32, 256), group_bytes: int = 16 << 20, limit: int = 4 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest scores above 0."""
    spark = docs.sparkSession
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    asked = items.select(F.col(f"`{item_id_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where("text is not null")
    total = int(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    groups = -(-total // group_bytes)
    if groups > 1:
        path = fresh_path(spark, "tiered-items")
        drop_at_exit(spark, path)
        asked.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)).cast("int")).repartition(groups, "part").write.partitionBy("part").parquet(path)
        asked = spark.read.parquet(path)
    out = []
    for g in range(groups):
        part = (asked.where(F.col("part") == g) if groups > 1 else asked).select("item_id", "text").toArrow()
        found = _search_group(plain, part, k, depths, limit)
        if found is not None:
            names = spark.createDataFrame(pa.table({"query": pa.array(np.arange(part.num_rows), pa.int32()), "item_id": part["item_id"]}))
            best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
            ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            # a group's queries are bounded, so their names are
            ranked = ranked.join(F.broadcast(names), "query")
            out.append(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != _LAST, F.col("id")).alias("doc_id"), "score"))
    if not out:
        kind = items.schema[item_id_col].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for other in out[1:]:
        out[0] = out[0].unionByName(other)
    return out[0]
