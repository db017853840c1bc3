"""Approximate nearest neighbours by cross-polytope hashing.

Each table has `hashes` pseudo-rotations, three fast Hadamard transforms with random
sign flips each, and hashes a unit vector to the nearest signed axis under every one of them. A query probes the
`probes` nearest cells of every table; what it meets there is scored exactly on the original
vectors. A query that has met fewer than k vectors this way is searched again
against all of them.

Queries are a stated part of the rows and go over the index in blocks of about `query_block`: a
block's probes are a broadcast of that bounded size, and one map over the index hashes each vector,
looks up which queries probe its cells and scores it for these alone. So vectors are never
shuffled or copied per table, a cell may hold any share of them, and only the best k of a task and query
go on. The tables are as many and as fine at every size of the input.

Vectors of one length are searched among those of that length. Defined results: vectors that are
null, empty, zero, or with null or non-finite components take no part, nor do null ids; of rows that
share an id each counts, and as a neighbour that id is given once, with its best score; a table of
fewer than k + 1 vectors gives each query all others; ties go to the smaller id; extra columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import drop_at_exit, fresh_path

_FOUND = "query_id long, vec_id long, score double"
_FOUND_PA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotations(dims: int, tables: int, hashes: int, seed: int) -> np.ndarray:
    """The pseudo-rotations as matrices, which a batch applies at once: tables x hashes x dims x axes."""
    size = 1 << max(1, (dims - 1).bit_length())
    out = np.zeros((tables, hashes, dims, size))
    for t in range(tables):
        for h in range(hashes):
            y = np.eye(dims, size)
            for flips in np.random.default_rng([seed, t, h]).choice([-1.0, 1.0], size=(3, size)):
                y = hadamard(y * flips)
            out[t, h] = y
    return out


def own_cells(u: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """The cell of each row under a table's rotations: the nearest signed axes, as one number."""
    cell = np.zeros(len(u), dtype=np.int64)
    for r in turns:
        y = u @ r
        axis = np.abs(y).argmax(axis=1)
        cell = cell * (2 * y.shape[1]) + axis + y.shape[1] * (y[np.arange(len(u)), axis] < 0)
    return cell


def _top(scores: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n largest scores of each row, largest first."""
    n = min(n, scores.shape[1])
    best = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(scores, best, axis=1), axis=1), axis=1)


def near_cells(u: np.ndarray, turns: np.ndarray, probes: int) -> np.ndarray:
    """The nearest cells of each row under a table's rotations, nearest first."""
    found = score = None
    for r in turns:
        y = u @ r
        y = np.concatenate([y, -y], axis=1)
        axis = _top(y, probes)
        gain = np.take_along_axis(y, axis, axis=1)
        if found is None:
            found, score = axis.astype(np.int64), gain
            continue
        # of sorted lists only pairs of places i, j with (i + 1) * (j + 1) <= probes can be among the best
        i, j = (x.ravel() for x in np.indices((found.shape[1], axis.shape[1])))
        few = (i + 1) * (j + 1) <= probes
        i, j = i[few], j[few]
        found, score = found[:, i] * y.shape[1] + axis[:, j], score[:, i] + gain[:, j]
        keep = _top(score, probes)
        found, score = np.take_along_axis(found, keep, axis=1), np.take_along_axis(score, keep, axis=1)
    return found


def _vectors(column: pa.Array) -> np.ndarray:
    """The vectors as rows, each by a power of two brought to components below 1: cosines stay as they are, and no square over- or underflows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0))[1][:, None])


def _prober(shape: tuple, probes: int):
    """Queries with their cells in every table."""

    def probe(batches):
        turns = rotations(*shape)
        for batch in batches:
            v = _vectors(batch.column(1))
            u = v / np.linalg.norm(v, axis=1, keepdims=True)
            cells = np.stack([near_cells(u, t, probes) for t in turns], axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in cells], pa.binary())], names=["query_id", "vector", "cells"])

    return probe


def _lookup(cells: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each table (the second axis): sorted cells, where their queries start, and the queries."""
    out = []
    for t in range(cells.shape[1]):
        flat = cells[:, t].ravel()
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        out.append((keys, np.append(first, len(flat)), (order // cells.shape[2]).astype(np.uint16)))
    return out


def _merge(best, q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The best k of each query, an id once, nearest first."""
    q, ids, score = (np.concatenate(x) for x in zip(best, (q, ids, score)))
    order = np.lexsort((-score, ids, q))
    q, ids, score = q[order], ids[order], score[order]
    once = np.concatenate([[True], (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])])[: len(q)]
    q, ids, score = q[once], ids[once], score[once]
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    lead = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])[: len(q)])
    rank = np.arange(len(q)) - np.repeat(lead, np.diff(np.append(lead, len(q))))
    return q[rank < k], ids[rank < k], score[rank < k]


def _searcher(shared, shape: tuple, k: int, step: int = 2048):
    """One pass of a block of queries over the vectors; without tables every vector is a candidate."""

    def search(batches):
        query_ids, asked, tables = shared.value
        norm = np.linalg.norm(asked, axis=1)
        unit, turns, n = asked / norm[:, None], rotations(*shape) if tables else None, len(asked)
        best, least = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.full(n, -np.inf)
        for batch in batches:
            every, ids = _vectors(batch.column(1)), batch.column(0).to_numpy()
            for lo in range(0, len(ids), step):
                v, i = every[lo : lo + step], ids[lo : lo + step]
                size = np.linalg.norm(v, axis=1)
                u = v / size[:, None]
                met = np.full((n, len(i)), not tables)
                for (keys, first, queries), turn in zip(tables, turns if tables else ()):
                    cell = own_cells(u, turn)
                    at = np.minimum(np.searchsorted(keys, cell), len(keys) - 1)
                    row = np.flatnonzero(keys[at] == cell)
                    many = first[at[row] + 1] - first[at[row]]
                    entry = np.repeat(first[at[row]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    met[queries[entry], np.repeat(row, many)] = True
                found = []
                for j in range(n):
                    row = np.flatnonzero(met[j])
                    near = row[(u[row] @ unit[j] >= least[j] - 1e-12) & (i[row] != query_ids[j])]
                    if len(near):
                        found.append((np.full(len(near), j), i[near], (v[near] * asked[j]).sum(axis=1) / (size[near] * norm[j])))
                if found:
                    best = _merge(best, *(np.concatenate(x) for x in zip(*found)), k)
                    full = np.bincount(best[0], minlength=n) == k
                    lowest = np.full(n, np.inf)
                    np.minimum.at(lowest, best[0], best[2])
                    least = np.where(full, lowest, -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[best[0]]), pa.array(best[1]), pa.array(best[2])], schema=_FOUND_PA)

    return search


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 5, tables: int = 32, probes: int = 64, hashes: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7, query_block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row where is_query holds, itself left out.

    is_query is an expression over the column vec_id.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    plain = plain.where(F.col("vec_id").isNotNull() & sound)
    path = fresh_path(spark, "neighbours")
    drop_at_exit(spark, path)
    spark.createDataFrame([], _FOUND).write.parquet(path)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = lambda found: found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = lambda found: once(found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def search(asking: DataFrame, dims: int, hashed: bool) -> None:
        shape, index = (dims, tables, hashes, seed), plain.where(F.size("v") == dims)
        blocks = -(-asking.count() // query_block)
        for b in range(blocks):
            block = asking.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b)
            got = block.mapInArrow(_prober(shape, probes if hashed else 1), "query_id long, vector binary, cells binary").toArrow()
            for lo in range(0, got.num_rows, 1 << 16):  # a query's number has 16 bits
                part = got.slice(lo, 1 << 16)
                asked = np.frombuffer(b"".join(part["vector"].to_pylist()), np.float64).reshape(-1, dims)
                cells = np.frombuffer(b"".join(part["cells"].to_pylist()), np.int64).reshape(len(asked), tables, -1)
                shared = spark.sparkContext.broadcast((part["query_id"].to_numpy(), asked, _lookup(cells) if hashed else []))
                ranked(index.mapInArrow(_searcher(shared, shape, k), _FOUND)).select("query_id", "vec_id", "score").write.mode("append").parquet(path)
                shared.unpersist()

    asking = plain.where(is_query).distinct()
    lengths = [r["dims"] for r in asking.select(F.size("v").alias("dims")).distinct().collect()]
    for dims in lengths:
        search(asking.where(F.size("v") == dims), dims, hashed=True)
    found = spark.read.schema(_FOUND).parquet(path)
    enough = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    for dims in lengths:
        search(asking.where(F.size("v") == dims).join(enough, "vec_id", "left_anti"), dims, hashed=False)
    return ranked(spark.read.schema(_FOUND).parquet(path)).select("query_id", "rank", "vec_id", "score")
