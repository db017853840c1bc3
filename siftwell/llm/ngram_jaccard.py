"""Exact Jaccard join of shingle sets, by count vectors in R-trees.

1. Who may be linked. Order all shingles by how many sets hold them, rare ones first.
   If x and y are linked and x is not the larger, their first common shingle stands
   among the first |x| - ceil(2p|x| / (100 + p)) + 1 of x (its index prefix) and the first
   |y| - ceil(p|y| / 100) + 1 of y (its probe prefix). So a pair is a candidate only
   where an index prefix meets a probe prefix in a shingle that two sets hold. Most
   sets meet nobody, and those that meet in a very common shingle nearly all are linked.
2. Collapse. Each set is verified against one hub, the smallest id that it meets. Copies of
   one text become one component this way, with one comparison a set.
3. Search. Meetings whose sets lie in several components still may hide links. In each an R-tree
   over the sets' count vectors (shingles hashed into groups and counted) bounds the overlap with a
   node by the sum of coordinate minima; pairs that survive it and lie in different components
   are candidates. A round verifies the best `depth` of a set in a part of a meeting, and
   rounds go on, with larger depths and without what is connected by now, until none was left out.
4. Candidates are verified on the full sets; components are those of verified links.

Texts are dealt once into groups of bounded size, and that shuffle serves both
passes over them. How many sets hold a shingle is counted by hash buckets, to
which a group sends four bytes for each distinct shingle. Equal sets are
joined by digest first. A meeting is recorded as a star to the smallest member,
within a group and then across groups, so a shingle that a third of all sets
share costs a bucket one entry per group. In step 3 only sets that meet by their index prefix ask, and a meeting of over `block` sets is
cut into blocks of those that ask and of those that are asked; within its largest component
nothing is compared. A verification task holds one hub and a bounded part of its partners.

Defined results: null or empty text has no shingles and no links; rows that share
an id are one node of the link graph; repeated rows are repeated in the result; a null id has no
links and a null component; very long texts are whole sets like any other; extra columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import materialize, release, shuffle_partitions
from .substring_dedup import _BLOCK, _BLOCK_PA, _blocks, _short, _split, deal
from .textkernel import SPACED_LOWER, in_sorted, lean, mix, window_hash, words

_SENT = "kind int, bucket int, doc_id long, n long, d1 long, d2 long, lead boolean, keys binary, ids binary, meets binary, counts binary"
_SENT_PA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("lead", pa.bool_()), ("keys", pa.binary()), ("ids", pa.binary()), ("meets", pa.binary()), ("counts", pa.binary())])
#: What a set does in a part of a meeting.
HELD, ASKS, BOTH = 0, 1, 2
_EDGE_PA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(texts, size: int):
    """A sorted array of distinct shingle hashes for each text."""
    for _, _, w in words(texts, SPACED_LOWER):
        h = window_hash(w.hash, size)
        for a, b in zip(w.bounds[:-1], w.bounds[1:]):
            if b - a >= size:
                yield np.unique(h[a : b - size + 1])
            elif b > a:
                yield window_hash(w.hash[a:b], int(b - a), salt=size)
            else:
                yield h[:0]


def _digest(s: np.ndarray) -> tuple[int, int]:
    return tuple(int(x) for x in np.array([mix(s, 3).sum(dtype=np.uint64), mix(s, 4).sum(dtype=np.uint64)], dtype=np.uint64).view(np.int64))


def _leads(table: pa.Table, size: int):
    """(id, set, digest, whether it is the first of equal ones) of a group's documents, by id; null ids are never first."""
    table, seen = table.sort_by("_id"), set()
    for i, s in zip(table["_id"].to_pylist(), shingle_sets(table["_text"], size)):
        d = _digest(s)
        lead = i is not None and len(s) > 0 and d not in seen
        if lead:
            seen.add(d)
        yield i, s, d, lead


def _holders(size: int, buckets: int):
    """A group's distinct shingles, and how many of its distinct sets hold each (255 at most), by bucket."""

    def send(table: pa.Table) -> pa.Table:
        sets = [s for _, s, _, lead in _leads(table, size) if lead]
        if not sets:
            return _BLOCK_PA.empty_table()
        keys, n = np.unique(np.concatenate(sets), return_counts=True)
        return _blocks(table["_g"][0].as_py(), _split(keys, buckets), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(n, 255).astype(np.uint8))

    return send


def _commonness(table: pa.Table) -> pa.Table:
    """A bucket: each group gets back its shingles that two sets hold, with the logarithm of how many do."""
    rows = [np.frombuffer(k, dtype=np.uint32) for k in table["_keys"].to_pylist()]
    held = [np.frombuffer(m, dtype=np.uint8) for m in table["_more"].to_pylist()]
    keys, n = np.concatenate(rows), np.concatenate(held).astype(np.int64)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    lead = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, total = keys[lead], np.add.reduceat(n, lead)
    level = np.log2(total).astype(np.uint8)
    found = [level[np.searchsorted(keys, r)] for r in rows]
    back = [(r[x > 0].tobytes(), x[x > 0].tobytes()) for r, x in zip(rows, found)]
    return pa.table({"_bucket": table["_bucket"], "_g": table["_g"], "_keys": [k for k, _ in back], "_more": [m for _, m in back]}, schema=_BLOCK_PA).filter(pa.array([len(k) > 0 for k, _ in back], pa.bool_()))


def _stars(keys: np.ndarray, ids: np.ndarray):
    """Each key once with its least id, and distinct edges from the other ids to that one."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    lead = np.flatnonzero(new)
    hub = np.repeat(ids[lead], np.diff(np.concatenate([lead, [len(keys)]])))
    off = ids != hub
    return keys[lead], ids[lead], np.unique(np.stack([ids[off], hub[off]], axis=1), axis=0)


def prefixes(n: int, percent: int) -> tuple[int, int]:
    """Lengths of the index and of the probe prefix of a set of n shingles."""
    return n - -(-2 * percent * n // (100 + percent)) + 1, n - -(-percent * n // 100) + 1


def _vector(s: np.ndarray) -> bytes:
    """Shingles per group, a byte each where that holds them; the 256 groups of a short set are sums of the 1024 of a long one."""
    groups = 256 if len(s) <= 2000 else 1024
    n = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return n.astype(np.uint8 if n.max() < 256 else np.int32).tobytes()


def _counts(vectors: list[bytes]) -> np.ndarray:
    """The vectors as rows, all with as many groups as the shortest."""
    rows = [np.frombuffer(v, np.uint8 if len(v) <= 1024 else np.int32) for v in vectors]
    groups = min(map(len, rows))
    return np.stack([r.reshape(-1, groups).sum(axis=0, dtype=np.int32) for r in rows])


def _sender(size: int, percent: int, buckets: int):
    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _SENT_PA.empty_table()
        shared, level = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        if answers.num_rows:
            shared = np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(k, dtype=np.uint32).astype(np.uint64) for b, k in zip(answers["_bucket"].to_pylist(), answers["_keys"].to_pylist())])
            level = np.concatenate([np.frombuffer(m, dtype=np.uint8) for m in answers["_more"].to_pylist()])
            order = np.argsort(shared)
            shared, level = shared[order], level[order]
        rows, keys, owners, none = [], [], [], (None,) * 4
        for i, s, d, lead in _leads(table, size):
            rows.append((0, None, i, len(s), *d, lead, *none))
            if not lead or not len(shared):
                continue
            short = _short(s, buckets)
            at = np.minimum(np.searchsorted(shared, short), len(shared) - 1)
            common = np.where(shared[at] == short, level[at], 0)
            index, probe = prefixes(len(s), percent)
            first = np.lexsort((s, common))[:probe]
            met = common[first] > 0
            if met.any():
                meeting, indexed = s[first[met]], np.flatnonzero(met) < index
                rows.append((3, None, i, len(s), *d, None, s.tobytes(), indexed.astype(np.uint8).tobytes(), meeting.tobytes(), _vector(s)))
                keys.append(meeting[indexed])
                owners.append(np.full(len(keys[-1]), i, np.int64))
        if keys and len(flat := np.concatenate(keys)):
            key, hub, edges = _stars(flat, np.concatenate(owners))
            bucket = _split(key, buckets)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            rows += [(1, int(bucket[a]), None, None, None, None, None, key[a:b].tobytes(), hub[a:b].tobytes(), None, None) for a, b in zip(cuts[:-1], cuts[1:])]
            if len(edges):
                rows.append((2, *(None,) * 6, edges[:, 0].tobytes(), edges[:, 1].tobytes(), None, None))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), _SENT_PA)], schema=_SENT_PA)

    return send


def _meet(table: pa.Table) -> pa.Table:
    cols = [np.concatenate([np.frombuffer(x, dtype=t) for x in table[c].to_pylist()]) for c, t in (("keys", np.uint64), ("ids", np.int64))]
    edges = _stars(*cols)[2].reshape(-1, 2)
    return pa.table([pa.array(edges[:, 0]), pa.array(edges[:, 1])], schema=_EDGE_PA)


def _unpack(batches):
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.record_batch([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64))], schema=_EDGE_PA)


def _meetings(batches):
    """A row for each shingle that a set meets others in."""
    for batch in batches:
        meets = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        row = np.repeat(np.arange(batch.num_rows), [len(x) for x in meets])
        flags = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8)
        ids, component = (batch.column(c).to_numpy()[row] for c in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(meets) if meets else np.zeros(0, np.int64)), pa.array(ids), pa.array(component), pa.array(flags > 0)], names=["x", "doc_id", "component", "indexed"])


class CountTree:
    """A packed R-tree over count vectors that answers which points may overlap a query enough."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, percent: int, fan: int = 16):
        self.percent, self.fan = percent, fan
        self.order = np.lexsort((*counts[:, :4].T, sizes))
        self.levels = [(counts[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[0][1]) > fan:
            high, small, large = self.levels[0]
            at = np.arange(0, len(small), fan)
            self.levels.insert(0, (np.maximum.reduceat(high, at), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at)))

    def near(self, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The points, and the bound on the overlap with each."""
        p = self.percent
        least, most = -(-p * size // 100), 100 * size // p
        at = np.arange(len(self.levels[0][1]))
        for depth, (high, small, large) in enumerate(self.levels):
            if depth:
                at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
                at = at[at < len(small)]
            at = at[(small[at] <= most) & (large[at] >= least)]
            bound = np.minimum(high[at], counts).sum(axis=1, dtype=np.int64)
            ok = bound * (100 + p) >= p * (size + np.maximum(small[at], least))
            at, bound = at[ok], bound[ok]
        return self.order[at], bound


def _pairs(held: np.ndarray, asks: np.ndarray, col: dict, counts: np.ndarray, percent: int, depth: int):
    """Candidate pairs of an asker (by its index prefix) and a held set in another component, the best `depth` of each asker; and whether more there are."""
    tree, out, more = CountTree(counts[held], col["n"][held], percent), [], False
    for q in asks:
        near, bound = tree.near(counts[q], int(col["n"][q]))
        c = held[near]
        # the smaller one asks; of two equal ones that both may, the one of the smaller id
        ok = (col["n"][c] > col["n"][q]) | ((col["n"][c] == col["n"][q]) & ((col["doc_id"][c] > col["doc_id"][q]) | ~col["indexed"][c]))
        ok &= col["component"][c] != col["component"][q]
        c, bound = c[ok], bound[ok]
        if len(c) > depth:
            c, more = c[np.argsort(-bound, kind="stable")[:depth]], True
        out.append(np.stack([col["doc_id"][c], np.full(len(c), col["doc_id"][q])], axis=1))
    return out, more


def _searcher(percent: int, depth: int):
    def search(table: pa.Table) -> pa.Table:
        col = {c: table[c].to_numpy() for c in ("x", "i", "j", "role", "doc_id", "component", "n", "indexed")}
        vectors = table["counts"].to_pylist()
        key = np.stack([col["x"], col["i"], col["j"]], axis=1)
        order, out, more = np.lexsort((col["doc_id"], col["j"], col["i"], col["x"])), [], False
        key = key[order]
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(order)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows = order[a:b]
            own = {c: v[rows] for c, v in col.items()}
            counts = _counts([vectors[r] for r in rows])
            held, asks = np.flatnonzero(own["role"] != ASKS), np.flatnonzero(own["role"] != HELD)
            if len(held) and len(asks):
                found, left = _pairs(held, asks, own, counts, percent, depth)
                out += found
                more |= left
        # one row of nulls says that pairs were left out
        flat = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        last = [pa.nulls(1, pa.int64())] if more else []
        return pa.table([pa.chunked_array([pa.array(flat[:, k]), *last]) for k in (0, 1)], schema=_EDGE_PA)

    return search


def _verifier(percent: int):
    def verify(table: pa.Table) -> pa.Table:
        col = {c: table[c].to_numpy() for c in ("hub", "part", "doc_id")}
        order, out = np.lexsort((col["doc_id"], col["part"], col["hub"])), []
        key = np.stack([col["hub"], col["part"]], axis=1)[order]
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(order)]])
        blobs = table["shingles"].combine_chunks()
        of = lambda r: np.frombuffer(blobs[int(r)].as_buffer(), dtype=np.uint64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows, hub = order[a:b], int(key[a][0])
            hubs = [of(r) for r in rows if col["doc_id"][r] == hub]
            for r in rows:
                if (i := int(col["doc_id"][r])) != hub:
                    own = of(r)
                    for other in hubs:
                        small, large = (own, other) if len(own) < len(other) else (other, own)
                        both = int(in_sorted(small, large).sum())
                        if 100 * both >= percent * (len(own) + len(other) - both):
                            out.append((i, hub))
                            break
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], schema=_EDGE_PA)

    return verify


def _verified(edges: DataFrame, sets: DataFrame, percent: int, work: int = 1 << 19) -> DataFrame:
    """Those of the edges whose ends are linked. A part of a hub's partners has about `work` shingles, or is one set."""
    sizes = sets.groupBy("doc_id").agg(F.sum("n").alias("n"))
    sized = materialize(edges.distinct().join(sizes, F.col("a") == F.col("doc_id")).select("a", "b", "n"), "candidates")
    total = int(sized.agg(F.sum("n")).first()[0] or 0)
    load = sized.groupBy("b").agg(F.ceil(F.sum("n") / work).alias("parts")).hint("rebalance")
    dealt = sized.join(load, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    every = F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))
    wanted = dealt.select(F.col("a").alias("doc_id"), F.col("b").alias("hub"), "part").union(load.select(F.col("b").alias("doc_id"), F.col("b").alias("hub"), every.alias("part")))
    units = sets.select("doc_id", "shingles").join(wanted, "doc_id")
    units = units.withColumn("bucket", F.pmod(F.xxhash64("hub", "part"), F.lit(max(shuffle_partitions(sets.sparkSession), total // (1 << 21)))))
    return units.groupBy("bucket").applyInArrow(_verifier(percent), "a long, b long")


def _candidates(sets: DataFrame, percent: int, block: int, depth: int) -> DataFrame | None:
    """Pairs of sets in different components that may be linked, with a row of nulls where more there are; None if there can be none."""
    entries = sets.select("doc_id", "component", "meets", "flags").mapInArrow(_meetings, "x long, doc_id long, component long, indexed boolean")
    entries = materialize(entries, "meetings")
    shares = entries.groupBy("x", "component").agg(F.count("*").alias("k"), F.count_if("indexed").alias("a"))
    mixed = shares.groupBy("x").agg(F.count("*").alias("c"), F.sum("k").alias("m"), F.sum("a").alias("asks"), F.max(F.struct("k", "component", "a")).alias("most")).where("c > 1 and asks > 0")
    mixed = materialize(mixed.select("x", "m", "asks", "most"), "mixed")
    total = mixed.agg(F.sum("m")).first()[0]
    if not total:
        return None
    # of a large meeting, parts 0, 1, ... are outside its largest component, and -1, -2, ... within
    blocks = lambda n: F.ceil(n / block).cast("int")
    m, k, asks, own_asks, inner = F.col("m"), F.col("most.k"), F.col("asks"), F.col("most.a"), F.col("component") == F.col("most.component")
    held_by, held_own, ask_by, ask_own = blocks(m - k), blocks(k), blocks(asks - own_asks), blocks(own_asks)
    part = lambda by, own: F.when(inner, -1 - F.pmod(F.xxhash64("doc_id"), own)).otherwise(F.pmod(F.xxhash64("doc_id"), by)).cast("int")
    span = lambda lo, n: F.when(n > lo, F.sequence(lo, n - 1)).otherwise(F.array().cast("array<int>"))
    as_held = F.transform(span(F.when(inner, 0).otherwise(-ask_own), ask_by), lambda j: F.struct(F.lit(HELD).alias("role"), part(held_by, held_own).alias("i"), j.alias("j")))
    as_asker = F.transform(span(F.when(inner, 0).otherwise(-held_own), held_by), lambda i: F.struct(F.lit(ASKS).alias("role"), i.alias("i"), part(ask_by, ask_own).alias("j")))
    none = F.array().cast("array<struct<role:int,i:int,j:int>>")
    whole = F.array(F.struct(F.when(F.col("indexed"), BOTH).otherwise(HELD).alias("role"), F.lit(0).alias("i"), F.lit(0).alias("j")))
    roles = F.when(m <= block, whole).otherwise(F.concat(as_held, F.when(F.col("indexed"), as_asker).otherwise(none)))
    units = entries.join(mixed.hint("rebalance"), "x").select("x", "doc_id", "component", "indexed", "m", F.explode(roles).alias("u")).select("x", "doc_id", "component", "indexed", "m", "u.*")
    small = F.pmod(F.xxhash64("x"), F.lit(max(shuffle_partitions(sets.sparkSession), int(total) // 50_000)))
    units = units.withColumn("bucket", F.when(m > block, F.xxhash64("x", "i", "j").bitwiseOR(F.lit(1 << 62))).otherwise(small)).drop("m")
    units = units.join(sets.select("doc_id", "n", "counts"), "doc_id")
    return units.groupBy("bucket").applyInArrow(_searcher(percent, depth), "a long, b long")


def ngram_jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = 1024, depth: int = 16, group_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs.

    Sets of `size`-word shingles (words lower-cased A-Z, split at ASCII white space; the
    whole sequence where there are fewer words) link where 100 * overlap >= percent * union;
    component_id is the smallest id reachable by links, the row's own included.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    dealt, buckets = deal(plain, group_bytes)
    common = dealt.groupBy("_g").applyInArrow(_holders(size, buckets), _BLOCK).groupBy("_bucket").applyInArrow(_commonness, _BLOCK)
    sent = materialize(dealt.groupBy("_g").cogroup(common.groupBy("_g")).applyInArrow(lean(_sender(size, percent, buckets)), _SENT), "shingles")

    members = sent.where("kind = 0").select("doc_id", "n", "d1", "d2", "lead")
    # dealt anew, so that Spark can split a text that very many rows hold
    equal = members.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies").hint("rebalance")
    # an id with several texts stands for itself beside the first ids of its texts
    several = members.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).where("x <> y").select("doc_id", F.lit(True).alias("several"))
    mapped = members.join(equal, ["d1", "d2", "n"], "left").withColumn("rep", F.coalesce("rep", "doc_id")).join(several.hint("rebalance"), "doc_id", "left")
    mapped = materialize(mapped.withColumn("node", F.when(F.col("several"), F.col("doc_id")).otherwise(F.col("rep"))), "members")
    moved = mapped.where("lead and node <> doc_id").select("doc_id", "node").distinct()
    same = mapped.where("several and rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    held = sent.where("kind = 3").join(mapped.where("lead and rep <> doc_id").select("doc_id", "d1").distinct(), ["doc_id", "d1"], "left_anti")
    held = held.select("doc_id", "n", F.col("keys").alias("shingles"), F.col("ids").alias("flags"), "meets", "counts")
    met = sent.where("kind = 1").select("bucket", "keys", "ids").groupBy("bucket").applyInArrow(_meet, "a long, b long")
    met = met.union(sent.where("kind = 2").select("keys", "ids").mapInArrow(_unpack, "a long, b long"))
    for end in ("a", "b"):
        met = met.join(moved.withColumnsRenamed({"doc_id": end, "node": "_node"}), end, "left").withColumn(end, F.coalesce("_node", end)).drop("_node")
    hubs = met.where("a <> b").groupBy(F.greatest("a", "b").alias("a")).agg(F.min(F.least("a", "b")).alias("b"))
    links = materialize(_verified(hubs, held, percent).union(same), "links")
    while True:
        release(docs.sparkSession)
        linked = materialize(connected_components(links), "components")
        now = held.join(linked.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        pairs = _candidates(now, percent, block, depth)
        if pairs is None:
            break
        pairs = materialize(pairs, "pairs")
        links = materialize(links.union(_verified(pairs.where("a is not null"), held, percent)), "links")
        if not pairs.where("a is null").limit(1).count():
            linked = connected_components(links)
            break
        depth *= 16
    found = mapped.select("doc_id", "n", "node").join(linked.withColumnRenamed("id", "node"), "node", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))
