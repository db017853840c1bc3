import random
import re
from collections import Counter

import numpy as np

from siftwell.llm import tiered_search as ts
from siftwell.llm.tiered_search import QueryBlock, query_blocks, search_shard, tiered_search, tiers_of, weight

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=20):
    docs = [(d, split(t)) for d, t in docs]
    held = [Counter(w) for _, w in docs]
    n_docs, total = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df = Counter(t for h in held for t in h)
    out = []
    for i, text in items:
        asked, scored = Counter(split(text)), []
        for (d, w), h in zip(docs, held):
            s = sum(x * weight(n_docs, df[t]) * ((10**9 * h[t]) // (1000 * h[t] + 12 * (75 + 25 * len(w) * n_docs // total))) for t, x in asked.items() if t in h)
            if s > 0:
                scored.append((-s, float("inf") if d is None else d, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"t{k}" for k in range(60)] + ["Été", "ÉTÉ", "É", "日本", "x1y", "AB", "ab"]
    power = [1 / (1 + k) for k in range(len(vocab))]
    return [(k, rng.choice([" ", ", ", "\x00", "\n"]).join(rng.choices(vocab, power, k=rng.choice([0, 1, 5, 30, 200])))) for k in range(n)], vocab, rng


def test_equals_brute_force(spark):
    docs, vocab, rng = corpus(1, 300)
    docs += [(500, None), (501, ""), (502, " ,; "), (None, "t1 t2 t3"), (7, "t1 t50"), (7, "t1 t50"), (503, "t5 " * 20000), (504, "t1"), (505, "t1")]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 20])))) for k in range(12)] + [(90, None), (91, ""), (92, "nowhere"), (93, "t1 t1 t1 nowhere"), (5, "T1"), (94, "Été. AB")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", ts.F.lit("x")).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", ts.F.lit(1))
    for options in ({}, {"depths": (1, 3), "limit": 2000}, {"depths": (2, 4), "limit": 500, "group_bytes": 300}, {"k": 3, "limit": 1000}):
        got = tiered_search(frame, asked, **options)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, options.get("k", 20))


def test_no_documents_or_items(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert tiered_search(docs.where("doc_id > 1"), items).collect() == [] and tiered_search(docs.where("doc_id > 5"), items).collect() == []
    assert tiered_search(docs, items.where("item_id > 1")).collect() == []
    assert tiered_search(docs, items.withColumn("text", ts.F.lit(" . "))).collect() == []
    assert [tuple(r) for r in tiered_search(docs, items).collect()] == [r for r in brute([(1, "a b"), (2, None)], [(1, "a")])]


def shard(rng, docs, terms, postings):
    doc, term = (x.astype(np.int32) for x in np.unique(np.stack([rng.integers(0, docs, postings), (terms * rng.random(postings) ** 3).astype(int)]), axis=1))
    return doc, term, (rng.random(len(doc)) ** 4 * 999_999).astype(np.int32) + 1


def test_lower_tiers_are_passed_over_and_nothing_is_lost():
    rng = np.random.default_rng(2)
    ids, weights = np.arange(500) * 3, rng.integers(1, 9000, 80)
    doc, term, impact = shard(rng, 500, 80, 12000)
    parts, rest = tiers_of(doc, term, impact, (8, 64))
    assert sum(len(p[0]) for p in parts) == len(doc) and all(len(r) for r in rest)
    first = np.arange(41) * 6
    asked, many = np.sort(rng.permuted(np.tile(np.arange(80), (40, 1)), axis=1)[:, :6], axis=1).ravel(), rng.integers(1, 4, 240)
    (block,) = query_blocks(first, asked, many, weights)
    exact = np.zeros((40, 500), dtype=np.int64)
    for q in range(40):
        for t, m in zip(asked[first[q] : first[q + 1]], many[first[q] : first[q + 1]]):
            on = term == t
            exact[q, doc[on]] += m * weights[t] * impact[on].astype(np.int64)
    for share, most in ((0.0, 3), (1.0, 3), (2.0, 3), (8.0, 2.5)):
        floor = np.maximum(1, (np.sort(exact, axis=1)[:, -20] * share).astype(np.int64))
        (query, found, score), depth = search_shard(block, floor, ids, parts, rest)
        want = {(q, int(ids[d]), int(exact[q, d])) for q, d in zip(*np.nonzero(exact >= floor[:, None]))}
        assert set(zip(query.tolist(), found.tolist(), score.tolist())) == want and depth.mean() <= most
    assert depth.min() < 3


def test_sums_beyond_doubles():
    gain = np.array([2**40, 2**40 + 1, 3], dtype=np.int64)
    block = QueryBlock(0, 1, np.zeros(3, np.int64), np.arange(3), gain)
    assert block.kind is np.int64
    scores = np.zeros((1, 2), dtype=np.int64)
    block.add(scores, np.array([0, 0, 1, 1], np.int32), np.array([0, 1, 1, 2], np.int32), np.array([999_999, 999_998, 7, 1], np.int32), np.ones(1, bool))
    assert scores.tolist() == [[2**40 * 999_999 + (2**40 + 1) * 999_998, 7 * (2**40 + 1) + 3]]
