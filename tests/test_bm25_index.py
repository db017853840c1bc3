"""The block index against the plain formula: nothing is lost to bounds, and blocks are passed over."""

import math
import random
import re
from collections import Counter

from siftwell.operators import bm25_index, retrieval


def plain(docs, queries, k, k1=1.5, b=0.75):
    words = [(d, re.findall("[a-z0-9]+", (t or "").lower())) for d, t in docs]
    average = sum(len(w) for _, w in words) / len(words) or 1.0
    df, out = Counter(t for _, w in words for t in set(w)), []
    for q, text in queries:
        scored = []
        for d, w in words:
            held = Counter(w)
            s = sum(math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * held[t] * (k1 + 1) / (held[t] + k1 * (1 - b + b * len(w) / average)) for t in re.findall("[a-z0-9]+", (text or "").lower()) if t in held)
            if s > 0:
                scored.append((-round(s, 9), d))
        out += [(q, r, d, round(-s, 6)) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def corpus(n=600):
    rng = random.Random(6)
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(900)]
    docs = [(k, " ".join(rng.choices(common, k=rng.randint(0, 40)) + rng.choices(rare, k=rng.randint(0, 6)))) for k in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "C1 c1, c1")], [(k, " ".join(rng.choices(rare, k=3) + rng.choices(common, k=2))) for k in range(15)] + [(50, None), (51, "nowhere"), (52, "c1 c1")]


def test_search_equals_the_formula_and_passes_over_blocks(spark, tmp_path):
    docs, queries = corpus()
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    index = bm25_index.write_index(frame, f"{tmp_path}/index", per_part=16)
    again = bm25_index.open_index(spark, f"{tmp_path}/index")
    terms = bm25_index.ask(asked)
    got = bm25_index.search(again, terms, 3, first=2)
    want = plain(docs, queries, 3)
    assert sorted((r[0], r[1], r[2], round(r[3], 6)) for r in got.collect()) == want
    assert sorted((r[0], r[1], r[2], round(r[3], 6)) for r in retrieval.bm25(frame, asked).collect()) == want
    weighted, early, late = bm25_index.plan_search(index, terms, 3, 2)
    every = bm25_index.part_bounds(index, weighted).count()
    assert early.count() + late.count() < 0.7 * every
    # a very common term lies in many blocks, none of which is large
    sizes = [r.n for r in index.blocks.where("term = 'c1'").collect()]
    assert len(sizes) > 20 and max(sizes) <= 60


def test_more_terms_than_a_literal_set(spark, tmp_path, monkeypatch):
    docs, queries = corpus(80)
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    monkeypatch.setattr(bm25_index, "LITERAL_TERMS", 5)
    assert sorted((r[0], r[1], r[2], round(r[3], 6)) for r in retrieval.bm25(frame, asked).collect()) == plain(docs, queries, 3)


def test_empty_corpus_and_queries(spark):
    frame, asked = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert retrieval.bm25(frame.where("doc_id > 1"), asked).collect() == []
    assert retrieval.bm25(frame, asked.where("item_id > 1")).collect() == []
    assert [r[:3] for r in retrieval.bm25(frame, asked).collect()] == [(1, 1, 1)]
