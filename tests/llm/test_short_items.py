"""op8 and the pipeline find short benchmark items: of 8 to 12 words with one that differs, shorter ones as they are."""

import random
from collections import Counter

import corpus_pipeline
from siftwell.llm import queries


def brute(doc, item):
    n = len(item)
    lost = 2 if n >= 13 else 1 if n >= 8 else 0
    w = min(13, n)
    return n > 0 and any(sum(a != b for a, b in zip(doc[p : p + w], item[q : q + w])) <= lost for p in range(len(doc) - w + 1) for q in range(n - w + 1))


def test_short_items_are_found(spark, tmp_path):
    rng = random.Random(3)
    clean = lambda n: [f"v{rng.randrange(400)}" for _ in range(n)]
    items = [clean(n) for n in (1, 2, 4, 7, 8, 9, 11, 12, 13, 20)]
    docs = [clean(60), []]
    for item in items:
        for changes in (0, 1, 2, 3):
            for at in range(len(item)):
                copy = list(item)
                for k in range(min(changes, len(item))):
                    copy[(at + 4 * k) % len(item)] = "zzz"
                docs.append(clean(5) + copy + clean(rng.randint(0, 5)))
    spark.createDataFrame([(k, " ".join(d), "en", "s", 1) for k, d in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {k: [j for j, i in enumerate(items) if brute(d, i)] for k, d in enumerate(docs)}
    got = queries.op8_decontamination(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_items, r.first_item_id) for r in got) == Counter((k, len(x), x[0] if x else -1) for k, x in want.items())
    kept = corpus_pipeline.drop_contaminated(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {k for k, x in want.items() if not x}
