"""Near duplicates are removed by row where one id has several texts."""

from collections import Counter

import corpus_pipeline


def test_two_texts_of_one_id(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(60))
    near = lambda c: text(c) + " more"
    rows = [
        (1, text("a")), (5, near("a")), (5, text("b")),  # b has no copy
        (3, text("c")), (3, text("d")), (7, near("c")), (8, near("d")),  # one of each group stays, that of id 3
        (10, text("e")), (10, near("e")), (10, text("e")), (2, text("f")), (9, near("f")),
        (11, text("g")), (11, text("h")), (12, near("g")), (12, near("h")), (13, None), (13, text("i")), (None, text("a")), (None, text("a")),
    ]
    frame = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, (r.text or "")[:1]) for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect())
    assert got == Counter([(1, "a"), (5, "b"), (3, "c"), (3, "d"), (10, "e"), (2, "f"), (11, "g"), (11, "h"), (13, ""), (13, "i"), (None, "a"), (None, "a")])


def test_equal_rows_fill_several_groups(spark):
    from siftwell.llm.ngram_jaccard import ngram_jaccard_components
    from siftwell.llm.substring_dedup import deal, substring_dedup

    long = " ".join(f"w{k}" for k in range(40))
    rows = [(7, long)] * 3000 + [(None, long)] * 500 + [(k, f"{long} own{k}") for k in range(8, 60)] + [(k, f"text {k} alone") for k in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    plain = docs.selectExpr("doc_id as _id", "text as _text")
    sizes = deal(plain, 20_000)[0].where("_id = 7").groupBy("_g").count().collect()
    assert sum(r["count"] for r in sizes) == 3000 and len(sizes) >= 12 and max(r["count"] for r in sizes) < 600
    found = {}
    for r in substring_dedup(docs, 13, with_text=False, group_bytes=20_000).collect():
        found.setdefault(r.doc_id, set()).add((r.n_words, r.n_removed))
    assert found[7] == {(40, 0)} and found[None] == {(40, 40)} and all(found[k] == {(41, 40)} for k in range(8, 60)) and found[100] == {(3, 0)}
    assert substring_dedup(docs, 13, with_text=False, group_bytes=20_000).count() == len(rows)
    parts = ngram_jaccard_components(docs, 3, 90, group_bytes=20_000)
    assert parts.count() == len(rows) and {(r.doc_id, r.component_id) for r in parts.where("doc_id < 100").collect()} == {(7, 7), *((k, 7) for k in range(8, 60))}
