"""The pipeline's stages, each on its own input, against brute force; and what its queries need to be registered."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from siftwell.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """The input of each stage, and the last one's output."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        seen.append([r.asDict() for r in docs.collect()])
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
    return [*seen, [r.asDict() for r in docs.collect()]]


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "substring_dedup", "decontamination", "packing"]
    for rows in stages[:5]:
        assert list(rows[0]) == corpus_pipeline.COLUMNS


def test_toxic_documents_go(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ({r["doc_id"] for r in rows} for rows in stages[:2])
    gone = before - after
    assert after <= before and gone
    assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(before)
    assert sum(labels.get(i) == 1 for i in gone) >= 0.8 * sum(labels.get(i) == 1 for i in before)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[p : p + 5]) for p in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def test_one_document_of_each_near_duplicate_group_stays(stages):
    rows = {r["doc_id"]: shingles(r["text"]) for r in stages[1]}
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if rows[a] and 100 * len(rows[a] & rows[b]) >= 80 * len(rows[a] | rows[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r["doc_id"] for r in stages[2]} == {i for i in ids if find(i) == i}


def test_repeated_passages_go_once(stages):
    first = {}
    for r in stages[2]:
        w = WORD.findall(r["text"] or "")
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            first[k] = min(first.get(k, r["doc_id"]), r["doc_id"])
    after = {r["doc_id"]: r for r in stages[3]}
    assert len(after) == len(stages[2])
    for r in stages[2]:
        w = WORD.findall(r["text"] or "")
        gone = set()
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < r["doc_id"]:
                gone |= set(range(p, p + 50))
        own = after[r["doc_id"]]
        assert own["text"] == (" ".join(x for k, x in enumerate(w) if k not in gone) if gone else r["text"])
        assert own["n_chars"] == (len(own["text"]) if gone else r["n_chars"])


def test_contaminated_documents_go(spark, stages):
    own = lambda t: re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [own(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def hit(words):
        for b in items:
            for shift in range(-len(b) + 13, len(words) - 12):
                same = [0 <= shift + k < len(words) and words[shift + k] == x for k, x in enumerate(b)]
                inside = [0 <= shift + k < len(words) for k in range(len(b))]
                if any(all(inside[k : k + 13]) and sum(same[k : k + 13]) >= 11 for k in range(len(b) - 12)):
                    return True
        return False

    short = [r for r in stages[3] if len(r["text"] or "") < 3000]
    kept = {r["doc_id"] for r in stages[4]}
    assert all((r["doc_id"] in kept) != hit(own(r["text"])) for r in short[:60])
    whole = [" ".join(b) for b in items]
    for r in stages[3]:
        t = " ".join(own(r["text"]))
        if any(b in t for b in whole):
            assert r["doc_id"] not in kept


def test_everything_is_packed(stages):
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in stages[4]}
    packed, bins = Counter(dict.fromkeys(size, 0)), Counter()
    for r in stages[5]:
        packed[r["doc_id"]] += r["n_words"]
        bins[r["bin_id"]] += r["n_words"]
    assert dict(packed) == size and max(n for b, n in bins.items() if b is not None) <= 2048


def test_queries_of_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_against_its_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    assert rows
    if name in queries.ORACLE_SQL:
        c = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = c.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
        assert Counter(map(tuple, rows)) == Counter(want)


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows, a clashing extra column, and no rows at all."""
    long = " ".join(f"w{k}" for k in range(30000))
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (3, long, None, "s", 9, 1), (3, long, None, "s", 9, 1), (4, long + " end", "en", None, 9, 1), (None, "some words here", "en", "s", 3, 1), (None, "some words here", "en", "s", 3, 1), (6, "one two", "en", "s", 7, 1), (7, "one two", "en", "s", 7, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _g int"
    want = [9, 6, 6, 6]
    for given, counts in ((rows, want), ([], [0] * 4)):
        docs = spark.createDataFrame(given, schema)
        for (_, stage), n in zip(corpus_pipeline.STAGES, counts):
            docs = stage(spark, docs, SF)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert docs.columns == corpus_pipeline.COLUMNS and docs.count() == n
        out = corpus_pipeline.pack(spark, docs, SF).collect()
        assert {r.doc_id for r in out} == {r.doc_id for r in docs.collect()}
        assert sum(r.n_words for r in out) == (30000 + 3 + 3 + 2 if given else 0)
