import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from siftwell.llm.periodic_runs import find_runs, periodic_runs
from siftwell.llm.queries import op12_periodic_runs, planted_repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=12):
    """Every stretch with every period, by the definition."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((a, q, b) for (a, b), q in found.items())


def contract(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = [(a, b - a, q) for a, q, b in brute(w)]
    gone = {k for a, length, q in runs for k in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_fuzzed_words(least):
    rng, docs = random.Random(least), []
    for k in range(250):
        size, letters = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 9])
        w = [rng.randrange(letters) for _ in range(size)]
        if k % 3 == 0 and size > 4:
            a, p = rng.randrange(size), rng.randint(1, size // 2)
            w = [w[i] if i < a else w[min(size - 1, a + (i - a) % p)] for i in range(size)]
        docs.append(w)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    docs += [fib[-1], [5] * 300, [1, 2] * 100 + [3] * 100 + [1, 2] * 100]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    rows = find_runs(np.array(sum(docs, []), dtype=np.int64), bounds, least, step=97)
    for k, d in enumerate(docs):
        own = rows[(rows[:, 0] >= bounds[k]) & (rows[:, 0] < bounds[k + 1])]
        assert sorted((a - bounds[k], q, b - bounds[k]) for a, b, q in own.tolist()) == brute(d, least)


def test_long_runs_stay_cheap():
    ids = np.concatenate([np.zeros(300_000, np.int64), np.tile(np.arange(7_001), 40), np.arange(20_000, 120_000)])
    rows = find_runs(ids, np.array([0, len(ids)]))
    assert rows.tolist() == [[0, 300_001, 1], [300_000, 580_040, 7001]]


def rows_of(seed=3, n=80):
    rng, rows = random.Random(seed), []
    for k in range(n):
        w = [rng.choice(["ab", "b", "Été", "日本", "c" * 300, "c" * 299]) for _ in range(rng.randint(0, 60))]
        if k % 4 == 0:
            w += w[-3:] * rng.randint(1, 6)
        rows.append((k, rng.choice([" ", "\n\n", "\t ", "  "]).join(w), k))
    return rows + [(200, None, 1), (201, "", 1), (202, " \n", 1), (203, "x " * 40, 1), (3, rows[3][1], 9), (3, rows[3][1], 9), (None, "y z " * 9, 1)]


def test_query_equals_brute_force(spark, tmp_path):
    rows = rows_of()
    spark.createDataFrame(rows, "doc_id long, text string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_periodic_runs(spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [contract(*r[:2]) if r[0] is not None else None for r in rows]
    assert sorted(map(repr, (tuple(r)[:8] for r in got.where("doc_id is not null").collect()))) == sorted(map(repr, filter(None, want)))
    assert got.where("doc_id is null").first().n_runs == 1
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in rows)


def test_planting():
    ids = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0]
    assert planted_repetition(ids[0], 0) is None and planted_repetition(None, 5) is None
    assert all(planted_repetition(k, 30) is not None for k in ids)


def test_columns_empty_table_and_long_text(spark):
    docs = spark.createDataFrame([(1, "p q " * 60_000 + "r", "x")], "doc_id long, text string, _row string")
    (row,) = periodic_runs(docs).collect()
    assert (row["_row"], row.n_words, row.n_dropped, row.collapsed_text) == ("x", 120_001, 119_998, "p q r")
    assert [tuple(r) for r in row.runs] == [(0, 120_000, 2)]
    assert periodic_runs(docs.where("doc_id < 0")).collect() == []
