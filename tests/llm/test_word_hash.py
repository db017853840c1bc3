"""Words that a polynomial modulo a power of two cannot tell apart, and windows that share a 64-bit key."""

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import textkernel
from siftwell.llm.ngram_jaccard import ngram_jaccard_components
from siftwell.llm.substring_dedup import _first_of, _place, substring_dedup

SWAP = str.maketrans("ab", "ba")


def thue_morse(levels):
    x = "a"
    for _ in range(levels):
        x += x.translate(SWAP)
    return x, x.translate(SWAP)


@pytest.mark.parametrize("levels", [3, 8, 9, 10, 12])
def test_words_differ(levels):
    x, y = thue_morse(levels)
    ((_, _, w),) = textkernel.words(pa.array([f"{x} {y} {x}"]), textkernel.SPACED)
    assert w.hash[0] == w.hash[2] != w.hash[1]


def test_case_and_neighbours():
    texts = ["ABCDEFGHi " + "Z" * 300, "abcdefghI\t" + "z" * 300, "abcdefghi", "abcdefgh", "a" * 256, "A" * 256]
    low = [h for _, _, w in textkernel.words(pa.array(texts), textkernel.SPACED_LOWER, limit=16) for h in w.hash.tolist()]
    assert low[0] == low[2] == low[4] and low[1] == low[3] and low[6] == low[7] and len(set(low)) == 4
    high = [h for _, _, w in textkernel.words(pa.array(texts), textkernel.SPACED) for h in w.hash.tolist()]
    assert len(set(high)) == 8


def test_dedup_and_links(spark):
    x, y = thue_morse(10)
    tail = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, f"{x} {tail}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(docs, 13).collect()} == {1: 0, 2: 0, 3: 13}
    docs = spark.createDataFrame([(1, " ".join([x] * 3)), (2, " ".join([y] * 3))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_jaccard_components(docs, 3, 90).collect()} == {1: 1, 2: 2}


def test_equal_keys_with_different_checks():
    keys = np.array([7, 7, 9, 7, 9], dtype=np.uint64)
    checks = np.array([2, 1, 5, 1, 5], dtype=np.uint32)
    k, c, least, several = _first_of(keys, checks, np.array([4, 8, 3, 6, 3], dtype=np.int64))
    assert (k.tolist(), c.tolist(), least.tolist(), several.tolist()) == ([7, 7, 9], [1, 2, 5], [6, 4, 3], [True, False, False])
    assert _place(k, c, np.array([7, 9, 7, 7], np.uint64), np.array([2, 5, 1, 3], np.uint32)).tolist() == [1, 2, 0, -1]
