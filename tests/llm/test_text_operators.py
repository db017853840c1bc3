import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import decontaminate, textkernel, token_counts
from siftwell.llm.ngram_jaccard import CountTree, ngram_jaccard_components
from siftwell.llm.substring_dedup import level_sizes, substring_dedup

SCHEMA = "doc_id long, text string, _g string, n_words int, kind string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall(text or "")


def corpus(seed=1, n=60):
    """Texts that share passages, near copies, exact copies, nulls, empty and long texts."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["Été", "ÉTÉ", "naïve", "日本", "a"]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(20, 70))] for _ in range(4)]
    rows, base = [], [rng.choice(vocab) for _ in range(150)]
    for k in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if k % 3 == 0:
            words += passages[k % 4] + [rng.choice(vocab) for _ in range(10)]
        if k % 5 == 0:
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((k, rng.choice([" ", "\n", "\t ", "  "]).join(words), "x", k, "y"))
    rows += [(100, None, None, None, None), (101, "", None, None, None), (102, " \n ", None, None, None), (103, "one", None, None, None), (104, "one", None, None, None), (105, " ".join(base) * 40, None, None, None), (0, rows[0][1], "x", 0, "y"), (None, rows[5][1], None, None, None)]
    return rows


def brute_dedup(rows, size):
    ids = [10**18 if r[0] is None else r[0] for r in rows]
    first = {}
    for i, r in zip(ids, rows):
        w = split(r[1])
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, r in zip(ids, rows):
        w = split(r[1])
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < i:
                gone[p : p + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if any(gone) else r[1]))
    return Counter(out)


@pytest.mark.parametrize("size", [13, 50])
def test_substring_dedup_is_brute_force(spark, size):
    rows = corpus()
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA), window=size, group_bytes=2000)
    assert got.columns == ["doc_id", "_g", "kind", "n_words", "n_removed", "kept_sha256", "kept_text"]
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got.collect()) == brute_dedup(rows, size)


def test_levels_double_up_to_the_window():
    for n in (9, 13, 50, 100):
        sizes = level_sizes(n)
        assert sizes[-1] == n and sizes[0] <= 8 and all(a < b <= 2 * a for a, b in zip(sizes, sizes[1:]))


def test_text_operators_on_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(none).count() == 0
    assert ngram_jaccard_components(none).count() == 0
    assert decontaminate.decontaminate(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def brute_components(rows, size, percent):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets, root = [], {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in rows:
        w = split(low(r[1]))
        sets.append({tuple(w[p : p + size]) for p in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                root[y] = x
    return Counter((r[0], len(s), None if r[0] is None else find(r[0])) for r, s in zip(rows, sets))


@pytest.mark.parametrize(("size", "percent", "block", "depth"), [(3, 90, 1024, 8), (5, 80, 1024, 1), (2, 60, 3, 1)])
def test_ngram_jaccard_is_brute_force(spark, size, percent, block, depth):
    rows = corpus(seed=size)
    got = ngram_jaccard_components(spark.createDataFrame(rows, SCHEMA), size, percent, block=block, depth=depth)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, size, percent)


def test_count_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, rng.integers(5, 200)).astype(np.uint64)) for _ in range(200)]
    sets += [np.unique(np.concatenate([s[3:], rng.integers(0, 400, 2).astype(np.uint64)])) for s in sets[:60]]
    sizes = np.array([len(s) for s in sets])
    counts = np.stack([np.bincount((s % 64).astype(int), minlength=64) for s in sets])
    tree = CountTree(counts, sizes, 80)
    for q in range(0, len(sets), 7):
        near = set(tree.near(counts[q], sizes[q])[0].tolist())
        for c, s in enumerate(sets):
            both = len(np.intersect1d(sets[q], s))
            assert 100 * both < 80 * (len(s) + sizes[q] - both) or c in near


def test_words_and_windows():
    texts = ["a b  c", None, "", "Word WORD", "\tx\n", "w" * 3_000_000 + " end"]
    for alphabet, low in ((textkernel.SPACED, False), (textkernel.SPACED_LOWER, True)):
        seen = {}
        for lo, hi, w in textkernel.words(pa.array(texts), alphabet, limit=64):
            for k in range(lo, hi):
                own = split(texts[k])
                a, b = w.bounds[k - lo], w.bounds[k - lo + 1]
                assert b - a == len(own)
                for word, h in zip(own, w.hash[a:b].tolist()):
                    assert seen.setdefault(word.lower() if low else word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_masks_find_every_tolerated_window():
    for window, lost in ((13, 2), (13, 3), (12, 2), (10, 2), (13, 0), (9, 4), (15, 1)):
        assert decontaminate.masks_cover(decontaminate.masks_for(window, lost), window, lost)
    with pytest.raises(ValueError):
        decontaminate.masks_for(3, 3)


def brute_repeats(doc, item, window, lost):
    n = len(item)
    size, lost = min(window, n), lost if n >= window else lost * n // window if n >= 8 else 0
    return n > 0 and any(sum(a != b for a, b in zip(doc[p : p + size], item[q : q + size])) <= lost for p in range(len(doc) - size + 1) for q in range(n - size + 1))


@pytest.mark.parametrize(("window", "lost"), [(13, 2), (13, 3), (10, 2), (9, 1)])
def test_seeds_find_what_brute_force_finds(window, lost):
    rng = random.Random(window + lost)
    for few in (2, 3, 60):  # few different words make very many diagonals
        clean = lambda n, few=few: [f"v{rng.randrange(few)}" for _ in range(n)]
        items = [clean(rng.choice([1, 3, 9, 12, 13, 20, 40])) for _ in range(12)]
        docs = [[]]
        for k in range(80):
            copy = list(items[k % 12])
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "zz"
            docs.append(clean(rng.randint(0, 9)) + copy + clean(rng.randint(0, 9)))
        arrays = decontaminate.seed_arrays(list(range(12)), [" ".join(i) for i in items], window, 8, lost)
        for _, _, w in textkernel.words(pa.array([" ".join(d) for d in docs]), textkernel.ALNUM_LOWER):
            found = decontaminate.SeedTable(arrays, window, lost).found(w)
        assert found == {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if brute_repeats(doc, item, window, lost)}


def test_equal_words_take_little_time():
    import time

    arrays = decontaminate.seed_arrays([1, 2], [" ".join(["same"] * 300), " ".join(["same"] * 9 + ["other"] * 9)], 13, 8)
    (_, _, w), *_ = textkernel.words(pa.array([" ".join(["same"] * 20000)]), textkernel.ALNUM_LOWER)
    begun = time.perf_counter()
    assert decontaminate.SeedTable(arrays, 13, 2).found(w) == {(0, 0)}
    assert time.perf_counter() - begun < 2


def test_decontaminate(spark):
    rng = random.Random(5)
    words = [f"v{k}" for k in range(500)]
    item = [rng.choice(words) for _ in range(30)]
    clean = lambda n: [rng.choice(words) for _ in range(n)]
    changed = list(item)
    for k in (3, 9, 16, 22):
        changed[k] = "zzz"
    broken = [w if k % 4 else "zzz" for k, w in enumerate(item)]
    short = clean(9)
    docs = [(0, " ".join(clean(40) + item + clean(40))), (1, " ".join(clean(5) + changed + clean(9)).upper()), (2, " ".join(clean(90))), (3, None), (4, ""), (5, ", ".join(clean(3) + item[10:24] + clean(3))), (6, " ".join(clean(20) + item[10:20] + clean(20))), (7, " ".join(broken)), (8, " ".join(clean(4) + short + clean(4))), (9, " ".join(clean(4) + short[:8] + clean(4))), (10, " ".join(clean(4) + ["tiny", "item"])), (0, " ".join(item))]
    bench = [(1, " ".join(item)), (2, " ".join(short)), (3, "tiny item"), (4, None), (1, " ".join(item)), (7, " ".join(item))]
    frame = spark.createDataFrame([(i, t, "e", "f") for i, t in docs], "doc_id long, text string, items string, _text string").withColumnRenamed("doc_id", "_row")
    for slices in (1 << 24, 100):
        got = decontaminate.decontaminate(frame, spark.createDataFrame(bench, "item_id long, text string"), slice_bytes=slices, short_items=False)
        found = Counter((r["_row"], tuple(r["items"])) for r in got.collect())
        assert found == Counter([(0, (1, 7)), (0, (1, 7)), (1, (1, 7)), (2, ()), (3, ()), (4, ()), (5, (1, 7)), (6, ()), (7, ()), (8, (2,)), (9, ()), (10, ())])


def test_token_counts_are_the_librarys(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["the  cat sat\n on ", " x", "", None, "  ", " ", "日本 語  é", "<s> hi </s><unk>", "a\tb\r\nc", "ﬁ Ⅷ\u00a0\u3000x", "word " * 30000, "▁ ▁▁x", "a ▁b"]
    rows = [(k, t, 7) for k, t in enumerate(texts)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), path, limit=3)
    for r in got.collect():
        want = len(sp.encode(texts[r.doc_id] or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), want, want > 3)
    counter = token_counts.PrefixCounter(open(path, "rb").read())
    for t in texts[:10]:
        counts = counter.prefixes(t)
        assert counts.tolist() == [len(sp.encode((t or "")[:k])) for k in range(len(t or "") + 1)]
        assert len(sp.encode((t or "")[: token_counts.longest_within(counts, 3)])) <= 3
    stored = token_counts.prefix_token_counts(spark.createDataFrame(rows[:9], "doc_id long, text string, x int"), path).collect()
    assert all(r.prefix_tokens == counter.prefixes(texts[r.doc_id]).tolist() for r in stored)


def test_prefix_counts_of_fuzzed_and_long_texts(spark):
    import time

    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(9)
    counter = token_counts.PrefixCounter(open(path, "rb").read())
    alphabet = ["a", "b", "th", "e", "er", " ", "  ", "▁", "é", "日", "\n", "\t", "ﬁ", "1", "ing", "Z", "🙂", "\u0301", "the", "!!", "=="]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert counter.prefixes(text).tolist() == [len(sp.encode(text[:k])) for k in range(len(text) + 1)]
    for text in ("".join(rng.choice("abcdefgh") for _ in range(100_000)), "a" * 100_000):
        begun = time.perf_counter()
        assert counter.prefixes(text)[-1] == len(sp.encode(text)) and time.perf_counter() - begun < 10
    rows = [(1, "one two", "x"), (1, "one two", "x"), (2, None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, prefix_tokens string")
    assert [r.n_tokens for r in token_counts.count_tokens(frame, path).collect()] == [2, 2, 0]
    assert token_counts.count_tokens(frame.limit(0), path).count() == token_counts.prefix_token_counts(frame.limit(0), path).count() == 0
    assert token_counts.prefix_token_counts(frame, path).columns == ["doc_id", "text", "prefix_tokens"]
