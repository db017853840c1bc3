"""op6 reads its totals off stored counts of prefixes."""

import random
import time

import pyarrow as pa

from siftwell.llm import token_counts


def test_counts_at_chunk_ends_are_those_of_the_prefixes():
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        counter = token_counts.PrefixCounter(f.read())
    texts = ["the  cat sat\n on ", " x", "", None, "  ", " ", "日本 語  é", "one two three", "▁ ▁▁x", "a ▁b"]
    offsets, counts = counter.chunk_ends(pa.array(texts))
    assert len(offsets) == len(texts) + 1 and offsets[-1] == len(counts)
    for k, t in enumerate(texts):
        every, t = counter.prefixes(t), (t or "").replace("▁", " ")
        ends = [m.end() - 1 for m in token_counts._CHUNK.finditer(" " + t)]
        assert counts[offsets[k] : offsets[k + 1]].tolist() == every[ends].tolist()


def test_a_prefix_that_many_words_begin_with_is_run_once():
    import public_tokenizers
    import sentencepiece

    path, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(3)
    with open(path, "rb") as f:
        counter = token_counts.PrefixCounter(f.read())
    begin = "".join(rng.choice("etaoinshr") for _ in range(500))
    words = [begin + "".join(rng.choice("etaoinshr") for _ in range(6)) for _ in range(1000)]
    library, begun = sentencepiece.SentencePieceProcessor(model_file=path), time.process_time()
    want = [len(x) for x in library.encode(words, num_threads=1)]
    limit = 10 * (time.process_time() - begun)  # the pass over every word anew took 30 times as long as the library
    begun = time.process_time()
    counts = counter.chunk_ends(pa.array([" ".join(words)]))[1]
    assert time.process_time() - begun < limit
    assert [int(b - a) for a, b in zip([0, *counts], counts)] == want
    # runs in any order, one the beginning of another, and again after all are stored
    for texts in (["the", "there", "then th", "t"], ["there", "the", "", "thé", "the\nthe"], ["the", "there"]):
        ends, counts = counter.chunk_ends(pa.array(texts))
        assert counts[ends[1:] - 1].tolist() == [len(x) for x in library.encode(texts)]
        assert all(counter.prefixes(t).tolist() == [len(library.encode(t[:k])) for k in range(len(t) + 1)] for t in texts)
