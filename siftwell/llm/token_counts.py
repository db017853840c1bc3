"""Exact token counts at every prefix, by dynamic programming over prefixes.

The tokenizer's pieces never cross from a non-space to a following space (this is
checked on the model), so a text's tokens are those of its chunks: a run of spaces
with the word behind it. Within a chunk, byte-pair merging has this property: a sequence of pieces is
the encoding of its text exactly if each piece and each two neighbours encode to themselves.
So the encoding of a prefix is that of a shorter prefix and one last piece:

    count(k) = count(k - |t|) + 1 for the one piece t that ends at k and fits the last piece of prefix k - |t|

which takes one forward pass over the chunk, whatever its length; whether two pieces fit is found by
merging the two alone, once for each pair. Which pieces end at k is read off the longest end of the prefix
that begins a piece, which the next character extends or cuts. A character that no piece covers counts its bytes. Over chunks

    count(prefix to the end of chunk k) = count(prefix to the end of chunk k - 1) + last count of chunk k

The same holds for the runs within a chunk between whose characters no piece reaches. A worker runs
the program once for each distinct run, in sorted order, so that a prefix shared with the run before is not
run again, and keeps the counts at all prefixes of runs and at the ends of chunks. The stored counts
answer how many tokens a prefix has and which prefix fits a budget
without encoding anything again. The library's own encoding of each distinct chunk is compared with
the last count, so a model without that property is noticed. Counting is one map, without a shuffle.

Defined results: null and empty texts have no bytes and no tokens; an empty table gives an empty result; repeated rows are
each counted; very long texts are counted whole; columns of docs named like outputs are replaced. Special strings
inside texts are ordinary text, as is the library's default.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CHUNK = re.compile(r" +[^ ]*")
#: What the model reads a space as; in a text it is the same as a space.
_MARK = "▁"


def _slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Where the table of neighbours within pieces holds two letters; others that meet there only make a run longer."""
    return (left * np.uint32(2654435761) + right) & np.uint32((1 << 22) - 1)


class PrefixCounter:
    """Token counts of prefixes under a SentencePiece model given as bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.model.id_to_piece(k) for k in range(self.model.get_piece_size()))
        if any(_MARK in p.lstrip(_MARK) for p in pieces) or [self.model.id_to_piece(k) for k in self.model.encode("a  ")] == [self.model.id_to_piece(k) for k in self.model.encode("a")]:
            raise ValueError("pieces of this model cross spaces; prefix counts would not be exact")
        normal = [k for k in range(self.model.get_piece_size()) if not (self.model.is_control(k) or self.model.is_unknown(k) or self.model.is_byte(k) or self.model.is_unused(k))]
        self.score = {self.model.id_to_piece(k): self.model.get_score(k) for k in normal}
        self.begins = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        self.steps, self.pieces, self.fitted, self.kept, self.runs, self.size = {}, {}, 0, {}, {}, 0
        joined = np.array([[ord(x), ord(y)] for x, y in {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}], dtype=np.uint32).reshape(-1, 2)
        self.joined = np.zeros(1 << 22, dtype=bool)
        self.joined[_slot(joined[:, 0], joined[:, 1])] = True

    def _merged(self, text: str) -> list[str]:
        """Byte-pair merging: the best pair first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            best, at = None, 0
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, before: str, piece: str) -> bool:
        """Whether the two neighbours encode to themselves; kept for each two."""
        self.fitted += 1
        known = self.pieces[piece][3][before] = self._merged(before + piece) == ([before, piece] if before else [piece])
        return known

    def _step(self, s: str) -> tuple[str, list]:
        """The longest end of s that begins a piece, and all that may end there, longest first: length, piece, tokens, what it fits behind."""
        end = s
        while len(end) > 1 and end not in self.begins:
            end = end[1:]
        last = [end[k:] for k in range(len(end)) if k == len(end) - 1 or end[k:] in self.score]
        known = self.steps[s] = end, [self.pieces.setdefault(t, (len(t), t, 1 if t in self.score else len(t.encode()), {})) for t in last]
        return known

    def _forward(self, runs: list[str]) -> None:
        """The program over new runs: tokens of their first 1, 2, ... characters. Runs go in order, so a prefix that many begin with is run once."""
        before, ends, last, count, steps = "", [""], [""], [0], self.steps
        for run in sorted(runs):
            k = 0
            for x, y in zip(before, run):
                if x != y:
                    break
                k += 1
            del ends[k + 1 :], last[k + 1 :], count[k + 1 :]
            end = ends[k]
            for c in run[k:]:
                k += 1
                end, found = steps.get(end + c) or self._step(end + c)
                for n, t, tokens, fits in found:
                    fit = fits.get(last[k - n])
                    if fit or fit is None and self._fit(last[k - n], t):
                        last.append(t)
                        count.append(count[k - n] + tokens)
                        break
                else:
                    raise ValueError("the model's merges are not those of byte pairs")
                ends.append(end)
            self.runs[run], before = count[1:], run
            self.size += len(run)

    def _runs(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The runs of all words' chunks, counted, and which of them begin a chunk. No piece holds the two neighbours where runs meet, so none reaches across."""
        s = (" " + " ".join(words)).replace(" ", _MARK)
        letters = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)
        begins = np.concatenate([[True], ~self.joined[_slot(letters[:-1], letters[1:])]])
        chunks = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])[:-1]
        begins[chunks] = True
        at = np.flatnonzero(begins)
        to = at.tolist() + [len(s)]
        runs = [s[i:j] for i, j in zip(to, to[1:])]
        self._forward([r for r in set(runs) if r not in self.runs])
        return runs, np.searchsorted(at, chunks)

    def totals(self, words: list[str]) -> np.ndarray:
        """Tokens of the chunks of a space and each word, kept for the worker's next batches."""
        if self.size > 1 << 24:
            self.kept, self.runs, self.size = {}, {}, 0
        if self.fitted > 1 << 20 or len(self.steps) > 1 << 20:
            self.steps, self.pieces, self.fitted = {}, {}, 0
        new = [w for w in dict.fromkeys(words) if w not in self.kept]
        if new:
            runs, first = self._runs(new)
            counts = np.add.reduceat(np.array([self.runs[r][-1] for r in runs], dtype=np.int64), first).tolist()
            for w, n, pieces in zip(new, counts, self.model.encode(new, num_threads=1)):
                if n != (len(pieces) or 1):  # the library has no token for a lone space that begins a text
                    raise ValueError(f"prefix counts differ from the library's: {w[:100]!r}")
                self.size += len(w) + 1
            self.kept.update(zip(new, counts))
        return np.array([self.kept[w] for w in words], dtype=np.int64)

    def chunk_ends(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, counts): counts[offsets[k]:offsets[k + 1]] are the tokens of text k up to the end of each of its chunks."""
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), _MARK, " ")
        odd = pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  "))
        odd = pc.or_(odd, pc.ends_with(texts, " ")).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        offsets = split.offsets.to_numpy()
        use = np.ones(len(coded), dtype=bool)
        for k in np.flatnonzero(odd):
            use[offsets[k] - offsets[0] : offsets[k + 1] - offsets[0]] = False
        wanted = np.unique(coded.indices.to_numpy()[use])
        count = np.zeros(len(coded.dictionary), dtype=np.int64)
        count[wanted] = self.totals(coded.dictionary.take(pa.array(wanted)).to_pylist())
        each = np.split(count[coded.indices.to_numpy()], offsets[1:-1] - offsets[0])
        for k in np.flatnonzero(odd):
            each[k] = self.totals([c[1:] for c in _CHUNK.findall(" " + texts[int(k)].as_py())])
        for k in np.flatnonzero(pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
            each[k] = np.zeros(1, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in each])])
        total = np.concatenate([[0], np.cumsum(np.concatenate(each))])
        return ends, total[1:] - np.repeat(total[ends[:-1]], np.diff(ends))

    def prefixes(self, text: str | None) -> np.ndarray:
        """Tokens of the first k characters, for every k from 0 to the text's length."""
        text = (text or "").replace(_MARK, " ")
        if not text:
            return np.zeros(1, dtype=np.int64)
        words = [c[1:] for c in _CHUNK.findall(" " + text)]
        self.totals(words)
        runs, base, parts = self._runs(words)[0], 0, []
        for run in runs:
            parts.append(base + np.array(self.runs[run], dtype=np.int64))
            base = parts[-1][-1]
        counts = np.concatenate(parts)
        counts[0] = 0  # the first space is the tokenizer's own
        return counts


def longest_within(counts: np.ndarray, budget: int) -> int:
    """The most characters whose prefix has at most budget tokens, from the stored counts."""
    return int(np.flatnonzero(counts <= budget)[-1])


def _counter(shared, limit: int):
    def count(batches):
        counter = PrefixCounter(shared.value)
        for batch in batches:
            step = 1024
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                offsets, counts = counter.chunk_ends(part.column(1))
                over = np.logical_or.reduceat(counts > limit, offsets[:-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts[offsets[1:] - 1]), pa.array(over)], names=["_row", "n_tokens", "over_limit"])

    return count


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """docs, less its text, with n_bytes, n_tokens and over_limit: the last of the counts at chunk ends, and whether one passes the limit."""
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    text = F.col(text_col).cast("string")
    kept = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens", "over_limit")]
    row = F.struct(*(F.col(f"`{c}`").alias(f"c_{c}") for c in kept), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    packed = docs.select(row.alias("_row"), text.alias("_text"))
    done = packed.mapInArrow(_counter(shared, limit), packed.select("_row").schema.add("n_tokens", "long").add("over_limit", "boolean"))
    return done.select(*(F.col("_row").getField(f"c_{c}").alias(c) for c in kept), F.col("_row.n_bytes").alias("n_bytes"), "n_tokens", "over_limit")


def _prefixer(shared):
    def prefix(batches):
        counter = PrefixCounter(shared.value)
        for batch in batches:
            for k, t in enumerate(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([counter.prefixes(t)], pa.list_(pa.int64()))], names=["_row", "prefix_tokens"])

    return prefix


def prefix_token_counts(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """docs with prefix_tokens: element k holds the tokens of the first k characters."""
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in docs.columns if c != "prefix_tokens"]
    packed = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c_{c}") for c in kept)).alias("_row"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    done = packed.mapInArrow(_prefixer(shared), packed.select("_row").schema.add("prefix_tokens", T.ArrayType(T.LongType())))
    return done.select(*(F.col("_row").getField(f"c_{c}").alias(c) for c in kept), "prefix_tokens")
