"""Prompts as token arrays, with any tokenizer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import suffix_prefix_overlap


def encoder(encode: Callable[[str], list[int]]):
    """A vectorised function of text columns that gives token arrays; encode is shipped to the workers."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else encode(t))

    return tokens


def code_points(text: str) -> list[int]:
    """The default tokenizer: a token per character."""
    return [ord(c) for c in text]


def render(messages: Column, generation: bool) -> Column:
    """Messages in a plain chat template; with generation, open for the assistant's words."""
    one = F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("<|end|>\n")))
    return F.concat(F.array_join(one, ""), F.lit("<|assistant|>\n" if generation else ""))


def next_prompt(prompt: Column, action: Column, ended: Column, canonical_next: Column, previous: Column, completion: Column) -> Column:
    """Struct of tokens and status. The sampled tokens stay as they are; what the template adds around them is appended.

    All are token arrays: prompt, the rendered history; action, the assistant's text alone; ended, the history with the assistant's
    message; canonical_next, that with the observation, open for the next turn; previous and completion, what was sampled.
    """
    begun = F.concat(prompt, action)
    starts = lambda a, b: F.slice(a, F.lit(1), F.size(b)) == b
    rest = lambda a, n: F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))
    closing = rest(ended, F.size(begun))
    status = F.when(~starts(ended, begun), "no_boundary").when(~starts(canonical_next, ended), "history_rewritten")
    done = F.concat(previous, completion, rest(closing, suffix_prefix_overlap(completion, closing)), rest(canonical_next, F.size(ended)))
    return F.struct(F.when(status.isNull(), done).alias("tokens"), status.alias("status"))
