"""Observations that fit: the longest run of first blocks under a tool message's and a trajectory's token budgets."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import protocol as P

Count = Callable[[list[str]], list[int]]


def bytes_in_fours(texts: list[str]) -> list[int]:
    """A tokenizer's usual estimate: a token for four bytes, and for what is left over."""
    return [-(-len(t.encode()) // 4) for t in texts]


def content_of(blocks: list[str], n: int) -> str:
    return "\n\n".join(blocks[:n])


def longest_prefixes(blocks: list[list[str]], room: list[tuple[int, int]], count: Count) -> list[tuple[int, int]]:
    """(blocks that fit, tokens of their message) for each row; room: what a message may have, and what the trajectory has left.

    A message's count is taken of its whole joined text, as tokens may cross blocks; it may not fall as blocks are added. All rows
    of a batch are asked together: first 1, 2, 4, ... blocks until one is too long, then halving between the last that fits and it.
    """
    low, high, tokens = [0] * len(blocks), [len(b) + 1 for b in blocks], [0] * len(blocks)
    step, live = [1] * len(blocks), [k for k, b in enumerate(blocks) if b]
    while live:
        probe = [min(low[k] + step[k], high[k] - 1) if step[k] else (low[k] + high[k]) // 2 for k in live]
        for k, n, used in zip(live, probe, count([f"{content_of(blocks[k], n)}\n\n{P.REMINDER}" for k, n in zip(live, probe)])):
            if used <= min(room[k]):
                low[k], tokens[k], step[k] = n, used, step[k] * 2
            else:
                high[k], step[k] = n, 0
        live = [k for k in live if high[k] - low[k] > 1]
    return list(zip(low, tokens))


def fit_observations(df: DataFrame, tool_tokens: int, trajectory_tokens: int, count: Count = bytes_in_fours, blocks: str = "blocks", used: str = "used_tokens") -> DataFrame:
    """Df with n_fit, content (null where no block fits), message_tokens and next_tokens.

    used holds the tokens that the trajectory has so far, the assistant's turn included; null counts as none.
    """

    @F.pandas_udf("n_fit int, content string, message_tokens long")
    def fit(rows: pd.Series, before: pd.Series) -> pd.DataFrame:
        own = [[] if b is None else ["" if x is None else x for x in b] for b in rows]
        found = longest_prefixes(own, [(tool_tokens, trajectory_tokens - int(n)) for n in before.fillna(0)], count)
        return pd.DataFrame({"n_fit": [n for n, _ in found], "content": [content_of(b, n) if n else None for b, (n, _) in zip(own, found)], "message_tokens": [t if n else None for n, t in found]}).astype({"message_tokens": "Int64"})

    return df.withColumn("_fit", fit(blocks, F.col(used).cast("long"))).select(*df.columns, "_fit.*", (F.coalesce(F.col(used), F.lit(0)) + F.col("_fit.message_tokens")).alias("next_tokens"))


def prefix_sizes(blocks: Column, count: Callable[[Column], Column]) -> Column:
    """Tokens of the messages of the first 1, 2, ... blocks; count is a column function and need not be additive."""
    one = lambda n: count(P.tool_content(F.array_join(F.slice(blocks, F.lit(1), n), "\n\n"))).cast("long")
    return F.when(F.coalesce(F.size(blocks), F.lit(0)) > 0, F.transform(F.sequence(F.lit(1), F.size(blocks)), one)).otherwise(F.array().cast("array<long>"))
