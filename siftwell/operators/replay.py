"""Replay of recorded assistant outputs: where a trajectory stops, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def replay(outputs: DataFrame, max_search_calls: int = 4, max_turns: int = 6, key: str = "id") -> DataFrame:
    """(key, stop_turn, stop_reason, search_calls, final_text) from outputs: key, turn (from 0), text.

    A turn goes on only by a search within both limits, so the first that doesn't is the last; without one the
    recording is incomplete and stop_reason is null. Only minima are aggregated: no turns are gathered.
    """
    p = outputs.withColumn("kind", X.parse_assistant(F.col("text"))["kind"])
    goes_on = (F.col("kind") == "tool") & (F.col("turn") < max_search_calls) & (F.col("turn") + 1 < max_turns)
    last = p.groupBy(key).agg(F.min_by(F.when(~goes_on, F.struct("turn", "kind", "text")), F.when(~goes_on, F.col("turn"))).alias("s"), F.count_if(goes_on).alias("n"))
    reason = F.when(F.col("s.kind") == "answer", "answer").when((F.col("s.kind") == "tool") & (F.col("s.turn") >= max_search_calls), "max_search_calls").when(F.col("s.kind") == "tool", "max_assistant_turns").when(F.col("s.kind") == "invalid", "invalid_format")
    return last.select(key, F.col("s.turn").alias("stop_turn"), reason.alias("stop_reason"), F.coalesce("s.turn", F.col("n")).cast("int").alias("search_calls"), F.coalesce("s.text", F.lit("")).alias("final_text"))


def replay_budgets(outputs: DataFrame, max_search_calls: int | str = 4, max_turns: int | str = 6, tool_tokens: int | str = 1024, trajectory_tokens: int | str = 8192, key: str = "id") -> DataFrame:
    """D30, X02 with token budgets: (key, stop_reason, stop_turn, search_calls, tokens, blocks, final_text).

    outputs: key, turn (from 0), text, tokens (of the text), sizes (tokens of the tool message that holds the first 1, 2, ... blocks of
    what its search returned, as `fit.prefix_sizes` gives), rebuilt (false where the next prompt could not be built on the
    last; null counts as true) and start_tokens (of the first prompt). A limit is a number or the name of a column.

    An ordered fold with a state of tokens, searches and turns. tokens is the length of the last prompt that was built, blocks counts what
    observations kept; without a turn that stops it a recording is incomplete and stop_reason is null. A key gathers max_turns turns at most.
    """
    limits = {"_searches": max_search_calls, "_turns": max_turns, "_tool": tool_tokens, "_all": trajectory_tokens}
    p = outputs.withColumns({c: F.col(x) if isinstance(x, str) else F.lit(x) for c, x in limits.items()}).where(F.col("turn") < F.col("_turns"))
    p = p.withColumn("kind", X.parse_assistant(F.col("text"))["kind"])
    turn = F.struct("turn", "kind", F.col("tokens").cast("long").alias("tokens"), F.col("sizes").cast("array<long>").alias("sizes"), F.coalesce("rebuilt", F.lit(True)).alias("rebuilt"), "text")
    g = p.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("_said"), F.max("start_tokens").cast("long").alias("_start"), *(F.max(c).cast("long").alias(c) for c in limits))
    state = lambda tokens, searches, turns, stop, at, blocks, text: F.struct(tokens.alias("tokens"), searches.alias("searches"), turns.alias("turns"), stop.alias("stop"), at.alias("at"), blocks.alias("blocks"), text.alias("text"))
    none = F.lit(None).cast("string")
    start = state(F.col("_start"), F.lit(0), F.lit(0), none, F.lit(None).cast("int"), F.lit(0), F.lit(""))

    def step(s, x):
        searches = (x["kind"] == "tool") & (s["searches"] < F.col("_searches")) & (s["turns"] + 1 < F.col("_turns"))
        bad = F.transform(x["sizes"], lambda n, i: F.when((n > F.col("_tool")) | (s["tokens"] + x["tokens"] + n > F.col("_all")), i))
        fit = F.coalesce(F.array_min(bad), F.size(x["sizes"]))
        final = F.when(x["kind"] == "answer", "answer").when(x["kind"] != "tool", "invalid_format").when(s["searches"] >= F.col("_searches"), "max_search_calls").otherwise("max_assistant_turns")
        stop = F.when(~searches, final).when(~x["rebuilt"], "prompt_reconstruction_failed").when(fit == 0, "tool_observation_budget")
        more = F.when(searches, s["searches"] + 1).otherwise(s["searches"])
        stopped = state(s["tokens"], more, s["turns"] + 1, stop, x["turn"].cast("int"), s["blocks"], F.coalesce(x["text"], F.lit("")))
        went_on = state(s["tokens"] + x["tokens"] + F.get(x["sizes"], fit - 1), more, s["turns"] + 1, none, s["at"], s["blocks"] + fit, s["text"])
        full = state(s["tokens"], s["searches"], s["turns"], F.lit("max_trajectory_tokens"), x["turn"].cast("int"), s["blocks"], s["text"])
        return F.when(s["stop"].isNotNull(), s).when(s["tokens"] >= F.col("_all"), full).when(stop.isNotNull(), stopped).otherwise(went_on)

    done = g.withColumn("s", F.aggregate("_said", start, step))
    reason = F.when(F.col("s.stop").isNull() & (F.col("s.tokens") >= F.col("_all")), "max_trajectory_tokens").otherwise(F.col("s.stop"))
    return done.select(key, reason.alias("stop_reason"), F.col("s.at").alias("stop_turn"), F.col("s.searches").alias("search_calls"), F.col("s.tokens").alias("tokens"), F.col("s.blocks").alias("blocks"), F.col("s.text").alias("final_text"))
