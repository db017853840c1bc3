"""Behaviour and error diagnostics of trajectories."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as X
from ..functions import turns as E

# Cues and labels.
RELATION_CUES = ["maternal grandfather", "paternal grandfather", "grandfather", "grandmother", "director of", "written by", "written in part by", "writer", "recorded by", "person who", "film has the director", "whose director", "first gained", "delivered", "winner of", "younger", "older", "husband of", "wife of"]
LABELS = ["correct", "wrong", "invalid_format", "tool_failure", "repeated_search", "direct_correct", "searched_correct", "searched_wrong", "direct_wrong", "searched_invalid_format", "empty_search", "max_search_no_answer", "too_many_search_no_gain"]
BEHAVIOR = ["direct_correct", "searched_correct", "searched_wrong", "direct_wrong", "searched_invalid_format", "max_search_no_answer", "too_many_search_no_gain", "helpful_followup_query", "bad_max_search_loop"]
COUNTS = ["empty_observation_count", "duplicate_query_count", "tool_observation_count", "pending_tool_call_count"]
OFFLINE = ["possible_alias_match", "answer_granularity_miss", "missing_followup_query", "helpful_followup_query", "bad_max_search_loop", "multi_candidate_answer"]


def helpful_followup(question: Column, queries: Column) -> Column:
    """some later query brings two new terms, and a cue or a term beyond the question."""
    terms = F.transform(queries, X.query_terms)
    asked = X.query_terms(F.coalesce(question, F.lit("")))
    later = F.filter(F.sequence(F.lit(2), F.greatest(F.size(terms), F.lit(2))), lambda i: i <= F.size(terms))

    def brings(i):
        own = F.get(terms, i - 1)
        new = F.array_except(own, F.flatten(F.slice(terms, F.lit(1), i - 1)))
        return (F.size(new) >= 2) & (F.arrays_overlap(own, X.strings(X.FOLLOWUP_CUES)) | (F.size(F.array_except(new, asked)) > 0))

    return F.coalesce(F.exists(later, brings), F.lit(False))


def behavior(df: DataFrame, too_many: int = 3, with_question: bool = True) -> DataFrame:
    """df with queries and the behaviour flags and counts."""
    searched, exact, valid = F.col("_calls") > 0, E.is_true(F.col("exact_match")), E.is_true(F.col("valid_format"))
    first = df.withColumns({"queries": E.tool_queries(F.col("turns")), "_calls": F.coalesce("search_calls", F.lit(0)), "tool_observation_count": E.count_where(F.col("turns"), lambda t: t["role"] == "tool"), "empty_observation_count": E.count_where(F.col("turns"), E.is_empty_observation)})
    second = first.withColumn("_norm", F.filter(F.transform("queries", X.normalize_query), lambda q: q != ""))
    third = second.withColumns({
        "duplicate_query_count": F.size("_norm") - F.size(F.array_distinct("_norm")),
        "pending_tool_call_count": F.greatest(F.lit(0), F.size("queries") - F.col("tool_observation_count")),
        "direct_correct": ~searched & exact, "searched_correct": searched & exact,
        "searched_wrong": searched & valid & ~exact, "direct_wrong": ~searched & valid & ~exact, "searched_invalid_format": searched & ~valid,
        "max_search_no_answer": E.is_true(F.col("stop_reason") == "max_search_calls") & ~valid,
        "too_many_search_no_gain": (F.col("_calls") >= too_many) & ~exact,
        "helpful_followup_query": helpful_followup(F.col("question") if with_question else F.lit(""), F.col("queries")),
    })
    loop = (F.col("max_search_no_answer") | F.col("too_many_search_no_gain")) & ((F.col("duplicate_query_count") > 0) | ~F.col("helpful_followup_query"))
    return third.withColumn("bad_max_search_loop", loop).drop("_norm", "_calls")


def summarize_behavior(df: DataFrame) -> DataFrame:
    """One row of counts and sums over diagnosed trajectories."""
    flags = [F.count_if(c).alias(c) for c in BEHAVIOR]
    return df.agg(F.count("*").alias("total"), *flags, *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS), F.count_if(F.col("empty_observation_count") > 0).alias("empty_search"), F.count_if(F.col("duplicate_query_count") > 0).alias("duplicate_query"))


def behavior_metrics(df: DataFrame) -> DataFrame:
    """One row of rates."""
    s, n = summarize_behavior(df), F.greatest(F.col("total"), F.lit(1))
    rate = lambda c: (F.col(c) / n).alias(f"behavior/{c}_rate")
    return s.select(rate("direct_correct"), rate("searched_correct"), rate("searched_wrong"), (F.col("empty_observation_count") / F.greatest("tool_observation_count", F.lit(1))).alias("behavior/empty_observation_rate"), *(rate(c) for c in ("duplicate_query", "max_search_no_answer", "too_many_search_no_gain", "helpful_followup_query", "bad_max_search_loop")))


def granularity_miss(answer: Column, answers: Column) -> Column:
    """the answer is a bare year that a longer reference contains."""
    own, years = X.normalize_answer(answer), X.year_set(answer)
    return E.is_true((own != "") & F.array_contains(years, own) & F.exists(answers, lambda r: F.arrays_overlap(years, X.year_set(r)) & (X.normalize_answer(r) != own)))


def multi_candidate(answer: Column, answers: Column) -> Column:
    """F06."""
    return E.is_true(answer.rlike(X.MULTI_CANDIDATE) & ~F.exists(answers, lambda r: X.normalize_answer(r) == X.normalize_answer(answer)))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two strings by their matching blocks."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def ratio_bound(a: Column, b: Column) -> Column:
    """The most that sequence_ratio can be: twice the characters that both hold, however placed, by all characters."""
    both = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(F.length(a) - F.length(F.replace(a, c, F.lit(""))), F.length(b) - F.length(F.replace(b, c, F.lit(""))))))
    total = F.length(a) + F.length(b)
    by_length = F.when(total > 0, 2 * F.least(F.length(a), F.length(b)) / total).otherwise(1.0)
    return F.when(by_length < 0.82, by_length).otherwise(F.when(total > 0, 2 * both / total).otherwise(1.0))


def alias_matches(df: DataFrame, key: str) -> DataFrame:
    """(key, possible_alias_match) over columns final_answer and answers.

    The ratio is taken only where tokens don't decide and the bound reaches its threshold; other pairs never leave the JVM.
    """
    lettered = lambda c: c.rlike(r"\p{L}")
    pairs = df.where("final_answer is not null").select(key, X.normalize_answer(F.col("final_answer")).alias("a"), F.explode("answers").alias("r")).withColumn("r", X.normalize_answer(F.col("r")))
    pairs = pairs.where((F.col("a") != "") & (F.col("r") != "") & (F.col("a") != F.col("r")) & lettered(F.col("a")) & lettered(F.col("r")))
    plain = pairs.withColumn("hit", X.token_subset(F.col("a"), F.col("r")))
    near = plain.where(~F.col("hit")).withColumn("near", ratio_bound(F.col("a"), F.col("r")) >= 0.82)
    hard = near.where("near").select(key, (sequence_ratio("a", "r") >= 0.82).alias("hit")).unionByName(near.where("not near").select(key, "hit"))
    return plain.where("hit").select(key, "hit").union(hard).groupBy(key).agg(F.max("hit").alias("possible_alias_match"))


def missing_followup(df_question: Column, queries: Column, turns: Column, answer: Column, calls: Column) -> Column:
    """one search for a question with a relation cue whose texts name three entities."""
    seen = E.observation_text(turns)
    cue = F.lower(F.coalesce(df_question, F.lit(""))).rlike("|".join(RELATION_CUES))
    everything = F.concat_ws(" ", F.coalesce(df_question, F.lit("")), F.array_join(queries, " "), seen, answer)
    return E.is_true((calls == 1) & cue & (seen != "") & (X.named_entity_count(everything) >= 3))


def offline(df: DataFrame, key: str = "id") -> DataFrame:
    """behaviour plus the labels of wrong but valid answers, with reasons in a fixed order."""
    d = behavior(df).withColumn("final_answer", X.extract_answer(E.final_text(F.col("turns"))))
    d = d.join(alias_matches(d, key), key, "left")
    gate = E.is_true(F.col("valid_format")) & ~E.is_true(F.col("exact_match")) & F.col("final_answer").isNotNull()
    d = d.withColumns({
        "possible_alias_match": gate & E.is_true(F.col("possible_alias_match")),
        "answer_granularity_miss": gate & granularity_miss(F.col("final_answer"), F.col("answers")),
        "missing_followup_query": gate & missing_followup(F.col("question"), F.col("queries"), F.col("turns"), F.col("final_answer"), F.col("search_calls")),
        "multi_candidate_answer": gate & multi_candidate(F.col("final_answer"), F.col("answers")),
    })
    named = [("possible_alias_match", "final_answer_overlaps_gold_alias_or_spelling_variant"), ("answer_granularity_miss", "final_answer_is_less_specific_than_gold"), ("missing_followup_query", "single_search_multihop_or_role_binding_risk"), ("multi_candidate_answer", "final_answer_contains_multiple_candidates"), ("helpful_followup_query", "query_sequence_has_helpful_followup"), ("bad_max_search_loop", "bad_max_search_loop")]
    return d.withColumn("reasons", F.array_compact(F.array(*(F.when(F.col(c), F.lit(r)) for c, r in named))))


def summarize_offline(df: DataFrame) -> DataFrame:
    """Counts, and rates over all and over wrong but valid trajectories."""
    s = df.agg(F.count("*").alias("total"), F.count_if(E.is_true(F.col("valid_format")) & ~E.is_true(F.col("exact_match"))).alias("wrong_valid"), *(F.count_if(c).alias(c) for c in OFFLINE))
    part = [c for c in OFFLINE if c not in ("helpful_followup_query", "bad_max_search_loop")]
    return s.select("*", *((F.col(c) / F.greatest("total", F.lit(1))).alias(f"{c}_rate") for c in OFFLINE), *((F.col(c) / F.greatest("wrong_valid", F.lit(1))).alias(f"{c}_wrong_valid_rate") for c in part))


def labels(df: DataFrame) -> DataFrame:
    """df with labels, an array in the order of LABELS; df must be diagnosed."""
    failed = (F.coalesce("tool_failures", F.lit(0)) > 0) | F.exists("turns", lambda t: E.is_true((t["role"] == "tool") & ~t["ok"]))
    exact = E.is_true(F.col("exact_match"))
    rules = {"correct": exact, "invalid_format": ~exact & E.is_true(~F.col("valid_format")), "wrong": ~exact & ~E.is_true(~F.col("valid_format")) & E.is_true(~F.col("exact_match")), "tool_failure": failed, "repeated_search": F.col("duplicate_query_count") > 0, "empty_search": F.col("empty_observation_count") > 0}
    return df.withColumn("labels", F.array_compact(F.array(*(F.when(rules.get(c, F.col(c) if c not in rules else None), F.lit(c)) for c in LABELS))))


def label_counts(df: DataFrame) -> DataFrame:
    """(ord, label, n) for every label, zeros included."""
    fixed = df.sparkSession.createDataFrame(list(enumerate(LABELS)), "ord int, label string")
    return fixed.join(df.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")), "label", "left").select("ord", "label", F.coalesce("n", F.lit(0)).alias("n"))


def summarize_trajectories(df: DataFrame) -> DataFrame:
    """Header counts and means of labelled trajectories."""
    has = lambda c: F.count_if(F.array_contains("labels", c)).alias(c)
    return df.agg(F.count("*").alias("total"), *map(has, LABELS[:5]), F.avg("reward").alias("average_reward"), (F.coalesce(F.sum("search_calls"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("average_search_calls"))
