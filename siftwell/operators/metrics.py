"""Advantages, evaluation metrics and comparisons of trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import turns as E


def group_advantages(df: DataFrame, group: str = "question_index", standardize: bool = False, epsilon: float = 1e-6, clip: float = 0.0) -> DataFrame:
    """Df with advantage, the reward less its group's mean. Groups of equal rewards get exactly 0."""
    w = Window.partitionBy(group)
    mean = F.avg("reward").over(w)
    scale = F.greatest(F.stddev_pop("reward").over(w), F.lit(epsilon)) if standardize else F.lit(1.0)
    own = (F.col("reward") - mean) / scale
    if clip > 0:
        own = F.greatest(F.lit(-clip), F.least(F.lit(clip), own))
    return df.withColumn("advantage", F.when(F.max("reward").over(w) == F.min("reward").over(w), 0.0).otherwise(own))


def degenerate_groups(df: DataFrame, group: str = "question_index") -> DataFrame:
    """One row: groups, and those whose advantages are all 0."""
    return df.groupBy(group).agg(F.bool_and(F.col("advantage") == 0).alias("d")).agg(F.count("*").alias("n_groups"), F.count_if("d").alias("degenerate"))


def source_em(df: DataFrame) -> DataFrame:
    """Exact match by source."""
    return df.groupBy(F.coalesce("data_source", F.lit("unknown")).alias("data_source")).agg(F.avg(E.is_true(F.col("exact_match")).cast("double")).alias("em"), F.count("*").alias("n"))


def evaluation_metrics(df: DataFrame) -> DataFrame:
    """Macro exact match (sources weigh the same), micro exact match and rates, as one row."""
    flag = lambda c: F.coalesce(F.avg(E.is_true(F.col(c)).cast("double")), F.lit(0.0))
    macro = source_em(df).agg(F.coalesce(F.avg("em"), F.lit(0.0)).alias("em_macro"))
    rest = df.agg(flag("exact_match").alias("em_micro"), flag("valid_format").alias("format_rate"), F.coalesce(F.avg("search_calls"), F.lit(0.0)).alias("search_calls"), F.coalesce(F.avg((F.col("search_calls") == 0).cast("double")), F.lit(0.0)).alias("no_search_rate"), F.coalesce(F.avg(E.count_where(F.col("turns"), lambda t: t["role"] == "assistant")), F.lit(0.0)).alias("turns"))
    return macro.crossJoin(F.broadcast(rest))  # one row each


def rollout_metrics(df: DataFrame) -> DataFrame:
    """Rewards and rates of rollouts; a source's reward is over all sources whose name holds it."""
    of = lambda name: F.coalesce(F.avg(F.when(F.contains(F.lower("data_source"), F.lit(name)), F.col("reward"))), F.lit(0.0))
    attempts = F.sum(E.count_where(F.col("turns"), lambda t: (t["role"] == "assistant") & t["tool_call"].isNotNull()))
    return df.agg(F.avg("reward").alias("reward_mean"), of("nq").alias("reward_nq"), of("hotpotqa").alias("reward_hotpotqa"), (F.sum("search_calls") / F.greatest(attempts, F.lit(1))).alias("valid_tool_call_rate"), F.avg((F.col("search_calls") == 0).cast("double")).alias("no_search_rate"))


def packing_metrics(batches: DataFrame, step: str = "step") -> DataFrame:
    """Batches, tokens and padded tokens of each step, over the datums that have a batch."""
    one = batches.where("batch is not null").groupBy(step, "batch").agg(F.count("*").alias("items"), F.sum("num_tokens").alias("tokens"), (F.max("num_tokens") * F.count("*")).alias("padded"))
    return one.groupBy(step).agg(F.sum("items").alias("datums"), F.count("*").alias("micro_batches"), F.sum("tokens").alias("tokens"), F.sum("padded").alias("padded_tokens"), F.max("padded").alias("max_padded_tokens"))


def merge_trainer_metrics(df: DataFrame) -> DataFrame:
    """Metric values of micro-batches: sums of mean losses, means of the rest. df: key, value."""
    return df.groupBy("key").agg(F.when(F.col("key").isin("loss_mean", "loss/mean"), F.sum("value")).otherwise(F.avg("value")).alias("value"))


def gained_lost(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """One row: records that only the later run gets right, and only the earlier one."""
    both = before.select(key, E.is_true(F.col("exact_match")).alias("a")).join(after.select(key, E.is_true(F.col("exact_match")).alias("b")), key)
    return both.agg(F.count_if(F.col("b") & ~F.col("a")).alias("gained"), F.count_if(F.col("a") & ~F.col("b")).alias("lost"), F.count("*").alias("n"))


def patch(full: DataFrame, retry: DataFrame, key: str = "id") -> DataFrame:
    """Rows of retry in place of those of full, marked as patched."""
    return full.join(retry.select(key), key, "left_anti").withColumn("patched", F.lit(False)).unionByName(retry.withColumn("patched", F.lit(True)))


def group_comparison(df: DataFrame, group: str = "question", ord_col: str = "ord") -> DataFrame:
    """The records of questions with several records and an advantage, best first."""
    w = Window.partitionBy(group)
    kept = df.withColumns({"_n": F.count("*").over(w), "_some": F.max(F.col("advantage").isNotNull()).over(w)}).where("_n > 1 and _some")
    return kept.withColumn("rank", F.row_number().over(w.orderBy(F.coalesce("advantage", F.lit(0.0)).desc(), ord_col))).drop("_n", "_some")


def first_of_each(df: DataFrame, by: list[str], n: int, *order) -> DataFrame:
    """The first n rows of each group in the given order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
