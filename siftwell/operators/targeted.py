"""Data sets for a purpose: balanced splits of raw examples, and evaluation sets that target one weakness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import jsonl
from ..sources.shared import scratch
from . import prep

_EXAMPLE = ["id", "question", "answers", "data_source"]


def prepare_splits(train: DataFrame, test: DataFrame, path: str, dev_per_source: int = 10, seed: int = 42) -> DataFrame:
    """X11: write raw train and test rows as prepared examples, and a balanced dev set drawn from the test examples.

    JSON Lines go to path/train, path/test and path/dev. Returns (split, data_source, n), counted from what was written.
    """
    spark = train.sparkSession
    prep.prepare(train).select(_EXAMPLE).write.json(f"{path}/train")
    prep.prepare(test).select(_EXAMPLE).write.json(f"{path}/test")
    kind = "id string, question string, answers array<string>, data_source string"
    prep.balanced_sample(spark.read.schema(kind).json(f"{path}/test"), dev_per_source, seed).select(_EXAMPLE).write.json(f"{path}/dev")
    each = [spark.read.schema(kind).json(f"{path}/{s}").groupBy("data_source").agg(F.count("*").alias("n")).select(F.lit(s).alias("split"), "data_source", "n") for s in ("train", "test", "dev")]
    return each[0].unionByName(each[1]).unionByName(each[2])


def _settled(chosen: DataFrame, size: int, strict: bool) -> DataFrame:
    """The chosen rows, written once as later steps read them again; raises where there are too few and strict is set."""
    path = scratch(chosen.sparkSession, "chosen")
    chosen.write.parquet(path)
    rows = chosen.sparkSession.read.schema(chosen.schema).parquet(path)
    if strict and (found := rows.count()) < size:
        raise ValueError(f"asked for {size} candidates, found {found}")
    return rows


def targeted_sets(examples: DataFrame, bridge_size: int = 150, alias_size: int = 80, per_source: int = 0, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Questions that need a bridge, and, of the others, those whose answers have aliases or several grains.

    examples: id, question, answers, data_source, origin. Both sets come with score and tags; strict raises where either runs short.
    """

    def scored(rows, how):
        return rows.withColumn("_s", how).select(*_EXAMPLE, "origin", F.col("_s.score").alias("score"), F.col("_s.tags").alias("tags"))

    bridge = _settled(prep.select_candidates(scored(examples, prep.bridge_score(F.col("question"), F.col("data_source"))), bridge_size, per_source), bridge_size, strict)
    # a set has as many rows as asked for, so its keys are few
    key = prep.row_key(F.col("data_source"), F.col("id").cast("string"))
    taken = F.broadcast(bridge.select(key.alias("_key")))
    others = examples.withColumn("_key", key).join(taken, "_key", "left_anti").drop("_key")
    alias = _settled(prep.select_candidates(scored(others, prep.alias_score(F.col("question"), F.col("answers"))), alias_size), alias_size, strict)
    return bridge, alias


def write_targeted(bridge: DataFrame, alias: DataFrame, path: str) -> None:
    """The examples of both sets as JSON Lines, and a summary of their sources and origins."""
    summary = {}
    for name, rows in (("bridge", bridge), ("alias", alias)):
        rows.select(_EXAMPLE).write.json(f"{path}/{name}")
        counts = rows.groupBy("data_source", "origin").agg(F.count("*").alias("n")).collect()
        total = lambda c: {k: sum(r["n"] for r in counts if r[c] == k) for k in sorted({r[c] for r in counts})}  # noqa: E731, B023
        summary[name] = {"size": sum(r["n"] for r in counts), "sources": total("data_source"), "origins": total("origin")}
    jsonl.write_summary(bridge.sparkSession, summary, f"{path}/summary.json")
