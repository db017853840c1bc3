"""JSON Lines: examples, trajectories, corpora and metric files, with defaults filled in."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.turns import TURNS
from .shared import write_text

EXAMPLE = "id string, question string, answers string, data_source string"
RECORD = f"type string, id string, question string, answers array<string>, data_source string, turns {TURNS}, reward double, advantage double, valid_format boolean, exact_match boolean, search_calls string, tool_failures string, metadata struct<id:string,run_type:string,stop_reason:string,question_index:int,group_index:int>, metrics map<string,double>, _corrupt_record string"
CORPUS = "id string, title string, content string, url string, source string"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value): non-blank lines with their number in the file, from 1; blank ones count.

    Files are read in parallel blocks: a line's number is its place in its block, after the lines of the
    file's earlier blocks, of which there is one count each.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("m"))
    blocks = raw.groupBy("file", "block").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = raw.join(blocks.select("file", "block", "first", before.alias("before")), ["file", "block"])
    return placed.where(F.trim("value") != "").select("file", (F.col("before") + F.col("m") - F.col("first") + 1).cast("int").alias("line"), "value")


def to_array(c: Column) -> Column:
    """A JSON value as an array of strings: a scalar is its only element."""
    return F.when(c.startswith("["), F.from_json(c, "array<string>")).when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))


def check(df: DataFrame, bad: Column, what: str) -> DataFrame:
    """Raise, with file and line, on the rows where bad holds."""
    said = F.raise_error(F.concat(F.lit(f"{what} in "), F.col("file"), F.lit(":"), F.col("line").cast("string"))).cast("int")
    return df.where(F.when(bad, said).otherwise(1) == 1)


def read_examples(spark: SparkSession, path: str, limit: int = 0, default_source: str = "unknown") -> DataFrame:
    """Id (example-<line> by default), question, answers and data_source, in file order as ord."""
    rows = check(lines(spark, path).withColumn("r", F.from_json("value", EXAMPLE + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})), F.col("r._corrupt_record").isNotNull(), "invalid JSON")
    found = rows.select("file", "line", F.coalesce(F.nullif("r.id", F.lit("")), F.concat(F.lit("example-"), F.col("line").cast("string"))).alias("id"), F.col("r.question").alias("question"), to_array(F.col("r.answers")).alias("answers"), F.coalesce(F.nullif("r.data_source", F.lit("")), F.lit(default_source)).alias("data_source"))
    return found.orderBy("file", "line").limit(limit) if limit else found


def normalize_records(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Defaults for all fields of a trajectory, and the columns to keep beside them."""
    count = lambda c: F.coalesce(F.expr(f"try_cast({c} as int)"), F.lit(0)).alias(c)
    return df.select("file", "line", F.coalesce("id", F.col("metadata.id"), F.lit("")).alias("id"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answers", F.array().cast("array<string>")).alias("answers"), F.coalesce("data_source", F.lit("")).alias("data_source"), F.coalesce("turns", F.array().cast(TURNS)).alias("turns"), "reward", "advantage", "valid_format", "exact_match", count("search_calls"), count("tool_failures"), F.coalesce("metadata.stop_reason", F.lit("")).alias("stop_reason"), "metadata", *keep)


def read_records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Trajectories without the summary rows; a line that is no JSON object raises if strict, else is left out."""
    rows = lines(spark, path).withColumn("r", F.from_json("value", RECORD, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r._corrupt_record").isNotNull()
    rows = check(rows, bad, "invalid record") if strict else rows.where(~bad)
    return normalize_records(rows.select("file", "line", "r.*").where("coalesce(type, '') <> 'summary'"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents with all five fields; other keys go to metadata."""
    rows = lines(spark, path).withColumns({"r": F.from_json("value", CORPUS), "m": F.from_json("value", "map<string,string>")})
    names = ["id", "title", "content", "url", "source"]
    rows = check(rows, F.exists(F.array(*(F.col(f"r.{c}").isNull() for c in names)), lambda x: x), "missing field")
    return rows.select("file", "line", "r.*", F.map_filter("m", lambda k, _: ~k.isin(names)).alias("metadata"))


def metric_series(spark: SparkSession, labelled: list[tuple[str, str]]) -> DataFrame:
    """(ord, label, em_macro, format_rate) of labelled files or folders, in one scan of them all.

    A file's metrics are those of its last summary row; without one, those of its records. Files and labels are few beside
    their rows, and are broadcast. A path without any row, or a summary without one of the two, raises.
    """
    names = spark.createDataFrame([(k, label, _bare(_qualified(spark, path))) for k, (label, path) in enumerate(labelled)], "ord int, label string, at string")
    rows = check(lines(spark, [path for _, path in labelled]).withColumn("r", F.from_json("value", RECORD, {"columnNameOfCorruptRecord": "_corrupt_record"})), F.col("r._corrupt_record").isNotNull(), "invalid record")
    rows = rows.select(F.regexp_replace("file", "^([^:/]+):/+", "$1:/").alias("file"), "line", "r.*")
    files = rows.select("file").distinct().join(F.broadcast(names), (F.col("file") == F.col("at")) | F.col("file").startswith(F.concat("at", F.lit("/")))).select("file", "ord")
    rows = rows.join(F.broadcast(files), "file")
    is_summary = F.coalesce(F.col("type"), F.lit("")) == "summary"
    summed = rows.where(is_summary).groupBy("ord").agg(F.max_by(F.coalesce("metrics", F.create_map().cast("map<string,double>")), F.struct("file", "line")).alias("m"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    by_source = rows.where(~is_summary).groupBy("ord", F.coalesce("data_source", F.lit("unknown")).alias("source")).agg(F.avg(flag("exact_match")).alias("em"), F.sum(flag("valid_format")).alias("valid"), F.count("*").alias("n"))
    counted = by_source.groupBy("ord").agg(F.avg("em").alias("em"), (F.sum("valid") / F.sum("n")).alias("valid"))
    found = names.join(F.broadcast(summed), "ord", "left").join(F.broadcast(counted), "ord", "left")
    fault = lambda what: F.raise_error(F.concat(F.lit(f"{what} in "), F.col("at"))).cast("double")
    value = lambda key, own: F.when(F.col("m").isNotNull(), F.coalesce(F.try_element_at("m", F.lit(key)), fault("no summary metric"))).otherwise(F.coalesce(F.col(own), fault("no records")))
    return found.select("ord", "label", value("em/macro", "em").alias("em_macro"), value("format/rate", "valid").alias("format_rate"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row of em_macro and format_rate."""
    return metric_series(spark, [("", path)]).select("em_macro", "format_rate")


# The result files that are looked for by default.
DEFAULT_SPECS = [("Base", "eval_results.jsonl"), ("Step 20", "eval_results_rl_step_20.jsonl"), ("Step 50", "eval_results_rl_step_50.jsonl"), ("Step 100", "eval_results_rl_step_100.jsonl"), ("Step 150", "eval_results_rl_step_150.jsonl"), ("Step 200", "eval_results_rl_step_200.jsonl")]


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _qualified(spark: SparkSession, path: str) -> str:
    at, files = _path(spark, path)
    if not files.exists(at):
        raise FileNotFoundError(f"missing evaluation result: {path}")
    return files.makeQualified(at).toUri().toString()


def _bare(uri: str) -> str:
    """A file's address with one slash behind its scheme."""
    scheme, sign, rest = uri.partition(":/")
    return f"{scheme}:/{rest.lstrip('/')}".rstrip("/") if sign else uri


def existing_specs(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """The default (label, file) pairs, or the current trajectories where none of these is there but they are."""
    there = lambda name: _path(spark, f"{folder}/{name}")[1].exists(_path(spark, f"{folder}/{name}")[0])
    if not any(there(name) for _, name in DEFAULT_SPECS) and there("trajectories.jsonl"):
        return [("Current", "trajectories.jsonl")]
    return list(DEFAULT_SPECS)


def with_origin(df: DataFrame) -> DataFrame:
    """Origin, the file's name without its ending, and file_rank by name."""
    stem = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    ranks = df.select("file").distinct().withColumn("file_rank", F.row_number().over(Window.orderBy("file")))  # one row per file
    return df.withColumn("origin", stem).join(ranks, "file")


def parse_spec(spec: str) -> tuple[str, str]:
    """Label=path."""
    label, sign, path = (x.strip() for x in spec.partition("="))
    if not (label and sign and path):
        raise ValueError("a checkpoint reads Label=path")
    return label, path


def write_records(df: DataFrame, path: str) -> int:
    """One JSON object a line, keys sorted, nulls kept; returns the number of rows."""
    rows = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    from pyspark.sql import Observation

    seen = Observation()
    df.select(rows.alias("value")).observe(seen, F.count(F.lit(1)).alias("n")).write.text(path)
    return seen.get["n"]


def write_summary(spark: SparkSession, payload: dict, path: str) -> None:
    """A few aggregates as one indented JSON file, keys sorted."""
    write_text(spark, path, json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def write_steps(df: DataFrame, path: str) -> None:
    """JSON files in a folder for each step."""
    df.write.partitionBy("step").json(path)
