"""python -m siftwell COMMAND INPUT OUTPUT: reports of a JSONL file, prepared examples, or data for further analysis.

trajectories, offline, sensitivity: a Markdown report. prepare: examples of a Parquet file. splits: train, test and dev
examples of a folder with train.parquet and test.parquet. credit: a line of turn credit for each trajectory, and a summary. targeted:
bridge and alias evaluation sets of example files (INPUT may be a glob). checkpoints: metrics of the result files in a folder.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import credit, prep, rewards, targeted
from .plans import reports
from .sources import jsonl


def _nested(counts) -> dict:
    out = {}
    for r in counts.collect():
        out.setdefault(r["split"], {})[r["data_source"]] = r["n"]
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siftwell")
    p.add_argument("command", choices=["trajectories", "offline", "sensitivity", "prepare", "splits", "credit", "targeted", "checkpoints"])
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--config", action="append", default=[], help="name:key=value,... beside the default configurations")
    p.add_argument("--max-cases", type=int, default=3)
    p.add_argument("--dev-per-source", type=int, default=10)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--bridge-size", type=int, default=150)
    p.add_argument("--alias-size", type=int, default=80)
    p.add_argument("--bridge-per-source-limit", type=int, default=0)
    p.add_argument("--checkpoint", action="append", default=[], help="Label=file, instead of the files looked for by default")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("siftwell").getOrCreate()
    if a.command == "prepare":
        n = jsonl.write_records(prep.prepare(spark.read.parquet(a.input)), a.output)
        print(f"{n} examples")
        return 0
    if a.command == "splits":
        counts = targeted.prepare_splits(spark.read.parquet(f"{a.input}/train.parquet"), spark.read.parquet(f"{a.input}/test.parquet"), a.output, a.dev_per_source, a.seed)
        jsonl.write_summary(spark, _nested(counts), f"{a.output}/summary.json")
        return 0
    if a.command == "targeted":
        rows = prep.first_of_files(jsonl.with_origin(jsonl.read_examples(spark, a.input)))
        targeted.write_targeted(*targeted.targeted_sets(rows, a.bridge_size, a.alias_size, a.bridge_per_source_limit), a.output)
        return 0
    if a.command == "checkpoints":
        specs = [jsonl.parse_spec(x) for x in a.checkpoint] or jsonl.existing_specs(spark, a.input)
        series = jsonl.metric_series(spark, [(label, f"{a.input}/{name}") for label, name in specs]).orderBy("ord").collect()
        jsonl.write_summary(spark, {"checkpoints": [{"label": r["label"], "em/macro": r["em_macro"], "format/rate": r["format_rate"]} for r in series], "best": max(series, key=lambda r: (r["em_macro"], -r["ord"]))["label"]}, a.output)
        return 0
    if a.command == "credit":
        found = credit.analyze(jsonl.read_records(spark, a.input), "line")
        found.write.json(f"{a.output}/records")
        known = spark.read.schema(found.schema).json(f"{a.output}/records")
        jsonl.write_summary(spark, {"totals": credit.summarize_analysis(known).first().asDict(), "buckets": {r["bucket"]: r["n"] for r in credit.outcome_buckets(known).collect()}}, f"{a.output}/summary.json")
        return 0
    records = jsonl.read_records(spark, a.input).withColumn("ord", F.col("line"))
    text = {"trajectories": lambda: reports.trajectory_report(records, most=a.max_cases), "offline": lambda: reports.offline_report(records, a.max_cases), "sensitivity": lambda: reports.sensitivity_report(records, rewards.load_configs(a.config), a.max_cases)}[a.command]()
    with open(a.output, "w", encoding="utf-8") as f:
        f.write(text + "\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
