"""Metric files in one scan, and log-probabilities attached by datum."""

import json

import pytest

from siftwell.operators import sequence
from siftwell.sources import jsonl


def put(folder, name, rows):
    (folder / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows), encoding="utf-8")


def record(source, exact, valid):
    return {"data_source": source, "exact_match": exact, "valid_format": valid}


def test_summaries_and_records(spark, tmp_path):
    put(tmp_path, "a b.jsonl", [record("nq", True, True), record("nq", False, True), record("hotpotqa", False, False)])
    put(tmp_path, "b.jsonl", [{"type": "summary", "metrics": {"em/macro": 0.5, "format/rate": 0.5}}, record("nq", True, True), "", {"type": "summary", "metrics": {"em/macro": 0.25, "format/rate": 0.75, "x": 1}}])
    (tmp_path / "many").mkdir()
    put(tmp_path / "many", "part-0", [record("nq", True, True)])
    put(tmp_path / "many", "part-1", [record(None, False, None)])
    got = jsonl.metric_series(spark, [("A", f"{tmp_path}/a b.jsonl"), ("B", f"{tmp_path}/b.jsonl"), ("C", f"{tmp_path}/many"), ("again", f"{tmp_path}/b.jsonl")]).orderBy("ord").collect()
    assert [(r.label, r.em_macro, round(r.format_rate, 6)) for r in got] == [("A", 0.25, 0.666667), ("B", 0.25, 0.75), ("C", 0.5, 0.5), ("again", 0.25, 0.75)]
    assert tuple(jsonl.read_metrics(spark, f"{tmp_path}/b.jsonl").first()) == (0.25, 0.75)


def test_faults(spark, tmp_path):
    put(tmp_path, "empty", [""])
    put(tmp_path, "half", [{"type": "summary", "metrics": {"em/macro": 1}}])
    put(tmp_path, "none", [{"type": "summary"}])
    for name, said in (("empty", "no records"), ("half", "no summary metric"), ("none", "no summary metric")):
        with pytest.raises(Exception, match=said):
            jsonl.read_metrics(spark, f"{tmp_path}/{name}").collect()
    with pytest.raises(FileNotFoundError):
        jsonl.read_metrics(spark, f"{tmp_path}/nowhere")


def test_many_files_need_no_more_jobs(spark, tmp_path):
    for k in range(120):
        put(tmp_path, f"{k}.jsonl", [record("nq", k % 2 == 0, True)] * 3)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("metrics"))
    spark.sparkContext.setJobGroup("metrics", "metrics")
    try:
        one = jsonl.metric_series(spark, [("0", f"{tmp_path}/0.jsonl")]).collect()
        few = jobs()
        got = jsonl.metric_series(spark, [(str(k), f"{tmp_path}/{k}.jsonl") for k in range(120)]).orderBy("ord").collect()
        assert len(one) == 1 and [r.em_macro for r in got] == [float(k % 2 == 0) for k in range(120)]
        assert jobs() - few < few + 10
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_default_specs(spark, tmp_path):
    assert jsonl.existing_specs(spark, str(tmp_path)) == jsonl.DEFAULT_SPECS
    put(tmp_path, "trajectories.jsonl", [])
    assert jsonl.existing_specs(spark, str(tmp_path)) == [("Current", "trajectories.jsonl")]
    put(tmp_path, "eval_results.jsonl", [])
    assert jsonl.existing_specs(spark, str(tmp_path)) == jsonl.DEFAULT_SPECS


def attached(spark, datums, model, strict=False):
    d = spark.createDataFrame(datums, "id int, target_tokens array<int>, advantages array<double>")
    return sequence.attach_logprobs(d, spark.createDataFrame(model, "id int, logprobs array<double>"), "reference", "advantages", strict=strict)


def test_attach_statuses(spark):
    two = lambda k, adv=(0.0, 1.0): (k, [5, 6], list(adv))
    datums = [two(1), two(2), two(3), two(4), two(5), two(6, (0.0,)), (7, [5, 6], None), (8, [5], [1.0])]
    model = [(1, [None, None, -0.5]), (3, [None, -1.0, -2.0]), (3, [None, -1.0, -2.0]), (4, [None, -1.0]), (5, [None, -1.0, None]), (6, [None, -1.0, -2.0]), (7, [None, -1.0, -2.0]), (8, None), (9, [None])]
    got = {r.id: (r.reference_status, r.reference) for r in attached(spark, datums, model).collect()}
    assert got == {1: ("ok", [0.0, -0.5]), 2: ("missing", None), 3: ("repeated", None), 4: ("length", None), 5: ("lacks_a_value", None), 6: ("required_length", None), 7: ("required_length", None), 8: ("length", None)}
    assert attached(spark, datums[:1], model, strict=True).first().reference == [0.0, -0.5]
    for k, said in ((2, "missing"), (3, "repeated"), (4, "length"), (5, "lacks_a_value")):
        with pytest.raises(Exception, match=f"datum {k}: {said}"):
            attached(spark, [two(k)], model, strict=True).collect()


def test_bucketed_tables_join_without_a_shuffle(spark):
    d = spark.range(200).selectExpr("cast(id as int) id", "array(1, 2) target_tokens", "array(1D, 0D) advantages")
    m = spark.range(200).selectExpr("cast(id as int) id", "array(null, -1D, null) logprobs")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sequence.attach_logprobs(sequence.write_bucketed(d, buckets=4), sequence.write_bucketed(m, buckets=4), "reference", "advantages")
        assert got.where("reference = array(-1D, 0D)").count() == 200
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
