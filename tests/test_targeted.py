"""Targeted sets, splits and the commands that write data."""

import json

import pytest

from siftwell.__main__ import main
from siftwell.operators import targeted


def examples(n=40):
    return [{"id": f"q{k}", "question": f"Who is the father of the director of film {k}, and when?", "answers": [f"A{k}", f"B{k} (x)"], "data_source": ["nq", "hotpotqa", "musique"][k % 3]} for k in range(n)]


def lines(path):
    return [json.loads(x) for p in sorted(path.glob("part-*")) for x in p.read_text(encoding="utf-8").splitlines()]


@pytest.fixture
def keep_session(spark, monkeypatch):
    return spark


def test_sets_do_not_overlap(spark):
    df = spark.createDataFrame([(r["id"], r["question"], r["answers"], r["data_source"], "dev") for r in examples()], "id string, question string, answers array<string>, data_source string, origin string")
    bridge, alias = targeted.targeted_sets(df, 10, 12)
    b, a = ({r.id for r in x.collect()} for x in (bridge, alias))
    assert len(b) == 10 and len(a) == 12 and not a & b and all(r.data_source != "nq" for r in bridge.collect())
    with pytest.raises(ValueError, match="asked for 1000 candidates, found 26"):
        targeted.targeted_sets(df, 1000, 1)


def test_commands(keep_session, tmp_path):
    spark = keep_session
    (tmp_path / "dev.jsonl").write_text("\n".join(map(json.dumps, examples())))
    (tmp_path / "test.jsonl").write_text("\n".join(map(json.dumps, examples(50))))
    assert main(["targeted", f"{tmp_path}/*.jsonl", f"{tmp_path}/sets", "--bridge-size", "9", "--alias-size", "7"]) == 0
    summary = json.loads((tmp_path / "sets" / "summary.json").read_text())
    assert len(lines(tmp_path / "sets" / "bridge")) == 9 == summary["bridge"]["size"] and summary["alias"]["size"] == 7 and summary["bridge"]["origins"] == {"dev": 9}
    raw = spark.createDataFrame([(str(k), "Q?", [f"a{k}"] if k % 4 else [], "nq" if k % 2 else "musique") for k in range(40)], "id string, question string, golden_answers array<string>, data_source string").selectExpr("*", "named_struct('ground_truth', named_struct('target', cast(array() as array<string>))) as reward_model")
    for name in ("train", "test"):
        raw.write.parquet(f"{tmp_path}/raw/{name}.parquet")
    assert main(["splits", f"{tmp_path}/raw", f"{tmp_path}/splits", "--dev-per-source", "3"]) == 0
    assert json.loads((tmp_path / "splits" / "summary.json").read_text()) == {s: {"nq": n, "musique": m} for s, n, m in (("train", 20, 10), ("test", 20, 10), ("dev", 3, 3))}
    record = {"data_source": "nq", "exact_match": True, "valid_format": True}
    (tmp_path / "eval_results.jsonl").write_text(json.dumps(record))
    (tmp_path / "late.jsonl").write_text(json.dumps({**record, "exact_match": False}))
    assert main(["checkpoints", str(tmp_path), f"{tmp_path}/series.json", "--checkpoint", "L=late.jsonl", "--checkpoint", "B=eval_results.jsonl"]) == 0
    assert json.loads((tmp_path / "series.json").read_text()) == {"best": "B", "checkpoints": [{"label": "L", "em/macro": 0.0, "format/rate": 1.0}, {"label": "B", "em/macro": 1.0, "format/rate": 1.0}]}
    assert main(["credit", f"{tmp_path}/late.jsonl", f"{tmp_path}/credit"]) == 0
    assert json.loads((tmp_path / "credit" / "summary.json").read_text())["totals"]["wrong_valid"] == 1 and len(lines(tmp_path / "credit" / "records")) == 1
