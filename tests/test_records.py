"""Whole records: no key is lost, defaults are filled in, updates and marks reach the file."""

import json

import pytest

from siftwell.sources import records


def back(spark, path):
    return [json.loads(r.value) for r in spark.read.text(str(path)).orderBy("value").collect()]


def put(tmp_path, lines):
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_unknown_keys_survive(spark, tmp_path):
    whole = {"id": "a", "question": "Q é 日本", "turns": [{"role": "assistant", "logprobs": [-0.5, None], "deep": {"z": [1, {"y": 2}]}}, {"role": "tool", "items": []}], "metadata": {"stop_reason": "answer", "model": {"n": 7}}, "zz": None, "search_calls": "3", "answers": "one", "reward": 0.25, "big": 12345678901234567890123}
    path = put(tmp_path, [json.dumps(whole), "", '{"type":"summary","metrics":{}}', '{"id":"b","search_calls":null,"tool_failures":2.0,"answers":[]}'])
    rows = records.read(spark, path)
    assert [r.line for r in rows.orderBy("line").collect()] == [1, 4]
    records.write(rows, f"{tmp_path}/out")
    first, second = back(spark, tmp_path / "out")
    assert first == {**records.DEFAULTS, **whole, "search_calls": 3, "answers": ["one"]}
    assert second == {**records.DEFAULTS, "id": "b", "tool_failures": 2}
    text = [r.value for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert all(list(json.loads(t)) == sorted(json.loads(t)) for t in text) and any("日本" in t for t in text)
    typed = {r.id: r for r in records.typed(rows).collect()}
    assert typed["a"].stop_reason == "answer" and typed["a"].search_calls == 3 and len(typed["a"].turns) == 2 and typed["b"].answers == []


def test_updates_and_marks(spark, tmp_path):
    path = put(tmp_path, [json.dumps({"id": "a", "own": [1], "turns": [{"role": "x", "own": 1}, {"role": "y"}], "reward": 1})])
    rows = records.typed(records.read(spark, path)).selectExpr("*", "array('n', 'm') as answers2").drop("answers").withColumnRenamed("answers2", "answers")
    changed = records.update(rows.selectExpr("* except (reward)", "cast(null as double) as reward"), ["reward", "answers"])
    marked = records.mark_turns(changed, "credit", records.F.array(records.F.lit(None).cast("variant"), records.F.lit(0.5).cast("variant")))
    records.write(marked, f"{tmp_path}/out")
    (got,) = back(spark, tmp_path / "out")
    assert got["own"] == [1] and got["reward"] is None and got["answers"] == ["n", "m"] and got["turns"] == [{"role": "x", "own": 1}, {"role": "y", "credit": 0.5}]


@pytest.mark.parametrize("line", ["{", "[1]", '{"turns": {}}', '{"metadata": [1]}', "7"])
def test_broken_lines(spark, tmp_path, line):
    path = put(tmp_path, [line, '{"id":"ok"}'])
    with pytest.raises(Exception, match="invalid record"):
        records.read(spark, path).collect()
    assert [r.line for r in records.read(spark, path, strict=False).collect()] == [2]
