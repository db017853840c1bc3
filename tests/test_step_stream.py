"""A run's step files in several triggers: late, repeated and newer records end as one batch would."""

import json
import random

from siftwell.streaming import steps


def plain(records):
    last, out = {}, {}
    for r in sorted(records, key=lambda r: r["version"]):
        last[r["step"], r["question_index"], r["id"]] = r
    groups = {}
    for (s, q, i), r in last.items():
        groups.setdefault((s, q), {})[i] = r["reward"]
    for (s, q), own in groups.items():
        mean = sum(own.values()) / len(own)
        for i, x in own.items():
            out[s, q, i] = 0.0 if min(own.values()) == max(own.values()) else round(x - mean, 9)
    return out


def test_triggers_equal_one_batch(spark, tmp_path):
    rng, seen = random.Random(2), []
    src, out, check = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/check"
    src.mkdir()
    every = [{"step": s, "question_index": q, "id": i, "version": 1, "reward": rng.choice([0.0, 1.0, -0.1]), "exact_match": rng.random() < 0.4} for s in range(3) for q in range(4) for i in range(5)]
    rng.shuffle(every)
    newer = [{**r, "version": 2, "reward": r["reward"] + 1} for r in every[:7]]
    for k, part in enumerate((every[:20], every[15:45] + every[:3], every[45:] + newer, every[:30])):
        (src / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        steps.follow_steps(spark, str(src), out, check).awaitTermination()
        seen += part
        got = {(r.step, r.question_index, r.id): round(r.advantage, 9) for r in steps.stated(spark, out).collect()}
        assert got == plain(seen), k
    # a run without new files changes nothing
    before = sorted(p.name for p in (tmp_path / "out").iterdir())
    steps.follow_steps(spark, str(src), out, check).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == before
    em = {}
    for r in {(r["step"], r["question_index"], r["id"]): r for r in sorted(seen, key=lambda r: r["version"])}.values():
        em.setdefault(r["step"], []).append(r["exact_match"])
    best = {r.step: (round(r.em, 9), r.best) for r in steps.best_step(steps.stated(spark, out)).collect()}
    assert {s: m for s, (m, _) in best.items()} == {s: round(sum(x) / len(x), 9) for s, x in em.items()}
    assert [s for s, (_, b) in best.items() if b] == [min(s for s in em if sum(em[s]) / len(em[s]) == max(sum(x) / len(x) for x in em.values()))]


def test_a_repeated_trigger_overwrites_its_folder(spark, tmp_path):
    groups = spark.createDataFrame([(1, 1, [(1, 1, 1.0, True), (2, 1, 0.0, None), (2, 3, 0.5, False)])], "step long, question_index long, records array<struct<id:long,version:long,reward:double,exact_match:boolean>>")
    for _ in range(2):
        steps.advantages(groups).write.mode("overwrite").parquet(f"{tmp_path}/out/batch=4")
    assert {(r.id, r.reward, r.advantage) for r in steps.stated(spark, f"{tmp_path}/out").collect()} == {(1, 1.0, 0.25), (2, 0.5, -0.25)}
