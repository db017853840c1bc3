"""Small cases with known results."""

import json

import pytest
from pyspark.sql import functions as F

from siftwell.functions import protocol, text, turns
from siftwell.operators import credit, diagnostics, metrics, prep, replay, retrieval, rewards, sequence
from siftwell.plans import reports
from siftwell.sources import jsonl

RECORD = f"id int, question string, answers array<string>, data_source string, turns {turns.TURNS}, reward double, advantage double, valid_format boolean, exact_match boolean, search_calls int, tool_failures int, stop_reason string"


def call(query):
    return {"role": "assistant", "text": "look", "parsed_kind": "tool", "tool_call": {"name": "search", "query": query}}


def seen(title="Title", content="Content", ok=True, items=True, **more):
    return {"role": "tool", "ok": ok, "items": [{"title": title, "content": content, "source": "src"}] if items else [], "observation": f"{title} {content}"} | more


def said(answer):
    return {"role": "assistant", "text": answer if "Answer" in answer else f"Reasoning.\n\nAnswer: {answer}", "parsed_kind": "answer"}


def record(k, events, **more):
    own = {"question": "Q", "answers": ["gold"], "data_source": "nq", "reward": 0.0, "advantage": None, "valid_format": True, "exact_match": False, "search_calls": sum("tool_call" in e for e in events), "tool_failures": 0, "stop_reason": "answer"} | more
    return own | {"id": k, "turns": events}


def frame(spark, records):
    lines = spark.createDataFrame([(json.dumps(r),) for r in records], "v string")
    return lines.select(F.from_json("v", RECORD).alias("r")).select("r.*")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("The Beatles!", "beatles"), ("A.B.C.", "abc"), ("an  apple, a day", "apple day"), ("Été", "été"), ("", "")])
def test_normalize_answer(spark, raw, want):
    assert one(spark, text.normalize_answer(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("x\nAnswer: Paris", "Paris"), ("answer:\nParis ", "Paris"), ("Answer: a\nAnswer: b", None), ("Answer: ", None), ("none", None), ("Answer: a b", "a b"), ("x\rAnswer: y", None)])
def test_extract_answer(spark, raw, want):
    assert one(spark, text.extract_answer(F.lit(raw))) == want


def test_parse_assistant(spark):
    made = lambda q: f"<tool_call>\n<function=search>\n<parameter=query>\n{q}\n</parameter>\n</function>\n</tool_call>"
    parse = lambda t: tuple(one(spark, text.parse_assistant(F.lit(t))))
    assert parse("think " + made("who is x")) == ("tool", "think", "who is x")
    assert parse(" Answer: x ") == ("answer", "Answer: x", None)
    assert [parse(t)[0] for t in (made("a") + made("b"), made("a") + " more", made("a<b"), made(" "), "<tool_call> cut")] == ["invalid"] * 5


def test_terms_and_spans(spark):
    assert set(one(spark, text.query_terms(F.lit("Who is the FATHER of Rome's king, at 1912?")))) == {"father", "rome", "king", "1912"}
    assert "i̇stanbul" in one(spark, text.query_terms(F.lit("İstanbul")))
    assert set(one(spark, text.entity_spans(F.lit("Barry Cook met Liu and The")))) == {"Barry Cook", "Liu"}
    assert one(spark, text.suffix_prefix_overlap(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (2, 3, 4))))) == 2
    assert one(spark, text.clean_answers(F.array(*map(F.lit, (" A ", "B", "A", "", " B "))))) == ["A", "B"]


def test_examples_and_records_round_trip(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"id":"x","question":"q","answers":"one","data_source":"s"}\n\n{"question":"r","answers":["a","b"]}\n')
    rows = jsonl.read_examples(spark, str(tmp_path / "e.jsonl")).orderBy("line").collect()
    assert [(r.id, r.answers, r.data_source) for r in rows] == [("x", ["one"], "s"), ("example-3", ["a", "b"], "unknown")]
    (tmp_path / "bad.jsonl").write_text('{"id":\n')
    with pytest.raises(Exception, match="invalid"):
        jsonl.read_records(spark, str(tmp_path / "bad.jsonl")).collect()
    n = jsonl.write_records(frame(spark, [record(1, [said("x")])]).withColumn("id", F.col("id").cast("string")), str(tmp_path / "out"))
    assert n == 1 and jsonl.read_records(spark, str(tmp_path / "out")).first()["turns"][0]["text"].endswith("x")


def test_prepare_rows(spark):
    raw = spark.createDataFrame([(123, " Q? ", [" A ", "A"], "nq", None), (2, "", ["a"], "nq", None), (3, "q", [], None, ["Paris", " Paris "]), (4, "q", None, "nq", None)], "id int, question string, golden_answers array<string>, data_source string, t array<string>")
    got = prep.prepare(raw.withColumn("reward_model", F.struct(F.struct(F.col("t").alias("target")).alias("ground_truth")))).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("123", "Q?", ["A"], "nq"), ("3", "q", ["Paris"], "unknown")]


GOLDEN = [
    record(0, [said("gold")], question="Q1", exact_match=True, reward=1.0, advantage=0.5),
    record(1, [said("bad")], question="Q1", advantage=-0.5),
    record(2, [{"role": "assistant", "text": "no marker", "parsed_kind": "answer"}], question="Q2", valid_format=False, reward=-0.1),
    record(3, [call("x y"), seen(ok=False, items=False), said("bad")], question="Q3", tool_failures=1),
    record(4, [call("same query"), {"role": "tool", "ok": True}, call("Same  query"), {"role": "tool", "ok": True}, said("bad")], question="Q4"),
    record(5, [call("one"), seen(items=False), call("one"), seen(), call("two")], question="Q5", valid_format=False, stop_reason="max_search_calls", reward=-0.1),
]


def test_labels_of_golden_records(spark):
    df = frame(spark, GOLDEN)
    known = diagnostics.labels(diagnostics.behavior(df))
    got = {r.id: set(r.labels) for r in known.collect()}
    assert got[0] == {"correct", "direct_correct"} and got[1] == {"wrong", "direct_wrong"} and got[2] == {"invalid_format"}
    assert "tool_failure" in got[3] and "repeated_search" in got[4] and "empty_search" not in got[4]
    assert {"searched_invalid_format", "empty_search", "max_search_no_answer", "too_many_search_no_gain"} <= got[5]
    s = diagnostics.summarize_trajectories(known).first()
    assert (s.total, s.correct, s.wrong, s.invalid_format, s.tool_failure, s.repeated_search) == (6, 1, 3, 2, 1, 2)
    b = diagnostics.summarize_behavior(known).first()
    assert (b.empty_observation_count, b.pending_tool_call_count) == (1, 1)
    assert metrics.group_comparison(df, "question", "id").count() == 2


def test_offline_labels(spark):
    obs = seen("Sextus Aelius Catus", "Gaius Silius and Aelia Paetina")
    df = frame(spark, [
        record(1, [call("a"), seen(), said("Dexter King")], answers=["Dexter"]),
        record(2, [call("a"), seen(), said("1869")], answers=["October 2, 1869"]),
        record(3, [call("Aelia Paetina"), obs, said("Gaius Silius")], question="Who is the maternal grandfather of Claudia Antonia?", answers=["Nero"]),
        record(4, [said("Barry Cook (for the 2011 film) or Liu Bicheng (for the 2020 film)")], answers=["Barry Cook"]),
    ])
    got = {r.id: r for r in diagnostics.offline(df).collect()}
    assert got[1].possible_alias_match and not got[1].answer_granularity_miss
    assert got[2].answer_granularity_miss and got[3].missing_followup_query and got[4].multi_candidate_answer


def test_rewards(spark):
    df = frame(spark, [record(1, [said("gold")], exact_match=True), record(2, [call("q"), seen(items=False), call("q"), said("a b c d e f g h i j")]), record(3, [call("a"), seen(), call("a"), seen(), call("a")], valid_format=False, stop_reason="max_search_calls")])
    got = {(r.config_name, r.id): r for r in rewards.rescore(df, rewards.load_configs(["mine:no_search=0.5"])).collect()}
    assert all(got[c, 1].final_reward == 1.0 for c in rewards.DEFAULT_CONFIGS)
    r = got["penalty_v1", 2]
    assert (r.duplicate_query_penalty, r.empty_result_penalty, r.verbose_answer_penalty) == (0.05, 0.03, 0.02)
    assert got["penalty_v1", 3].final_reward == pytest.approx(-0.2) and got["base_reward_v0", 3].final_reward == -0.1
    for bad in ("x", "x:", "x:nothing=1", "x:empty=-1", ":empty=1"):
        with pytest.raises(ValueError):
            rewards.parse_config(bad)
    score = lambda t: one(spark, rewards.score_answer(F.lit(t), F.array(F.lit("The Gold"))))
    assert (score("Answer: gold").reward, score("Answer: tin").reward, score("gold").reward) == (1.0, 0.0, -0.1)


def test_group_advantages(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 0.0), (1, -0.1), (1, -0.1), (1, -0.1)], "question_index int, reward double")
    assert sorted(r.advantage for r in metrics.group_advantages(df).collect()) == [-0.5, 0.0, 0.0, 0.0, 0.5]
    assert sorted(r.advantage for r in metrics.group_advantages(df, standardize=True, clip=0.75).collect()) == [-0.75, 0.0, 0.0, 0.0, 0.75]
    assert tuple(metrics.degenerate_groups(metrics.group_advantages(df)).first()) == (2, 1)


def test_turn_credit(spark):
    bridge = [call("film Stefan director"), seen("Stefan Ruzowitzky", "an Austrian film director"), call("Ruzowitzky birth place Vienna"), seen("Stefan Ruzowitzky", "born in Vienna 1961"), said("Graz")]
    df = frame(spark, [record(1, bridge, question="Where was the director of the film born?", answers=["Vienna"], advantage=-0.5), record(2, [call("a"), seen(), {"role": "assistant", "text": "x", "parsed_kind": "answer"}], valid_format=False, stop_reason="invalid_format", advantage=-0.5)])
    labels = lambda c: {(r.id, r.turn_index): r.label for r in credit.credit_labels(df, c).collect()}
    assert labels(credit.Credit("helpful_bridge", helpful_bonus=0.1)) == {(1, 1): "helpful_bridge_search"}
    assert labels(credit.Credit("evidence_bridge", evidence_bonus=0.1)) == {(1, 1): "evidence_bridge_search"}
    assert labels(credit.Credit("final_hop_bridge", evidence_bonus=0.1, final_hop_bonus=0.1, guard_penalty=0.06)) == {(1, 1): "final_hop_attribute_search", (2, 1): "final_answer_guard"}
    done = {r.id: r.turn_credits for r in credit.apply_credit(df, credit.Credit("final_hop_bridge", guard_penalty=0.06)).collect()}
    assert done[1] is None and done[2][0]["effective_advantage"] == pytest.approx(-0.56)
    assert one(spark, credit.effective_advantage(F.lit(-0.5), F.lit(0.1))) == pytest.approx(0.1)
    with pytest.raises(ValueError):
        credit.Credit("other")


def test_datums(spark):
    turn = "struct<prompt:array<int>,completion:array<int>,logprobs:array<double>,advantage:double,mask:double>"
    rows = [(1, [([1, 2], [3, 4], [-0.3, -0.4], 2.0, 0.0), ([1, 2, 3, 4, 5], [6], [-0.6], 2.0, 1.0)]), (2, [([1], [2], [-1.0], 1.0, 0.0), ([9, 9, 9], [3], [-1.0], 1.0, 0.0)]), (3, [])]
    df = sequence.build_datums(spark.createDataFrame(rows, f"id int, samples array<{turn}>"), strict=False)
    got = {r.id: r for r in df.collect()}
    a = got[1]
    assert a.status is None and a.input_tokens == [1, 2, 3, 4, 5] and a.target_tokens == [2, 3, 4, 5, 6]
    assert a.advantages == [0, 2, 2, 0, 2] and a.logprobs == [0, -0.3, -0.4, 0, -0.6] and a.mask == [0, 0, 0, 0, 1] and a.loss_tokens == 3
    assert got[2].status == "not_a_prefix" and got[3].status == "no_turns"


def test_packing_and_weights(spark):
    df = spark.createDataFrame([(s, k, n) for s in (0, 1) for k, n in enumerate([8192] * 9 + [100] * 70)], "step int, id int, num_tokens int")
    got = sequence.pack_micro_batches(df)
    sizes = got.groupBy("step", "batch").agg(F.count("*").alias("n"), (F.max("num_tokens") * F.count("*")).alias("p")).collect()
    assert got.count() == 158 and all(r.n <= 32 and r.p <= 64000 for r in sizes)
    two = spark.createDataFrame([(0, 0, [1.0]), (0, 1, [1.0])], "step int, batch int, advantages array<double>")
    assert [r.advantages for r in sequence.weight_for_global_mean(two, ["step", "batch"], ["step"]).collect()] == [[0.5], [0.5]]


def test_logprobs_and_loss(spark):
    lp = F.array(F.lit(None).cast("double"), F.lit(-0.11), F.lit(None).cast("double"))
    assert one(spark, sequence.align_logprobs(lp, F.array(F.lit(True), F.lit(False)))) == [-0.11, 0.0]
    with pytest.raises(Exception, match="required"):
        one(spark, sequence.align_logprobs(lp, F.array(F.lit(True), F.lit(True))))
    t = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0, 0.0, 0), (0.0, 0.0, 0.0, 0.0, 0.0, 0)], "cur double, old double, adv double, ref double, teacher double, mask int")
    r = sequence.loss_statistics(t).first()
    assert (r.loss, r.loss_mean, r.train_tokens) == (-1.0, -0.5, 1)
    t = spark.createDataFrame([(-0.2, -0.2, 0.0, 0.0, -0.5, 1), (-0.3, -0.3, 0.0, 0.0, -0.8, 0)], "cur double, old double, adv double, ref double, teacher double, mask int")
    r = sequence.loss_statistics(t, distil=0.5).first()
    assert r.loss == pytest.approx(0.1) and r.mask_rate == 0.5 and r.gap_mean == pytest.approx(0.3)


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "Paris is the capital of France"), (2, "A novella by a French writer"), (3, ""), (4, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "novella french writer"), (2, "  ??? "), (3, "zzzz")], "item_id int, text string")
    hits = retrieval.bm25(docs, asked)
    assert [(r.query_id, r.doc_id) for r in hits.collect()] == [(1, 2)]
    got = {r.query_id: (r.ok, r.error_type, r.n_items) for r in retrieval.search_status(asked, hits).collect()}
    assert got == {1: (True, None, 1), 2: (False, "empty_query", 0), 3: (True, None, 0)}


def test_failure_draws(spark):
    calls = spark.range(20000)
    got = {r.failure: r["count"] for r in retrieval.draw_failures(calls, {"timeout": 0.1, "empty": 0.2}, 1, "id").groupBy("failure").count().collect()}
    assert abs(got["timeout"] - 2000) < 200 and abs(got["empty"] - 4000) < 300
    with pytest.raises(ValueError):
        retrieval.draw_failures(calls, {"timeout": 0.7, "empty": 0.4}, 1, "id")


def test_observations_within_a_budget(spark):
    blocks = F.array(*map(F.lit, ("a b", "c d e", "f")))
    base = len(protocol.REMINDER.split())
    fit = lambda n: one(spark, protocol.fit_blocks(blocks, text.word_count, n))
    assert (fit(base + 6), fit(base + 5), fit(base + 4), fit(base + 1)) == ("a b\n\nc d e\n\nf", "a b\n\nc d e", "a b", None)


def test_replay(spark):
    called = "<tool_call><function=search><parameter=query>q</parameter></function></tool_call>"
    rows = [(1, 0, called), (1, 1, "Answer: x"), (2, 0, called), (2, 1, called), (2, 2, called), (3, 0, "<tool_call>"), (4, 0, called)]
    got = {r.id: (r.stop_reason, r.search_calls) for r in replay.replay(spark.createDataFrame(rows, "id int, turn int, text string"), max_search_calls=2).collect()}
    assert got == {1: ("answer", 1), 2: ("max_search_calls", 2), 3: ("invalid_format", 0), 4: (None, 1)}


def test_reports_have_their_sections(spark):
    out = reports.trajectory_report(frame(spark, GOLDEN).withColumn("ord", F.col("id")))
    assert [x for x in out.split("\n") if x.startswith("## ")] == ["## Summary", "## Buckets", *(f"## {h}" for h in reports.SECTIONS.values()), "## Group Comparisons"]
    assert "# Offline Diagnostics" in reports.offline_report(frame(spark, GOLDEN)) and "penalty_v1" in reports.sensitivity_report(frame(spark, GOLDEN), rewards.default_configs())


def test_selection_is_capped_then_filled(spark):
    rows = [(f"{s}{k}", s, 5, "dev") for s in ("a", "b") for k in range(10)] + [("z", "c", 1, "train")]
    df = spark.createDataFrame(rows, "id string, data_source string, score int, origin string")
    got = prep.select_candidates(df, 7, per_source=2).collect()
    assert [r.id for r in got][:5] == ["a0", "a1", "b0", "b1", "z"] and len(got) == 7


def test_next_prompt_keeps_sampled_tokens(spark):
    from siftwell.functions import prompts

    arr = lambda *x: F.array(*map(F.lit, x))
    got = one(spark, prompts.next_prompt(arr(1, 2), arr(5), arr(1, 2, 5, 8, 9), arr(1, 2, 5, 8, 9, 4, 7), arr(1, 2), arr(6, 8)))
    assert got.tokens == [1, 2, 6, 8, 9, 4, 7] and got.status is None
    assert one(spark, prompts.next_prompt(arr(1, 2), arr(5), arr(1, 2, 6), arr(1, 2, 6), arr(1), arr(2))).status == "no_boundary"
    assert one(spark, prompts.next_prompt(arr(1), arr(5), arr(1, 5, 8), arr(1, 9), arr(1), arr(2))).status == "history_rewritten"


def test_backends(spark):
    from siftwell.operators import backends

    docs = spark.createDataFrame([(1, "french novella"), (2, "german opera")], "doc_id int, text string")
    asked = spark.createDataFrame([(k, q) for k, q in enumerate(["opera", "??", "zzz"])], "query_id int, query string")
    got = {r.query_id: (r.ok, r.error_type, r.n_items) for r in backends.build("local_bm25", documents=docs).search(asked).collect()}
    assert got == {0: (True, None, 1), 1: (False, "empty_query", 0), 2: (True, None, 0)}
    broken = backends.build("local_bm25", {"timeout": 1.0}, documents=docs)
    assert broken.name == "local_bm25" and {(r.ok, r.error_type, r.n_items) for r in broken.search(asked).collect()} == {(False, "timeout", 0)}
    assert backends.tool_records(asked, broken).agg(F.sum("tool_failures")).first()[0] == 3
    with pytest.raises(ValueError):
        backends.build("other")


def test_shuffle_and_cyclic_batch(spark):
    df = spark.range(300).withColumn("id", F.col("id"))
    a = [r.ord for r in prep.shuffled(df, 1).orderBy("id").collect()]
    assert sorted(a) == list(range(300)) and a != [r.ord for r in prep.shuffled(df, 2).orderBy("id").collect()]
    got = prep.take_batch(prep.shuffled(df.limit(5), 1), 3, 12, 5).orderBy("batch_pos").collect()
    assert [r.ord for r in got] == [(3 + k) % 5 for k in range(12)]
