"""Observations under two budgets against trying every prefix, and every reason why a replay stops."""

import random

import pytest
from pyspark.sql import functions as F

from siftwell.functions import protocol as P
from siftwell.operators import fit, replay

CALL = "<tool_call><function=search><parameter=query>q</parameter></function></tool_call>"


def words_in_pairs(texts):
    """A count that is not additive: two words make a token, wherever blocks end."""
    return [-(-len(t.split()) // 2) for t in texts]


@pytest.mark.parametrize("count", [fit.bytes_in_fours, words_in_pairs])
def test_equals_trying_every_prefix(count):
    rng = random.Random(3)
    blocks = [[" ".join(["w"] * rng.randint(0, 9)) for _ in range(rng.choice([0, 1, 2, 7, 40]))] for _ in range(300)]
    room = [(rng.randint(0, 200), rng.randint(-5, 300)) for _ in blocks]
    for b, (tool, left), got in zip(blocks, room, fit.longest_prefixes(blocks, room, count)):
        n, tokens = 0, 0
        for m in range(1, len(b) + 1):  # the first candidate that is too long ends the list
            used = count([fit.content_of(b, m) + "\n\n" + P.REMINDER])[0]
            if used > tool or used > left:
                break
            n, tokens = m, used
        assert got == (n, tokens)


def test_few_questions_for_many_blocks():
    asked = []
    (n, _), = fit.longest_prefixes([["word"] * 5000], [(3000, 10**9)], lambda texts: asked.append(len(texts)) or fit.bytes_in_fours(texts))
    assert 1900 < n < 2000 and len(asked) < 30


def test_fit_observations(spark):
    df = spark.createDataFrame([(1, ["a" * 40, "b" * 40], 10), (2, ["a" * 4000], 10), (3, None, None), (4, [], 5), (5, ["a", None], None)], "id int, blocks array<string>, used_tokens int")
    got = {r.id: (r.n_fit, r.content, r.next_tokens) for r in fit.fit_observations(df, 25 + len(P.REMINDER) // 4, 1000).collect()}
    rest = len(P.REMINDER) + 2
    assert got[1] == (2, "a" * 40 + "\n\n" + "b" * 40, 10 + -(-(82 + rest) // 4))
    assert got[2] == (0, None, None) and got[3] == (0, None, None) and got[4] == (0, None, None) and got[5][:2] == (2, "a\n\n")


def outputs(spark, rows):
    df = spark.createDataFrame(rows, "id int, turn int, text string, tokens int, blocks array<string>, rebuilt boolean, start_tokens int")
    return df.withColumn("sizes", fit.prefix_sizes(F.col("blocks"), lambda c: F.length(c)))


def test_all_reasons(spark):
    one = 3 + len(P.REMINDER)  # tokens of a message with a block of one character
    rows = [(1, 0, "Answer: x", 5, [], None, 10), (2, 0, "<tool_call> x", 5, [], None, 10)]
    rows += [(3, t, CALL, 5, ["a"], None, 10) for t in range(4)]
    rows += [(4, 0, CALL, 5, ["a"], False, 10), (5, 0, CALL, 5, ["a" * 5000], None, 10), (6, 0, CALL, 5, ["a"], None, 10_000)]
    rows += [(7, 0, CALL, 5, ["a"], None, 10_000 - 5 - one), (8, 0, CALL, 5, ["a"], None, 10), (9, 0, CALL, 5, ["a", "b", "c" * 5000], None, 10), (9, 1, "Answer: y", 5, [], None, 10)]
    got = {r.id: r for r in replay.replay_budgets(outputs(spark, rows), max_search_calls=3, tool_tokens=1000, trajectory_tokens=10_000).collect()}
    reason = {k: r.stop_reason for k, r in got.items()}
    assert reason == {1: "answer", 2: "invalid_format", 3: "max_search_calls", 4: "prompt_reconstruction_failed", 5: "tool_observation_budget", 6: "max_trajectory_tokens", 7: "max_trajectory_tokens", 8: None, 9: "answer"}
    assert (got[3].search_calls, got[3].stop_turn, got[3].tokens) == (3, 3, 10 + 3 * (5 + one)) and got[9].blocks == 2 and got[9].final_text == "Answer: y"
    assert got[6].search_calls == 0 and got[7].tokens == 10_000 and got[4].final_text == CALL
    turns = replay.replay_budgets(outputs(spark, [(3, t, CALL, 5, ["a"], None, 10) for t in range(4)]), max_search_calls=9, max_turns=2, tool_tokens=1000).first()
    assert (turns.stop_reason, turns.search_calls) == ("max_assistant_turns", 1)
