"""Queries run over whole texts: words at their ends count."""

import pytest

from siftwell.plans import derive, more_queries  # noqa: F401
from siftwell.plans.registry import QUERIES

TURNS = [(3, 1, "user", " ".join(f"ask{k}" for k in range(20)) + " Whose Mother"), (3, 2, "assistant", "I search now"), (3, 3, "user", " ".join(f"seen{k}" for k in range(20)) + " Ada Lovelace"), (3, 4, "assistant", " ".join(f"end{k}" for k in range(20)))]


@pytest.fixture
def small(spark, tmp_path):
    spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven born in 1912", "en", "s", 60)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_words_at_the_ends(spark, small):
    row = derive.trajectories(spark, small).first()
    tool, last = row["turns"][1], row["turns"][-1]
    assert "Ada Lovelace" in tool["observation"] and "Ada Lovelace" in tool["items"][0]["content"]
    assert "Whose Mother" in row["question"] and "end19" in last["text"]
    assert "born in 1912" in derive.examples(spark, small).first()["question"]


def test_queries_without_sql_are_whole(spark, small):
    assert QUERIES["f12_offline_diagnostics"](spark, small).first()["final_answer"].endswith("end19")
    # twelve of thirteen words agree: with 3 and 4 words the ratio was lower
    from difflib import SequenceMatcher

    text = spark.read.parquet(f"{small}/documents.parquet").first()["text"]
    assert QUERIES["p26_sequence_ratio"](spark, small).first()["ratio"] == round(SequenceMatcher(None, text, text.split(" ", 1)[1]).ratio(), 6)
