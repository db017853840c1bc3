"""The bound on the similarity ratio never undercuts it, and too few candidates raise where asked to."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from siftwell.operators import diagnostics, prep


def test_bound_is_never_below_the_ratio(spark):
    rng, rows = random.Random(5), [("", ""), ("a", ""), ("İi", "ii"), ("日本x", "x日本"), ("a.b", "a+b"), ("a" * 300, "a" * 299 + "b")]
    for _ in range(400):
        a = "".join(rng.choices("abcd .日", k=rng.randint(0, 30)))
        b = "".join(rng.choices("abcd .日", k=rng.randint(0, 30))) if rng.random() < 0.5 else a.replace(rng.choice("abcd"), rng.choice("abcd"), 1)
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", diagnostics.ratio_bound(F.col("a"), F.col("b")).alias("bound"), diagnostics.sequence_ratio("a", "b").alias("ratio")).collect():
        own = SequenceMatcher(None, r.a, r.b)
        assert abs(r.ratio - own.ratio()) < 1e-12 and r.bound >= r.ratio - 1e-12
        assert r.bound < 0.82 or abs(r.bound - own.quick_ratio()) < 1e-12


def test_pairs_that_cannot_reach_the_threshold(spark):
    rows = [(1, "Barak Obama", ["Barack Obama"]), (2, "entirely else", ["Dexter King"]), (3, "x", ["x y z long reference"]), (4, None, ["a"]), (5, "Colour", ["Color", "Dog"])]
    df = spark.createDataFrame(rows, "id int, final_answer string, answers array<string>")
    assert {r.id: r.possible_alias_match for r in diagnostics.alias_matches(df, "id").collect()} == {1: True, 2: False, 3: True, 5: True}


def test_too_few_candidates(spark):
    df = spark.createDataFrame([(k, k % 3, "dev", f"s{k % 2}") for k in range(12)], "id int, score int, origin string, data_source string")
    assert prep.select_candidates(df, 8, strict=True).count() == 8
    assert prep.select_candidates(df, 9).count() == 8
    for few in (df, df.where("id < 0")):
        with pytest.raises(Exception, match="asked for 9 candidates, found"):
            prep.select_candidates(few, 9, strict=True).collect()
