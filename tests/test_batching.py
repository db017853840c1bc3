"""First-fit decreasing by counts of lengths, against the plain loop over batches."""

import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import sequence as Q


def plain(rows):
    """Every datum looks at every batch, longest first."""
    out, batches = {}, {}
    for step, key, n in sorted((r for r in rows if r[2] is not None and r[2] <= Q.MAX_CONTEXT_TOKENS), key=lambda r: (-r[2], r[1])):
        own = batches.setdefault(step, [])
        fit = next((b for b in own if b[1] < 32 and (b[1] + 1) * max(b[0], n) <= 64_000), None)
        if fit is None:
            fit = [n, 0, len(own)]
            own.append(fit)
        fit[1] += 1
        out[step, key] = fit[2]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_equals_plain_first_fit(spark, seed):
    rng, rows = random.Random(seed), []
    for k in range(900):
        step = rng.choice([0, 1, 1, 1, None])
        rows.append((step, k, rng.choice([None, 9000, 8192, 8193, 8000, 2000, 2001, 1, 0, 500, rng.randrange(8192), rng.randrange(8192), rng.randrange(60) * 100])))
    df = spark.createDataFrame(rows, "step int, id int, num_tokens int")
    got = Q.pack_micro_batches(df.repartition(7)).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.status == ("no_length" if r.num_tokens is None else "too_long" if r.num_tokens > 8192 else "ok")
        assert r.batch == want.get((r.step, r.id)), r


def test_empty_table_and_other_names(spark):
    df = spark.createDataFrame([("x", 5, 7, 1)], "g string, k long, num_tokens int, batch int")
    assert [tuple(r) for r in Q.pack_micro_batches(df, "g", "k").collect()] == [("x", 5, 7, 0, "ok")]
    assert Q.pack_micro_batches(df.where("k > 9"), "g", "k").collect() == []


def test_one_length_in_one_large_step(spark):
    """A step whose rows all have one length: Python sees one count, and batches are full but for the last."""
    n = 300_000
    df = spark.range(n).select(F.lit(1).alias("step"), "id", F.lit(64).alias("num_tokens"))
    got = Q.pack_micro_batches(df).groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    r = got.agg(F.count("*"), F.max("batch"), F.min("n"), F.count_if((F.col("hi") - F.col("lo") == 31) & (F.col("lo") == F.col("batch") * 32))).first()
    assert tuple(r) == (n // 32, n // 32 - 1, 32, n // 32)
