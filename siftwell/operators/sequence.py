"""Token sequences for training: datums, masks, packing, weighting and loss statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import scratch

# Limits of a training batch.
MAX_CONTEXT_TOKENS = 8192
MAX_BATCH_ITEMS = 32
MAX_PADDED_TOKENS = 64_000


def build_datums(df: DataFrame, strict: bool = True) -> DataFrame:
    """Df with input_tokens, target_tokens, logprobs, advantages, mask, num_tokens and loss_tokens.

    df has samples: an array of structs of prompt, completion, logprobs, advantage and mask, one for each assistant
    turn. A prompt must extend all tokens before it; strict raises where it doesn't, else status names the fault.
    """
    s = F.col("samples")
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.size(F.get(s, i - 1)["prompt"]) + F.size(F.get(s, i - 1)["completion"]))

    def spread(value, plain):
        per_turn = F.transform(s, lambda t, i: F.concat(F.transform(F.slice(t["prompt"], before(i) + 1, F.greatest(F.size(t["prompt"]) - before(i), F.lit(0))), lambda _: plain), value(t)))
        return F.flatten(per_turn)

    same = lambda v: lambda t: F.transform(t["completion"], lambda _: v(t))
    at = F.transform(s, lambda t, i: (i == 0) | (F.slice(t["prompt"], F.lit(1), before(i)) == F.concat(F.get(s, i - 1)["prompt"], F.get(s, i - 1)["completion"])))
    last = F.try_element_at(s, F.lit(-1))
    status = (
        F.when(F.size(s) == 0, "no_turns")
        .when(F.exists(s, lambda t: F.size(t["completion"]) != F.size(t["logprobs"])), "lengths_differ")
        .when(~F.forall(at, lambda x: x), "not_a_prefix")
        .when(F.aggregate(s, F.lit(0), lambda a, t: a + F.size(t["completion"])) == 0, "no_tokens")
        .when(F.size(last["prompt"]) + F.size(last["completion"]) - 1 > MAX_CONTEXT_TOKENS, "too_long")
    )
    full = F.concat(last["prompt"], last["completion"])
    shift = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    d = df.withColumn("status", status)
    if strict:
        d = d.withColumn("status", F.when(F.col("status").isNotNull(), F.raise_error(F.concat(F.lit("datum: "), F.col("status"))).cast("string")))
    d = d.withColumns({"_full": full, "_lp": spread(lambda t: t["logprobs"], F.lit(0.0)), "_adv": spread(same(lambda t: t["advantage"]), F.lit(0.0)), "_mask": spread(same(lambda t: t["mask"]), F.lit(0.0))})
    d = d.withColumns({"input_tokens": F.slice("_full", F.lit(1), F.greatest(F.size("_full") - 1, F.lit(0))), "target_tokens": shift(F.col("_full")), "logprobs": shift(F.col("_lp")), "advantages": shift(F.col("_adv")), "mask": shift(F.col("_mask"))})
    return d.withColumns({"num_tokens": F.size("input_tokens"), "loss_tokens": F.size(F.filter("advantages", lambda a: a != 0))}).drop("_full", "_lp", "_adv", "_mask")


def trainable(df: DataFrame) -> DataFrame:
    """Datums with a token of non-zero advantage."""
    return df.where(F.exists("advantages", lambda a: a != 0))


def turn_selected(policy: str, gate: str, is_final: Column, is_credited: Column, advantage: Column, reward: Column, exact: Column) -> Column:
    """Whether a turn's tokens are in the distillation mask."""
    chosen = {"none": F.lit(False), "final_answer": is_final, "credited_turns": is_credited, "final_and_credited": is_final | is_credited}[policy]
    return chosen & {"all": F.lit(True), "positive_advantage": advantage > 0, "positive_reward": reward > 0, "exact_match": exact}[gate]


def batch_rooms(counts: pd.DataFrame) -> pd.DataFrame:
    """Where first-fit decreasing stands as it comes to each length of one step.

    counts: num_tokens, n. Lengths fall, so the first datum of a batch fixes how many it holds, and only the last
    batch is ever open: of the next n datums, the first `room` go to batch `open`, and every `cap` more to a new one.
    """
    counts = counts.sort_values("num_tokens", ascending=False)
    rows, open_, room = [], -1, 0
    for tokens, n in zip(counts.num_tokens.tolist(), counts.n.tolist()):
        cap = min(MAX_BATCH_ITEMS, MAX_PADDED_TOKENS // max(1, tokens))
        rows.append((open_, room, cap))
        more = -(-max(0, n - room) // cap)
        open_, room = open_ + more, room + more * cap - n
    return counts.assign(**{c: pd.Series(x, index=counts.index, dtype="int64") for c, x in zip(("open", "room", "cap"), zip(*rows))})


def pack_micro_batches(df: DataFrame, step: str = "step", key: str = "id") -> DataFrame:
    """(step, id, num_tokens, batch, status): first-fit decreasing by length, one step at a time.

    A batch has at most MAX_BATCH_ITEMS datums and MAX_PADDED_TOKENS tokens once padded. Datums of more than
    MAX_CONTEXT_TOKENS get the status too_long and no batch, those without a length no_length; all others are ok.
    Python sees a step's counts by length alone, at most MAX_CONTEXT_TOKENS + 1 rows; datums are numbered in
    range partitions that are written once, so a step or a length may hold any number of them.
    """
    spark, kinds = df.sparkSession, dict(df.dtypes)
    named = df.select(F.col(step).alias("step"), F.col(key).alias("id"), "num_tokens")
    status = F.when(F.col("num_tokens").isNull(), "no_length").when(F.col("num_tokens") > MAX_CONTEXT_TOKENS, "too_long").otherwise("ok")
    path, order = scratch(spark, "batches"), [F.col("step"), F.desc("num_tokens"), F.col("id")]
    named.withColumn("status", status).repartitionByRange("status", *order).sortWithinPartitions("status", *order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    written = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))

    pieces = written.where("status = 'ok'").groupBy("_part", "step", "num_tokens").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("step", "num_tokens").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    counts = pieces.groupBy("step", "num_tokens").agg(F.sum("n").alias("n"))
    rooms = counts.groupBy("step").applyInPandas(batch_rooms, f"step {kinds[step]}, num_tokens {kinds['num_tokens']}, n long, open long, room long, cap long").drop("n")
    rooms = rooms.withColumnsRenamed({"step": "_s", "num_tokens": "_n"})
    placed = pieces.join(rooms, F.col("step").eqNullSafe(F.col("_s")) & (F.col("num_tokens") == F.col("_n")))
    placed = placed.select(F.col("_part").alias("_q"), "_s", "_n", "_first", "_before", "open", "room", "cap")
    found = written.join(placed, (F.col("_part") == F.col("_q")) & F.col("step").eqNullSafe(F.col("_s")) & (F.col("num_tokens") == F.col("_n")) & (F.col("status") == "ok"), "left")
    nth = F.col("_at") - F.col("_first") + F.col("_before")
    batch = F.when(nth < F.col("room"), F.col("open")).otherwise(F.col("open") + 1 + F.floor((nth - F.col("room")) / F.col("cap")))
    return found.select(F.col("step").alias(step), F.col("id").alias(key), "num_tokens", batch.cast("int").alias("batch"), "status")


def weight_for_global_mean(df: DataFrame, batch: list[str], step: list[str]) -> DataFrame:
    """Advantages times the batch's share of its step's datums, in single precision."""
    per_batch, per_step = df.groupBy(*batch).agg(F.count("*").alias("_n")), df.groupBy(*step).agg(F.count("*").alias("_all"))
    w = (F.col("_n") / F.col("_all")).cast("float")
    return df.join(per_batch, batch).join(per_step, step).withColumn("advantages", F.transform("advantages", lambda a: (a.cast("float") * w).cast("float"))).drop("_n", "_all")


def align_logprobs(model: Column, required: Column) -> Column:
    """A model's log-probabilities without the first; null counts as 0 where it isn't required, else raises."""
    own = F.slice(model, F.lit(2), F.greatest(F.size(model) - 1, F.lit(0)))
    fault = F.when(F.size(own) != F.size(required), F.raise_error(F.lit("log-probabilities and tokens differ in number")).cast("array<double>"))
    missing = F.raise_error(F.lit("a required log-probability is missing")).cast("double")
    return F.coalesce(fault, F.zip_with(own, required, lambda x, r: F.when(x.isNotNull(), x).when(r, missing).otherwise(0.0)))


def write_bucketed(df: DataFrame, key: str = "id", buckets: int = 64) -> DataFrame:
    """df as a table in a shared folder, bucketed and sorted by key: tables of as many buckets join on it without a shuffle."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "bucketed")
    name = "siftwell_" + path.rpartition("-")[2]
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def attach_logprobs(datums: DataFrame, model: DataFrame, name: str, required: str, key: str = "id", strict: bool = True) -> DataFrame:
    """Datums with `name`, a model's log-probabilities aligned to their target tokens, and name_status.

    model: key and logprobs, of all tokens of a datum, the first without one. Partners are found by key and zipped by position; a token
    needs a value where the array `required` (advantages for a reference model, the mask for a teacher) is not 0. The status is ok,
    or says that the partner is missing, repeated or of another length, that the required array is, or that a needed value lacks; strict
    raises on all but ok. Over two write_bucketed tables nothing is shuffled.
    """
    partner = model.groupBy(key).agg(F.count("*").alias("_n"), F.any_value("logprobs").alias("_own"))
    d = datums.join(partner, key, "left")
    own = F.slice("_own", F.lit(2), F.greatest(F.size("_own") - 1, F.lit(0)))
    lacks = F.exists(F.arrays_zip(own.alias("x"), F.col(required).alias("r")), lambda z: z["x"].isNull() & (z["r"] != 0))
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated").when(F.col(required).isNull() | (F.size(required) != F.size("target_tokens")), "required_length").when(F.coalesce(F.size("_own"), F.lit(-1)) != F.size("target_tokens") + 1, "length").when(lacks, "lacks_a_value").otherwise("ok")
    if strict:
        status = F.when(status == "ok", status).otherwise(F.raise_error(F.concat(F.lit(f"{name} of datum "), F.col(key).cast("string"), F.lit(": "), status)).cast("string"))
    d = d.withColumn(f"{name}_status", status)
    return d.withColumn(name, F.when(F.col(f"{name}_status") == "ok", F.transform(own, lambda x: F.coalesce(x, F.lit(0.0))))).drop("_n", "_own")


def gate_mask(mask: Column, teacher: Column, least: float) -> Column:
    """The mask, 0 where the teacher's log-probability is under least."""
    return F.zip_with(mask, teacher, lambda m, t: F.when(t >= least, m).otherwise(0.0))


def loss_statistics(tokens: DataFrame, kl: float = 0.0, clip: float = 0.0, distil: float = 0.0) -> DataFrame:
    """One row of the loss and its statistics, from a row per token: cur, old, adv, and ref, teacher and mask where used."""
    ratio = F.exp(F.col("cur") - F.col("old"))
    used = F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip)) if clip > 0 else ratio
    train, own = F.col("adv") != 0, F.col("mask") != 0
    drift = 0.5 * F.pow(F.col("cur") - F.col("ref"), 2)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    a = tokens.agg(
        F.count("*").alias("n"), zero(-F.sum(used * F.col("adv"))).alias("policy"), zero(F.sum(F.when(train, drift))).alias("drift"), F.count_if(train).alias("train_tokens"),
        F.avg(F.when(train, ratio)).alias("ratio_mean"), F.max(F.when(train, ratio)).alias("ratio_max"), F.avg(F.when(train, (ratio != used).cast("double"))).alias("clip_fraction"), F.avg(F.when(train, drift)).alias("logprob_mse_mean"),
        F.count_if(own).alias("masked_tokens"), zero(-F.avg(F.when(own, F.col("cur")))).alias("distil_loss"), F.avg(F.when(own, F.abs(F.col("cur") - F.col("teacher")))).alias("gap_mean"), F.avg(F.when(own, F.col("teacher"))).alias("teacher_logprob_mean"),
    )
    n = F.greatest("n", F.lit(1))
    loss = F.col("policy") + kl * F.col("drift") + distil * F.col("distil_loss")
    return a.select(loss.alias("loss"), (loss / n).alias("loss_mean"), "train_tokens", "ratio_mean", "ratio_max", "clip_fraction", "logprob_mse_mean", "masked_tokens", (F.col("masked_tokens") / n).alias("mask_rate"), "distil_loss", "gap_mean", "teacher_logprob_mean")
