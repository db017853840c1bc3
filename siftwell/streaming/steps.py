"""Following a run's step files as they arrive: advantages and the best step so far.

State is kept per step and question group: the set of its records. A record that comes again, in the same
file or another, changes nothing; a late one, or a newer version of one, has its group stated anew. Each trigger writes
the groups that it touched to a folder of its own number, which a repeated trigger overwrites, so a run
that is stopped and started again neither loses nor doubles a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import group_advantages

RECORD = "step long, question_index long, id long, version long, reward double, exact_match boolean"
_STATED = "step long, question_index long, id long, version long, reward double, exact_match boolean, advantage double"


def advantages(groups: DataFrame) -> DataFrame:
    """Rows of groups' records (step, question_index, records), of an id its last version, with their advantages."""
    each = groups.select("step", "question_index", F.explode("records").alias("r")).select("step", "question_index", "r.*")
    last = Window.partitionBy("step", "question_index", "id").orderBy(F.desc("version"), F.desc("reward"), F.desc("exact_match"))
    own = each.withColumn("_n", F.row_number().over(last)).where("_n = 1").withColumn("_g", F.struct("step", "question_index"))
    return group_advantages(own, "_g").select([c.split()[0] for c in _STATED.split(", ")])


def follow_steps(spark: SparkSession, path: str, out: str, checkpoint: str, files_per_trigger: int = 1000) -> StreamingQuery:
    """Read the step files under path that are new since the last run, and state their groups under out."""
    records = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_trigger).json(path)
    groups = records.groupBy("step", "question_index").agg(F.collect_set(F.struct("id", "version", "reward", "exact_match")).alias("records"))

    def state(batch: DataFrame, number: int) -> None:
        advantages(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return groups.writeStream.outputMode("update").foreachBatch(state).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stated(spark: SparkSession, out: str) -> DataFrame:
    """Each group as its last trigger stated it."""
    rows = spark.read.schema(f"{_STATED}, batch long").option("basePath", out).parquet(f"{out}/batch=*")
    last = rows.groupBy("step", "question_index").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["step", "question_index", "batch"]).drop("batch")


def best_step(rows: DataFrame) -> DataFrame:
    """W10 over what is stated: step, exact match, and whether it is the first of the best steps."""
    own = rows.groupBy("step").agg(F.avg(F.coalesce(F.col("exact_match"), F.lit(False)).cast("double")).alias("em"))
    top = own.agg(F.max_by("step", F.struct("em", -F.col("step"))).alias("top"))
    return own.join(F.broadcast(top), own["step"] == top["top"], "left").select("step", "em", F.col("top").isNotNull().alias("best"))
