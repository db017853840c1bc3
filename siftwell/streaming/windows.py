"""Search statistics over event time, as a stream or as a batch. An extension: there is nothing to match here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    """A stream of the event files that arrive in folder."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).option("recursiveFileLookup", True).parquet(folder)


def windowed_stats(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Calls, errors and mean value per window and type; events that are later than late are left out."""
    w = F.window("ts", width)
    got = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n", "total", "most")


def run_once(stats: DataFrame, path: str, checkpoint: str) -> None:
    """Process what there is, writing each batch's changed windows; of several rows of a window the last one counts."""
    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    stats.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each window that run_once() has written."""
    rows = spark.read.parquet(path)
    return rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total", "most"), "batch").alias("x")).select("start", "event_type", "x.*")
