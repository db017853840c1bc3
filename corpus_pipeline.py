"""From documents to packed training bins: toxicity, near duplicates, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. Null and empty texts pass all
stages: they are not toxic, near-duplicate or contaminated, lose nothing, and get a piece of no words and no bin.
Very long texts are taken whole by every stage and packed in full pieces and a last one. Of near duplicates the smallest
id stays, so there are no ties; of rows that repeat an id and its text one stays. Empty tables give empty results. Documents
need the columns of COLUMNS; all others are dropped, whatever their names, so none can clash with a stage's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.decontaminate import decontaminate
from siftwell.llm.ngram_jaccard import ngram_jaccard_components
from siftwell.llm.packing import best_fit_pack
from siftwell.llm.store import materialize, release
from siftwell.llm.substring_dedup import substring_dedup
from siftwell.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.5."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).where("toxicity < 0.5").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by five-word shingle sets of a Jaccard similarity of 0.8 or more, that of the smallest id.

    Of rows that repeat an id and its text one stays, whatever their other columns hold; different texts of one id
    count as documents of their own; rows without an id all stay.
    """
    # rows without an id meet nothing: they would all go to one task of the joins
    without = docs.select(COLUMNS).where("doc_id is null")
    docs = docs.select(COLUMNS).where("doc_id is not null").withColumn("_text", F.xxhash64("text"))
    # a further text of an id gets a key of its own, behind all ids
    several = docs.groupBy("doc_id").agg(F.min("_text").alias("_first"), F.max("_text").alias("_last")).where("_first <> _last").drop("_last")
    own = F.xxhash64("doc_id", "_text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    docs = docs.join(several, "doc_id", "left").withColumn("_key", F.when(F.col("_text") != F.col("_first"), own).otherwise(F.col("doc_id")))
    further = docs.where("_key <> doc_id").select("_key", "doc_id").distinct()
    found = ngram_jaccard_components(docs, size=5, percent=80, id_col="_key").withColumnRenamed("doc_id", "_key")
    stays = found.join(further, "_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("_least")).where("_least.doc_id < component_id")
    others = found.join(stays, "component_id", "left").where("_key <> coalesce(_least._key, component_id)").select("_key")
    # the window follows the join's own partitioning and order, so it shuffles nothing
    kept = docs.join(others.hint("merge"), "_key", "left_anti")
    copy = F.row_number().over(Window.partitionBy("_key", "_text").orderBy("_key"))
    return kept.withColumn("_copy", copy).where("_copy = 1").select(COLUMNS).unionByName(without)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word windows that start in a document of a smaller id; a text that loses nothing stays as it is."""
    kept = substring_dedup(docs, window=50)
    text = F.col("kept_text")
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("n_chars")).cast("long").alias("n_chars")).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)
    return found.where(F.size("items") == 0).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its bin."""
    return best_fit_pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Trained scores and exact joins over whole texts are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
            release(spark)
    return docs
